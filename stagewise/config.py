"""Training and store settings, and the rule that picks a store's update."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TrainConfig:
    """Settings of a training loop; a decay coefficient is None or at least 1."""

    alpha: float = 0.5
    num_iters: int = 5
    batch_size: int = 20
    lambda_: float = 0.0
    decay: float | None = None
    staleness: int = 1
    num_workers: int = 4
    train_epoch: int = 1
    hints: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.decay is not None and self.decay < 1:
            raise ValueError("a decay coefficient must be at least 1")
        if min(self.num_iters, self.batch_size, self.num_workers) < 1:
            raise ValueError("iterations, batch size and workers must be positive")


@dataclass(frozen=True)
class StageConfig:
    """One stage of an elastic run: a worker takes its share of batch and step size."""

    batch_size: int
    num_iters: int
    alpha: float
    num_workers: int

    def share(self, worker: int) -> tuple[int, float]:
        """Batch rows and step size of one worker."""
        return self.batch_size // self.num_workers + (worker < self.batch_size % self.num_workers), self.alpha / self.num_workers

    def padded_share(self) -> tuple[int, float]:
        """The same for any worker where all shares are rounded up."""
        return (self.batch_size - 1) // self.num_workers + 1, self.alpha / self.num_workers


def parse_stages(batch_sizes: str, iters: str, alphas: str, workers: str) -> list[StageConfig]:
    """Stages from comma-separated lists of equal length."""
    columns = [text.split(",") for text in (batch_sizes, iters, alphas, workers)]
    if len({len(c) for c in columns}) != 1:
        raise ValueError("stage lists differ in length")
    return [StageConfig(int(b), int(n), float(a), int(w)) for b, n, a, w in zip(*columns)]


def store_update(kind: str = "", consistency: str = "", update: str = "") -> str:
    """How a store applies pushes: ``assign``, ``add``, ``bsp-assign``, ``bsp-add`` or ``ssp-add``."""
    if not kind:
        return update or "assign"
    if kind in ("Single", "Hogwild", "SPMT"):
        return "assign"
    if kind != "PS":
        raise ValueError(f"unknown worker type {kind!r}")
    if consistency == "BSP":
        return "bsp-" + (update or "add")
    if consistency == "SSP":
        return "ssp-add"
    if consistency in ("ASP", ""):
        return "add"
    raise ValueError(f"unknown consistency {consistency!r}")
