"""Objectives over dense features as SQL aggregates of one pass.

Terms name the weights ``w0 .. w(d-1)`` and the intercept ``b``; ``bind`` puts
numbers in their place, so that one aggregate computes every coordinate.
"""

from __future__ import annotations

import re


def score(d: int, intercept: bool = True) -> str:
    return " + ".join([f"w{k} * x{k}" for k in range(d)] + ["b"] * intercept)


def probability(d: int, intercept: bool = True) -> str:
    return f"1 / (1 + exp(-({score(d, intercept)})))"


def lr_gradient(d: int, intercept: bool = True) -> list[str]:
    """Mean of x (p - y), and of (p - y) for the intercept."""
    p = probability(d, intercept)
    return [f"avg(({p} - y) * x{k})" for k in range(d)] + [f"avg({p} - y)" if intercept else "cast(0 as double)"]


def lr_loss(d: int, eps: float | None = None) -> str:
    """Mean log-loss; probabilities are clamped to [eps, 1 - eps] if eps is given."""
    p = probability(d)
    p = f"least(greatest({p}, {eps!r}), {1 - eps!r})" if eps else p
    return f"coalesce(avg(-(y * ln({p}) + (1 - y) * ln(1 - ({p})))), 0)"


def lasso_gradient(d: int, lam: float) -> list[str]:
    s = score(d)
    return [f"avg((({s}) - y) * x{k}) + {lam!r} * sign(w{k})" for k in range(d)] + [f"avg(({s}) - y)"]


def lasso_loss(d: int, lam: float) -> str:
    """Mean squared error and the absolute weights, the intercept among them."""
    return f"avg(pow(({score(d)}) - y, 2)) + {lam!r} * ({' + '.join(f'abs(w{k})' for k in range(d))} + abs(b))"


def svm_gradient(d: int, lam: float, compat: bool = False) -> list[str]:
    """Labels are -1 and 1. compat leaves the intercept's gradient a sum instead of a mean."""
    s = score(d)
    inside = f"(case when y * ({s}) < 1 then cast(1 as double) else cast(0 as double) end)"
    return [f"avg(-{inside} * y * x{k}) + {lam!r} * w{k}" for k in range(d)] + [f"{'sum' if compat else 'avg'}(-{inside} * y)"]


def svm_loss(d: int, lam: float) -> str:
    return f"avg(greatest(0, 1 - y * ({score(d)}))) + {lam!r} * ({' + '.join(f'w{k} * w{k}' for k in range(d))} + b * b)"


def accuracy(d: int, intercept: bool = True) -> str:
    """Share of rows whose score has the label's side; labels are 0 and 1."""
    return f"avg(case when (({score(d, intercept)}) > 0) = (y > 0) then cast(1 as double) else cast(0 as double) end)"


def bind(term: str, weights: list[float]) -> str:
    """A term with numbers for w0 .. w(d-1) and b."""
    return re.sub(r"\b(?:w(\d+)|b)\b", lambda m: f"({weights[int(m[1])] if m[1] else weights[-1]!r}D)", term)
