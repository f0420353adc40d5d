"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .decontamination import op8_decontamination
from .embedding_dedup import op3_embedding_dedup
from .licenses import op9_license_scan
from .ngram_jaccard import op4_ngram_jaccard
from .packing import op2_best_fit_packing
from .secrets import op7_secret_scan
from .sharding import op10_sharding
from .sql import ORACLES
from .substring_dedup import op6_substring_dedup
from .token_counts import op5_token_counts
from .toxicity import op1_toxicity

_QUERIES = [
    op1_toxicity, op2_best_fit_packing, op3_embedding_dedup, op4_ngram_jaccard, op5_token_counts,
    op6_substring_dedup, op7_secret_scan, op8_decontamination, op9_license_scan, op10_sharding,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
