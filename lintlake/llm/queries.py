"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from .best_fit import op11_best_fit
from .bpe import op8_bpe
from .gif import op2_gif
from .licenses import op10_licenses
from .near_duplicates import op5_near_duplicates
from .packing import op6_packing
from .quality import op3_quality
from .resampling import op12_resampling
from .sharding import op9_sharding
from .sql import SQL
from .substrings import op7_substrings
from .token_counts import op1_token_counts
from .toxicity import op4_toxicity
from .whitening import op13_whitening


def queries() -> dict:
    pipeline = importlib.import_module("corpus_pipeline")
    ops = (
        op1_token_counts, op2_gif, op3_quality, op4_toxicity, op5_near_duplicates, op6_packing, op7_substrings, op8_bpe, op9_sharding, op10_licenses, op11_best_fit, op12_resampling, op13_whitening,
    )
    return {f.__name__: f for f in ops} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
