"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .htmltext import op6_line_blocks
from .langid import op3_language_id
from .lattice import op11_subword_lattice
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import op5_mix_sources
from .packing import op10_best_fit_packing
from .resampling import OP13_SQL, op13_importance_resampling
from .sharding import op1_jump_shards
from .simhash import op7_simhash_golay
from .tokencount import op4_token_counts
from .toxicity import op8_toxicity
from .vectors import OP9_SQL, op2_multi_index, op9_segment_statistics


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_jump_shards, op2_multi_index, op3_language_id, op4_token_counts, op5_mix_sources, op6_line_blocks, op7_simhash_golay, op8_toxicity, op9_segment_statistics, op10_best_fit_packing, op11_subword_lattice, op12_merkle_manifest, op13_importance_resampling]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL that DuckDB runs to the same rows; for the others see the brute-force versions in tests/llm."""
    return {"op9_segment_statistics": OP9_SQL, "op12_merkle_manifest": OP12_SQL, "op13_importance_resampling": OP13_SQL}
