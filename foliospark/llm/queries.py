"""The queries and DuckDB texts of this subpackage, gathered from its modules."""

from __future__ import annotations

from foliospark.llm import decontaminate, divergence, flac, importance, license_scan, line_dedup, lm_scoring, permutation_index, piece_codec, quality_lm, sharding, shingle_join, token_counts

MODULES = (shingle_join, lm_scoring, sharding, decontaminate, license_scan, piece_codec, line_dedup, flac, token_counts, quality_lm, divergence, importance, permutation_index)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
