"""Relational operators over DataFrames."""

from graniteq.operators.dedup import distinct_on, unique_count
from graniteq.operators.join import equi_join, flatten_pairs, join_with_position
from graniteq.operators.sort import sort_by, sort_chunks, sort_runs, with_position

__all__ = ["distinct_on", "equi_join", "flatten_pairs", "join_with_position", "sort_by", "sort_chunks", "sort_runs", "unique_count", "with_position"]
