"""graniteq: relational building blocks expressed over Spark DataFrames.

Sorting, equi-joins and duplicate elimination on integer, string and
composite keys, with an optional row-validity predicate and the counters
that describe such work.
"""

from graniteq.keys import NUM, NUM_STR, RECID, STR, resolve_key
from graniteq.operators import (
    distinct_on,
    equi_join,
    flatten_pairs,
    join_with_position,
    sort_by,
    sort_chunks,
    sort_runs,
    unique_count,
    with_position,
)

__all__ = [
    "NUM",
    "NUM_STR",
    "RECID",
    "STR",
    "distinct_on",
    "equi_join",
    "flatten_pairs",
    "join_with_position",
    "resolve_key",
    "sort_by",
    "sort_chunks",
    "sort_runs",
    "unique_count",
    "with_position",
]
