"""Reproducible pseudo-random values as functions of a row's own columns, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 12  # hex digits of an MD5 sum, 48 bits


def random_long(bound: int, seed: int, *inputs: Column) -> Column:
    """Uniform in [0, bound) but for a bias below bound / 2^48, the same for the same seed and inputs."""
    named = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in inputs])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, _DIGITS), 16, 10).cast("long") % bound


def random_letters(max_length: int, seed: int, *inputs: Column) -> Column:
    """1 to ``max_length`` letters a to z; the length and each letter are uniform."""
    length = random_long(max_length, seed, *inputs) + 1
    letter = lambda i: F.chr(random_long(26, seed + 1, *inputs, i) + 97)
    return F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), length), letter), "")


def random_long_sql(bound: int, seed: int, *inputs: str) -> str:
    """DuckDB SQL for ``random_long``."""
    named = " || ':' || ".join([f"'{seed}'", *inputs])
    return f"(('0x' || substr(md5({named}), 1, {_DIGITS}))::bigint % {bound})"


def random_letters_sql(max_length: int, seed: int, *inputs: str) -> str:
    """DuckDB SQL for ``random_letters``."""
    letter = f"chr((97 + {random_long_sql(26, seed + 1, *inputs, 'i')})::integer)"
    return f"array_to_string(list_transform(range(1, 2 + {random_long_sql(max_length, seed, *inputs)}), lambda i: {letter}), '')"
