"""Which physical operators a plan has."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_nodes(df: DataFrame) -> list[str]:
    """Names of the physical plan's nodes, from the top."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", text, re.M)
