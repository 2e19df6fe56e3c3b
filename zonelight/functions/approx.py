"""Approximate distinct counts under both of their names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative standard deviation of the built-in sketch.
RSD = 0.02


def approx_count_distinct(c: Column | str, rsd: float = RSD) -> Column:
    return F.approx_count_distinct(c, rsd)


_NAME = re.compile(r"(?i)\bapprox_distinct(?=\s*\()")


def rewrite_names(sql: str, spans: list[tuple[int, int]]) -> str:
    """SQL with approx_distinct spelt as Spark spells it, outside string literals and comments."""
    return _NAME.sub(lambda m: m[0] if any(a <= m.start() < b for a, b in spans) else "approx_count_distinct", sql)
