"""Contiguous ranges of document ids, so that ordered work is dealt out without one global sort task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points of a long column; reads that column alone."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(key).cast("long"), at, max(1000, 20 * n)).alias("q")).first()
    return sorted(set(row["q"] or []))


def range_of(key: str, bounds: list[int]) -> Column:
    """The number of cut points at or below the key; 0 for null.  Two steps of about sqrt(n) comparisons."""
    k = F.col(key).cast("long")
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    count = lambda a: F.size(F.filter(a, lambda b: b <= k))
    group = count(heads)
    return F.when(k.isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * step + count(F.element_at(table, F.greatest(group, F.lit(1)))))
