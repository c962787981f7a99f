"""Rows dealt out in ranges of an id, so that tasks hold neighbours in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RANGE = "__range"


def bounds(df: DataFrame, id_col: str, n: int) -> list:
    """At most ``n - 1`` ids of the table that cut it in ranges of about equal rows."""
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10_000).alias("p")).first().p
    return sorted(set(found or []))


def range_of(id_col: str | Column, cuts: list) -> Column:
    """The number of the range ``(cuts[i-1], cuts[i]]`` that holds the id; null ids come first."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    if not cuts:
        return F.lit(0)
    above = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda b: b < col)
    return F.when(col.isNull(), 0).otherwise(F.size(above)).cast("int")
