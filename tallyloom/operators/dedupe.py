"""Collapse of near-duplicate rows inside one system.

A column's value is the first of the least (padded, all upper-case) rank, or the
first at all where a null is among them. Both are minima by a struct, so groups
are merged map-side and no group is gathered, however many rows share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import base_key, strip
from ..schemas import SEQ


def _canonical(name: str) -> Column:
    v = F.col(name)
    best = F.min_by(v, F.struct(v != strip(v), v == F.upper(v), F.col(SEQ)))
    return F.when(F.count_if(v.isNull()) > 0, F.min_by(v, F.col(SEQ))).otherwise(best)


def _differs(name: str) -> Column:
    v = F.col(name)
    nulls = F.count_if(v.isNull())
    return F.coalesce(F.min(v) != F.max(v), F.lit(False)) | ((nulls > 0) & (nulls < F.count("*")))


def collapse(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with one for each base key, merge log with ``_seq`` for its order)."""
    names = [c for c in df.columns if c not in (key, SEQ)]
    keyed = df.where(F.col(key).isNotNull()).withColumn("__base", base_key(F.col(key)))
    merged = keyed.groupBy("__base").agg(
        F.count("*").alias("__n"), F.min_by(key, SEQ).alias("__key"), F.min(SEQ).alias(SEQ), *[_canonical(c).alias(c) for c in names],
        F.filter(F.array(*[F.when(_differs(c), F.lit(c)) for c in names]), lambda x: x.isNotNull()).alias("__differing"))
    rows = merged.select(F.when(F.col("__n") == 1, F.col("__key")).otherwise(F.col("__base")).alias(key), *names, SEQ)
    log = merged.where("__n > 1").select(F.lit(key).alias("key_column"), F.col("__base").alias("key_value"), F.col("__n").alias("row_count"), F.col("__differing").alias("differing_columns"), F.col(SEQ))
    return rows.unionByName(df.where(F.col(key).isNull())).select(*df.columns), log
