"""Cleaning and routing of raw rows: typed clean rows, or quarantine with a reason."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.clean import missing_to_null, money, parse_date, repair_mojibake
from ..schemas import FIELDS, MONEY, SEQ, raw_column

RAW = "__raw"


def as_json(df: DataFrame, names: list[str]) -> Column:
    """A row as JSON, nulls too. Decimal columns are written in full; of itself Spark writes a zero of 18 places as 0E-18."""
    written = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    scale = {n: t.scale for n in names if isinstance(t := df.schema[n].dataType, T.DecimalType)}
    if not scale:
        return written(*names) if names else F.lit("{}")
    number = lambda n: F.coalesce(F.translate(F.format_number(n, scale[n]), ",", ""), F.lit("null"))
    bare = lambda text: text.substr(F.lit(2), F.length(text) - 2)
    parts = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), number(n)) if n in scale else bare(written(n)) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _any(flags: list[Column]) -> Column:
    return reduce(or_, flags, F.lit(False))


def classify(df: DataFrame, entity: str, system: str) -> DataFrame:
    """Canonical typed fields, ``reason_code`` (null: clean), ``stage`` and ``original_data`` (the raw row).

    Columns that a table lacks count as missing; columns without a canonical field
    live on in the raw row only. Dates that fail come before texts that fail, then
    missing required fields, then values of the wrong type.
    """
    fields = FIELDS[entity]
    kept = [c for c in df.columns if c != SEQ]
    fields_at = {f[0]: missing_to_null(F.col(raw_column(f, system))) if raw_column(f, system) in df.columns else F.lit(None).cast("string") for f in fields}
    base = df.withColumns({RAW: as_json(df, kept), **{f"__{n}": c for n, c in fields_at.items()}})
    value = {f[0]: F.col(f"__{f[0]}") for f in fields}
    clean = {
        n: parse_date(value[n]) if how == "date" else repair_mojibake(value[n]) if how == "encoding" else money(value[n]).cast(MONEY) if how == "decimal" else value[n]
        for n, _, _, _, how in fields
    }
    base = base.withColumns({f"_c_{n}": c for n, c in clean.items()})
    lost = lambda kind: _any([value[n].isNotNull() & F.col(f"_c_{n}").isNull() for n, _, _, _, how in fields if how == kind])
    absent = _any([value[n].isNull() for n, _, _, required, _ in fields if required])
    reason = F.when(lost("date"), "unparseable_date").when(lost("encoding"), "unrecoverable_encoding").when(absent, "missing_required_field").when(lost("decimal"), "schema_invalid")
    stage = F.when(reason.isin("unparseable_date", "unrecoverable_encoding"), "cleaning").when(reason.isNotNull(), "schema_validation")
    return base.select(
        F.lit(system).alias("source_system"), *[F.col(f"_c_{n}").alias(n) for n, *_ in fields], *([SEQ] if SEQ in df.columns else []),
        reason.alias("reason_code"), stage.alias("stage"), F.col(RAW).alias("original_data"))


def split(rows: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantine) of classified rows."""
    clean = rows.where("reason_code is null").drop("reason_code", "stage", "original_data")
    number = [SEQ] if SEQ in rows.columns else []
    return clean, rows.where("reason_code is not null").select(F.lit(entity).alias("entity_type"), "source_system", "reason_code", "stage", "original_data", *number)


def validate(df: DataFrame, entity: str, system: str) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantine) of one raw table."""
    return split(classify(df, entity, system), entity)
