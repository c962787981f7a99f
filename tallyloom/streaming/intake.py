"""Cleaning and routing of exports as they arrive.

Ingest, cleaning and validation look at one row at a time, so they run unchanged on
streams; collapse and resolution need whole tables and stay with batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.validate import classify, split
from ..schemas import ERP_COLUMNS, text_schema


def read_stream(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    """New CSV files of one entity below ``folder``, every column a string."""
    reader = spark.readStream.schema(text_schema(ERP_COLUMNS[entity])).option("header", True).option("quote", '"').option("escape", '"')
    return reader.csv(folder)


def route(rows: DataFrame, entity: str, system: str, clean_path: str, quarantine_path: str, checkpoint: str):
    """Starts a query that appends clean rows and quarantine to two Parquet tables; each batch is written once."""

    def write(batch: DataFrame, number: int) -> None:
        classified = classify(batch, entity, system).persist()
        good, bad = split(classified, entity)
        # A batch that is repeated after a failure overwrites its own folder.
        good.write.mode("overwrite").parquet(f"{clean_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
        classified.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reason_counts(rows: DataFrame, entity: str, system: str) -> DataFrame:
    """Running counts by reason, for a stream in complete mode."""
    return classify(rows, entity, system).groupBy("reason_code").agg(F.count("*").alias("n"))
