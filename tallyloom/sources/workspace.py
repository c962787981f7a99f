"""Written stages of a run, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a job shuffled goes with its end, rather than when the driver happens to collect garbage. For jobs one after another."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Workspace:
    """Frames written once and read back, so that later plans start there; ``spark.checkpoint.dir`` says where.

    Where that is unset (one machine, as in tests) it is a temporary folder that goes with the process.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            if not _own:
                _own.append(tempfile.mkdtemp(prefix="reconcile-"))
                atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
            root = f"file://{_own[0]}"
        self.spark, self.path = spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
