"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[int, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if 0 not in _OWN:
        _OWN[0] = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


class Scratch:
    """Written tables that cut lineage and outlive lost executors.

    ``keep`` writes a frame as Parquet below the shared folder and returns the
    table read back. ``drop`` deletes tables that no later plan reads; the last
    table of an operator stays, since the returned frame reads it lazily.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.at(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        schema = df.schema
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def release(self) -> None:
        """Let Spark drop the shuffle files of plans that nobody holds any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
