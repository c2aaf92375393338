"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between Spark and Python.
ARROW_BYTES = str(8 << 20)

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own.setdefault("folder", tempfile.mkdtemp(prefix="siltstone-"))
    return folder.rstrip("/")


class Work:
    """A run's own folder: tables are written once, read back with a cut lineage, and dropped when no plan reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        # whole texts go to Python in batches of so many bytes (or one text), whatever their lengths
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)

    def save(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd").mode("errorifexists")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}")
        schema = df.schema
        del df, writer
        # Spark deletes the shuffle files of a finished job once neither Python nor the driver's JVM refers to its plan
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The shuffle partitions that the session is sized for; bucket counts follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
