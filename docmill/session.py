"""Session helpers: import path for Python workers, shared scratch tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator may broadcast after measuring it.
BROADCAST_BYTES = 32 << 20


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, as the session names it; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="docmill-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Parquet tables under the shared folder that cut lineage; one object per operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docmill/{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(
    df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES, more: Column | None = None
) -> DataFrame:
    """df with a broadcast hint if its measured rows fit in limit bytes, else df, which joins by shuffle.

    A row counts bytes_per_row, and the bytes in more if its width varies.
    """
    width = F.lit(bytes_per_row) + (F.coalesce(more, F.lit(0)) if more is not None else 0)
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
