"""Written intermediates: they cut lineage between the rounds of iterative plans, and survive lost executors."""

from __future__ import annotations

import secrets
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local session takes a temporary folder;
    on a cluster that is an error, as executors don't share one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. Plans show the first hundred characters of where they read; 64 random bits leave room for the folder."""
    return f"{shared_dir(spark)}/{name}-{secrets.token_hex(8)}"


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back; its path is kept as `.path_`, for drop_written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_ = path
    return out


def drop_written(*frames: DataFrame | None) -> None:
    """Remove tables of written() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "path_", None):
            drop_path(df.sparkSession, path)
