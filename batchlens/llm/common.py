"""Table reading, scratch tables and code shipping shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from batchlens.session import ship

__all__ = ["discard", "partitions", "scratch_path", "scratch_root", "ship", "stage", "table"]

_local_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one where that is unset and the master is local (tests).

    Raises RuntimeError on a cluster without that setting: executors would each write to a disk of their own.
    """
    global _local_root
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="batchlens-")
    return f"file://{_local_root}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/batchlens/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, gives the planner a true size (so that joins
    broadcast only below the session's threshold), and fixes ids drawn while writing.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
