"""Result tables: first terminal row of an id wins, idempotent append, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.schemas import EXPORT


def first_terminal(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row of each id, the first in arrival order over results and dead letters.

    A minimum of structs with partial aggregation: unlike a row number it needs no sort and repeated ids shrink before
    the shuffle.
    """
    rest = [c for c in rows.columns if c != "custom_id" and c not in order]
    packed = F.struct(*order, *rest)
    return rows.groupBy("custom_id").agg(F.min(packed).alias("r")).select("custom_id", *[F.col(f"r.{c}").alias(c) for c in rows.columns if c != "custom_id"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Emitted ids of a store; reads no result bodies. An absent store has none."""
    try:
        return spark.read.parquet(path).select("custom_id")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return spark.createDataFrame([], "custom_id string")
        raise


def append(spark: SparkSession, rows: DataFrame, store: str, order: list[str], job: str = "job") -> int:
    """Append rows whose ids are in neither kind of the store yet; how many. Rows need custom_id and kind (done or dead).

    Results come first and the manifest of their ids after them, so a crash between the two leaves ids that the next
    append sees in the results themselves. A finalized store takes no more rows (ValueError).
    """
    if written(spark, f"{store}/export"):
        raise ValueError(f"{store} is finalized")
    ids = manifest(spark, f"{store}/results").unionByName(manifest(spark, f"{store}/_manifest")).distinct()
    new = first_terminal(rows, order).join(ids, "custom_id", "left_anti").withColumn("job", F.lit(job))
    # What is appended is fixed before the first write to the path it was compared with.
    new.write.mode("overwrite").parquet(f"{store}/_pending")
    pending = spark.read.parquet(f"{store}/_pending")
    count = pending.count()
    if count:
        pending.write.mode("append").partitionBy("job", "kind").parquet(f"{store}/results")
        pending.select("custom_id").write.mode("append").parquet(f"{store}/_manifest")
    return count


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end at path."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def finalize(spark: SparkSession, store: str, order: list[str]) -> str:
    """Write the export of a store once and close it to further rows; its path. Finalizing again changes nothing."""
    path = f"{store}/export"
    if not written(spark, path):
        export(first_terminal(spark.read.parquet(f"{store}/results"), order), path)
    return path


def reshape_once(spark: SparkSession, rows: DataFrame, path: str) -> str | None:
    """Write REST output lines of a finished batch once; the path, or None where there are no lines. Lines that stand stay as they are."""
    if written(spark, path):
        return path
    lines = reshaped(rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if lines.isEmpty():
        return None
    lines.write.mode("overwrite").text(path)
    return path


def open_run(spark: SparkSession, store: str) -> str:
    """The one job in a store; ValueError where there is none or more."""
    jobs = [r["job"] for r in spark.read.parquet(f"{store}/results").select("job").distinct().limit(2).collect()]
    if len(jobs) != 1:
        raise ValueError(f"{store} holds {len(jobs) or 'no'} jobs, not one")
    return jobs[0]


def export_columns(rows: DataFrame) -> DataFrame:
    """The columns of the export, in order; done rows have no error and dead rows no response."""
    dead = F.col("kind") == "dead"
    own: dict[str, Column] = {"status_code": F.when(~dead, F.col("status_code")).cast("int"), "body_json": F.when(~dead, F.col("body")), "error_code": F.when(dead, F.col("error_code")), "error_message": F.when(dead, F.col("error_message"))}
    return rows.select(*[own.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EXPORT])


def export(rows: DataFrame, path: str, row_group: int = 50_000) -> None:
    """Write the export as Parquet with row groups of a bounded number of rows."""
    export_columns(rows).write.mode("overwrite").option("compression", "snappy").option("parquet.block.row.count.limit", row_group).parquet(path)


def same_place(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two paths name one place."""

    def full(path: str) -> str:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = found.getFileSystem(spark._jsc.hadoopConfiguration())
        return system.makeQualified(found).toString().rstrip("/")

    return full(a) == full(b)


def reshaped(rows: DataFrame) -> DataFrame:
    """REST output lines: id, custom_id, response and error. A response that is there wins; neither is an error of its own."""
    digest = F.substring(F.sha2(F.col("custom_id"), 256), 1, 24)
    has = F.col("status_code").isNotNull() | F.col("body").isNotNull()
    failed = F.col("error_code").isNotNull() | F.col("error_message").isNotNull()
    response = F.struct(F.coalesce("status_code", F.lit(200)).cast("int").alias("status_code"), F.coalesce("request_id", F.concat(F.lit("req_"), digest)).alias("request_id"), F.col("body"))
    error = F.when(failed, F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message"))).otherwise(F.struct(F.lit(None).cast("string").alias("code"), F.lit("result had no response or error").alias("message")))
    return rows.filter("custom_id IS NOT NULL").select(F.concat(F.lit("batch_req_"), digest).alias("id"), "custom_id", F.when(has, response).alias("response"), F.when(~has, error).alias("error"))
