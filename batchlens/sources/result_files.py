"""Result files: two readers of result lines, one strict for export and one lenient for sums and ids; and where runs live."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.functions.json_text import at, is_kind, parsed, raw_json, strict_json_error, text_at, unsigned_at

TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens", "reasoning_tokens")
#: Schemes of object stores.
OBJECT_SCHEMES = ("s3", "s3a", "gs", "az", "abfs", "abfss", "file", "memory", "hdfs")


def is_object_url(path: str) -> bool:
    """Whether a path names a store by its scheme rather than a plain file."""
    found = re.match(r"([a-z][a-z0-9+.-]*)://", path)
    return bool(found) and found[1] in OBJECT_SCHEMES


def result_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Lines of a result file; a missing one has none if that is allowed."""
    try:
        return spark.read.option("lineSep", "\n").text(path)
    except Exception as error:  # noqa: BLE001
        if missing_ok and "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], "value string")
        raise


def ids(lines: DataFrame) -> DataFrame:
    """Distinct string ids of lines; torn and foreign lines are passed over."""
    return lines.select(text_at(parsed(F.col("value")), "$.custom_id").alias("custom_id")).filter("custom_id IS NOT NULL").distinct()


def lenient(lines: DataFrame) -> DataFrame:
    """Token counts of every line that has a custom_id of any kind; a bad usage counts as zeros."""
    v = parsed(F.col("value"))
    count = lambda name: F.coalesce(unsigned_at(v, f"$.usage.{name}"), F.lit(0)).cast("long").alias(name)
    return lines.filter(at(v, "$.custom_id").isNotNull()).select(*[count(t) for t in TOKENS])


def strict(lines: DataFrame) -> DataFrame:
    """Whole result rows; lines that lack a required field or have one of the wrong kind are left out."""
    text = F.col("value")
    v = parsed(text)
    required = strict_json_error(text).isNull() & text_at(v, "$.custom_id").isNotNull() & text_at(v, "$.worker_id").isNotNull() & is_kind(at(v, "$.usage"), "OBJECT")
    for name in ("latency_ms", "attempt", "completed_at"):
        required = required & is_kind(at(v, f"$.{name}"), "BIGINT")
    response, failure = at(v, "$.response"), at(v, "$.error")
    has = is_kind(response, "OBJECT")
    number = lambda path: F.coalesce(unsigned_at(v, path), F.lit(0)).cast("long")
    return lines.filter(required).select(
        text_at(v, "$.custom_id").alias("custom_id"), F.when(has & ~is_kind(failure, "OBJECT"), "done").otherwise("dead").alias("kind"), F.when(has, unsigned_at(v, "$.response.status_code")).cast("int").alias("status_code"), text_at(v, "$.response.request_id").alias("request_id"),
        F.when(has, raw_json(raw_json(text, "response"), "body")).alias("body"), text_at(v, "$.error.code").alias("error_code"), text_at(v, "$.error.message").alias("error_message"), *[number(f"$.usage.{t}").alias(t) for t in TOKENS],
        text_at(v, "$.worker_id").alias("worker_id"), number("$.latency_ms").alias("latency_ms"), number("$.attempt").alias("attempt"), F.try_variant_get(v, "$.completed_at", "bigint").alias("completed_at"),
    )


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry table (files or batches) from JSON lines; unreadable lines are passed over, an absent one is empty."""
    rows = result_lines(spark, path, missing_ok=True).select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.filter("id IS NOT NULL")
