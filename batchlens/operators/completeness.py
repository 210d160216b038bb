"""Completeness proof: which input ids have a result, which are missing, which results nobody asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions.scalars import valid_custom_id


def emitted(results: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """Ids with a terminal row, from results and, where there is one, the dead-letter table."""
    ids = results.select("custom_id")
    return (ids if dead is None else ids.unionByName(dead.select("custom_id"))).filter("custom_id IS NOT NULL")


def report(requests: DataFrame, done: DataFrame) -> DataFrame:
    """One row: input_ids, emitted_ids, matched, missing, extra, duplicate_input, rejected_input, complete.

    Each side is reduced to its ids with counts before the one full outer join, so that the shuffle carries ids only
    and repeated ids meet already aggregated.
    """
    ids = requests.select("custom_id", valid_custom_id(F.col("custom_id")).alias("ok"))
    wanted = ids.groupBy("custom_id", "ok").agg(F.count(F.lit(1)).alias("n"))
    rejected = F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0))
    left = wanted.select(F.col("custom_id").alias("want"), "n", "ok").withColumn("good", F.col("ok"))
    right = done.select(F.col("custom_id").alias("have")).groupBy("have").agg(F.count(F.lit(1)).alias("m"))
    both = left.join(right, F.when(F.col("good"), F.col("want")) == F.col("have"), "full_outer")
    want, have = F.coalesce("good", F.lit(False)), F.col("have").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = both.agg(
        count(want).alias("input_ids"), count(have).alias("emitted_ids"), count(want & have).alias("matched"), count(want & ~have).alias("missing"), count(~want & have).alias("extra"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n") - 1)), F.lit(0)).alias("duplicate_input"), rejected.alias("rejected_input"),
    )
    return out.withColumn("complete", F.col("missing") == 0)


def missing(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Valid input ids without a terminal row."""
    return requests.select("custom_id").filter(valid_custom_id(F.col("custom_id"))).distinct().join(done.select("custom_id"), "custom_id", "left_anti")


def missing_sample(requests: DataFrame, done: DataFrame, most: int = 100) -> DataFrame:
    """The first missing ids in byte order."""
    return missing(requests, done).orderBy("custom_id").limit(most)


def extra(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Ids with a terminal row that were never asked for."""
    return done.select("custom_id").distinct().join(requests.select("custom_id"), "custom_id", "left_anti")


def tally(requests: DataFrame) -> DataFrame:
    """One row: distinct ids and surplus occurrences of valid ids."""
    by = requests.filter(valid_custom_id(F.col("custom_id"))).groupBy("custom_id").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("unique_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def write_missing(requests: DataFrame, done: DataFrame, path: str) -> bool:
    """Write missing ids as text if there are any; whether there were."""
    gap = missing(requests, done)
    if not gap.limit(1).count():
        return False
    gap.select("custom_id").write.mode("overwrite").text(path)
    return True
