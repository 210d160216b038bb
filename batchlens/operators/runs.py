"""Runs end to end: a batch from request lines to results, and posted results of remote workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.operators import completeness, ledger, results
from batchlens.operators.batches import from_post
from batchlens.sources.jsonl import ingest


def apply_posts(spark: SparkSession, posts: DataFrame, states: DataFrame, store: str, at_ms: int) -> DataFrame:
    """Store posted results first, then say of each whether it closes its lease: a stale post is not acknowledged."""
    wanted = ledger.close(states, posts.select("custom_id", F.col("generation").alias("attempt"))).filter("applied").select("custom_id", F.col("attempt").alias("generation"))
    rows = from_post(posts.join(wanted, ["custom_id", "generation"], "left_semi"), at_ms).withColumn("seq", F.lit(0))
    results.append(spark, rows, store, ["seq", "completed_at"])
    return posts.select("custom_id", "generation").join(wanted.withColumn("acked", F.lit(True)), ["custom_id", "generation"], "left").select("custom_id", "generation", F.coalesce("acked", F.lit(False)).alias("acked"))


def run_batch(spark: SparkSession, lines: DataFrame, store: str, work: Callable[[DataFrame], DataFrame], parts: int = 8) -> DataFrame:
    """Ingest numbered lines, call `work` on requests without a result, store what comes, and report completeness.

    Running it again does only what is missing, so a crashed run is resumed by running it again.
    """
    items, _, _ = ingest(spark, lines)
    todo = items.join(results.manifest(spark, f"{store}/results"), "custom_id", "left_anti").withColumn("attempts", F.lit(1).cast("long"))
    done = work(todo.repartition(parts)).withColumn("seq", F.lit(0))
    results.append(spark, done, store, ["seq", "completed_at"])
    return completeness.report(items, results.manifest(spark, f"{store}/results"))
