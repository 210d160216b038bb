"""Which labelled documents a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.common import stage

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is in the fold that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text, label and key of at most `most` labelled documents outside the held-out fold, those with the least hash of their id.

    Labels that are null do not count; of several labels of an id the highest does.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("__label"))
    chosen = chosen.withColumn("__key", F.xxhash64("doc_id")).orderBy("__key", "doc_id").limit(most).withColumnRenamed("doc_id", "__id")
    chosen = stage(spark, chosen, "labelled")
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")).select("text", F.col("__label").cast("int").alias("label"), F.col("__key").alias("key"), "doc_id")
