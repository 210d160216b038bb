"""A corpus from raw documents to packed sequences, in five stages of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from batchlens.llm import jaccard, lines, mixing, packing, toxicity
from batchlens.llm.common import ship, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    ship(spark)
    return toxicity.clean(spark, docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go."""
    ship(spark)
    cleaned = lines.cleaned(spark, docs)
    return cleaned.withColumn("n_chars", _n_chars()) if "n_chars" in docs.columns else cleaned


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard similarity one stays."""
    ship(spark)
    return jaccard.deduplicated(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources meet their target weights."""
    ship(spark)
    return mixing.mix(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of documents and their places in sequences."""
    ship(spark)
    return packing.pack_documents(spark, docs, packing.tokenizer_path())


def _n_chars():
    from pyspark.sql import functions as F

    return F.length("text").cast("long")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_copies", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(spark, function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
