"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters, digits and longer characters, A-Z lower-cased. Features of a document are its distinct
words, word pairs and pairs with one or two words between, each hashed to one of 2**BITS places. Training passes over
a bounded sample of labelled documents (`SAMPLE`), one document after another: every coordinate has its own learning
rate, and the L1 term keeps most weights at exactly zero, so what is broadcast is small whatever the corpus' size.
Scoring then covers every whole text.

Nulls and odd input: null, empty and blank texts score by the bias alone; null and repeated ids are scored like others
(a null id is never held out); without any labelled document every score is 0. Very long texts are scored whole, on
their own. An empty table gives an empty result. Extra columns are ignored by `scored` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.common import table
from batchlens.llm.kernels import ROOT, SYMBOLS, U64, mix, slices, text_bytes, word_hashes, words
from batchlens.llm.labelled import held_out, sample

BITS = 20
#: The most labelled documents that training reads, and how often it passes over them.
SAMPLE, EPOCHS = 16_000, 5
#: Learning rate, its smoothing, and the L1 and L2 terms.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
#: Bytes of text whose features are held at once.
SLICE = 1 << 20
#: Distances of the words of a pair: 1 is a bigram, more are skip-grams.
GAPS = (1, 2, 3)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of every occurrence in all texts together, and the text each belongs to."""
    data, starts = text_bytes(column)
    begin, end, counts = words(data, starts, SYMBOLS)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    if not begin.size:
        return np.zeros(0, np.int32), owner
    hashed = word_hashes(data, begin, end)
    places, owners = [(hashed >> U64(64 - bits)).astype(np.int32)], [owner]
    for gap in GAPS:
        if hashed.size > gap:
            inside = owner[:-gap] == owner[gap:]
            places.append((mix((hashed[:-gap] * U64(ROOT) + hashed[gap:] + U64(gap))[inside]) >> U64(64 - bits)).astype(np.int32))
            owners.append(owner[:-gap][inside])
    return np.concatenate(places), np.concatenate(owners)


def ftrl(documents: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, distinct features) of documents, in their order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weight(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(epochs):
        for label, found in documents:
            at = np.append(found, bias)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    everything = weight(np.arange(bias + 1))
    return everything[:bias], float(everything[bias])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Places and weights that are not zero, and the bias; None without labelled documents. Runs as one task over the bounded sample."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                place, owner = features(batch.column("text"))
                pairs = np.unique(owner.astype(np.int64) << BITS | place)
                edge = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
                place = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                blobs = [place[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("label"), pa.array(blobs, pa.binary())], ["key", "doc_id", "label", "places"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, sizes, found = [], [], []
        for batch in batches:
            data, starts = text_bytes(batch.column("places"))
            marks += batch.column("label").to_pylist()
            sizes.append(np.diff(starts) // 4)
            found.append(data.copy().view(np.int32))
        if marks:
            # One array of all places: it is given back whole, where a list of them would leave the worker's memory in pieces.
            edge, found = np.cumsum(np.concatenate(sizes)), np.concatenate(found)
            weights, bias = ftrl(list(zip(marks, np.split(found, edge[:-1]), strict=True)))
            at = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(weights[at], bias))], ["place", "weight"])

    rows = sample(spark, docs, labels, label, most).select("text", "label", "key", "doc_id").mapInArrow(extract, "key long, doc_id long, label int, places binary")
    model = rows.repartition(1).sortWithinPartitions("key", "doc_id", F.xxhash64("places")).mapInArrow(fit, "place int, weight double").toPandas()
    if not len(model):
        return None
    place, weight = model["place"].to_numpy(), model["weight"].to_numpy()
    return place[place >= 0], weight[place >= 0], float(weight[place < 0][0])


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, keep: bool = False) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs; with `keep`, all columns of docs and score under the name __toxic_score."""
    model = train(spark, docs, labels, label, most)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value, None
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                total = np.zeros(batch.num_rows)
                if model is not None:
                    if weights is None:
                        weights = np.zeros(1 << BITS)
                        weights[model[0]] = model[1]
                    place, owner = features(batch.column("text"))
                    useful = weights[place] != 0
                    pairs = np.unique(owner[useful].astype(np.int64) << BITS | place[useful])
                    total = model[2] + np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], minlength=batch.num_rows)
                    total = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                columns = batch.columns if keep else [batch.column("doc_id")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total)], schema=pa.schema([*(batch.schema if keep else [batch.schema.field("doc_id")]), pa.field("__toxic_score", pa.float64())]))

    if keep:
        from pyspark.sql.types import DoubleType, StructField, StructType

        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__toxic_score", DoubleType())]))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, __toxic_score double").withColumnRenamed("__toxic_score", "score")


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    return scored(spark, docs, labels, keep=True).filter(F.col("__toxic_score") < threshold).drop("__toxic_score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
