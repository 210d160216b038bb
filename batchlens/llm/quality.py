"""Quality by histogram gradient-boosted trees over document statistics.

Statistics (sizes, shares of character classes, repetition of words, word pairs and lines) are computed for a whole
batch of texts at once. The trees are fitted on the driver on a bounded sample of labelled documents (`SAMPLE` rows of
statistics, never texts): statistics are binned at quantiles, each level of a tree sums gradients and second
derivatives per node and bin, and takes the best split. Trees are flattened into arrays of complete binary trees and
traversed for all documents and trees together.

Nulls and odd input: null, empty and blank texts have zero statistics and are scored like any other; null and repeated
ids are scored; without any labelled document every score is 0, with one class only it is that class' share. Very long
texts are taken whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.common import table
from batchlens.llm.kernels import ROOT, U64, mix, slices, text_bytes, word_hashes, words
from batchlens.llm.labelled import held_out, sample

#: The most labelled documents that training reads.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, SMOOTH, LEAST = 80, 4, 64, 0.1, 1.0, 8
THRESHOLD = 0.3

#: Character classes of a byte.
CLASSES = ("other", "lower", "upper", "digit", "stop", "comma", "symbol", "pipe", "space", "line", "long")
CLASS = np.zeros(256, np.int64)
for _name, _bytes in {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "stop": b".!?", "comma": b",;:'\"()-", "symbol": b"#$%&*@^~<>=+/\\_{}[]`", "pipe": b"|", "space": b" \t\r", "line": b"\n", "long": range(128, 256)}.items():
    CLASS[list(_bytes)] = CLASSES.index(_name)
BREAKS = np.zeros(256, bool)
BREAKS[10] = True
NAMES = (*(f"share_{c}" for c in CLASSES), "bytes", "words", "lines", "word_length", "word_spread", "distinct_words", "distinct_pairs", "repeated_words", "top_word", "distinct_lines", "line_length", "symbol_ends", "stop_ends")


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and the count of its most frequent one."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(values.size, bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[first], np.diff(np.append(first, values.size)))
    return np.bincount(owner[first], minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of NAMES per text."""
    data, starts = text_bytes(column)
    n = len(starts) - 1
    size = np.diff(starts)
    owner = np.repeat(np.arange(n), size)
    share = np.bincount(owner * len(CLASSES) + CLASS[data], minlength=n * len(CLASSES)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    begin, end, counts = words(data, starts)
    of, length, some = np.repeat(np.arange(n), counts), (end - begin).astype(float), np.maximum(counts, 1)
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / some - mean**2, 0))
    hashed = word_hashes(data, begin, end) if begin.size else np.zeros(0, U64)
    distinct, top = _distinct(hashed, of, n)
    next_to = of[1:] == of[:-1]
    repeated = np.bincount(of[1:][next_to & (hashed[1:] == hashed[:-1])], minlength=n) / some
    pairs, _ = _distinct(mix(hashed[:-1] * U64(ROOT) + hashed[1:])[next_to], of[1:][next_to], n)
    last = CLASS[data[end - 1]] if begin.size else np.zeros(0, np.int64)
    ends = [np.bincount(of[np.isin(last, [CLASSES.index(c) for c in kinds])], minlength=n) / some for kinds in (("symbol", "pipe"), ("stop",))]
    lb, le, lines = words(data, starts, BREAKS)
    line_of = np.repeat(np.arange(n), lines)
    line_distinct, _ = _distinct(word_hashes(data, lb, le), line_of, n) if lb.size else (np.zeros(n, int), None)
    many = np.maximum(lines, 1)
    return np.column_stack([share, np.log1p(size), np.log1p(counts), np.log1p(lines), mean, spread, distinct / some, pairs / np.maximum(counts - 1, 1), repeated, top / some, line_distinct / many, np.log1p(size / many), *ends])


class Trees:
    """Boosted trees as arrays: of complete trees of DEPTH levels, the feature and threshold of inner nodes and the value of leaves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (np.take_along_axis(part, self.feature[trees, node], 1) > self.threshold[trees, node])
            total[at : at + 4096] += self.value[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Fit trees to 0/1 labels."""
    n, features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(features)])
    prior = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(prior / (1 - prior)))
    score, inner, leaves = np.full(n, base), 2**DEPTH - 1, 2**DEPTH
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width = 2**level
            best = np.full(width, 1e-9)
            pick, cut = np.zeros(width, np.int64), np.full(width, BINS, np.int64)
            for f in range(features):
                key = node * BINS + binned[:, f]
                sums = [np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, None)]
                gl, hl, cl = sums
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
                gain[(cl < LEAST) | (ct - cl < LEAST)] = 0
                at = gain.argmax(1)
                found = gain[np.arange(width), at]
                better = found > best
                best[better], pick[better], cut[better] = found[better], f, at[better]
            split = cut < BINS
            first = width - 1
            feature[t, first : first + width] = pick
            threshold[t, first : first + width] = [edges[f][c] if s and c < len(edges[f]) else np.inf for f, c, s in zip(pick, cut, split, strict=True)]
            node = 2 * node + (binned[np.arange(n), pick[node]] > cut[node])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t] = -RATE * gs / (hs + SMOOTH)
        score += value[t][node]
    return Trees(base, feature, threshold, value)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Trees | None:
    """Trees from the bounded sample; None without labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = statistics(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([row.tobytes() for row in found], pa.binary())], ["key", "label", "found"])

    rows = sample(spark, docs, labels, label, most).select("text", "label", "key").mapInArrow(run, "key long, label int, found binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["key", "found"])
    return boost(np.array([np.frombuffer(x) for x in rows["found"]]), rows["label"].to_numpy(float))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs."""
    shared = spark.sparkContext.broadcast(train(spark, docs, labels, label, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = statistics(batch.column("text"))
                score = np.zeros(batch.num_rows) if shared.value is None else shared.value.score(found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
