"""Document fingerprints by randomised edit embedding.

A text is walked character by character: at every step a shared random bit of (character, step) says whether to stay on
the character or go on, and the step emits the character it is on. Texts that differ by few edits soon walk in step
again, so edit distance becomes Hamming distance between the emitted strings. A walk restarts every `SEGMENT`
characters, which bounds its tables, and all segments of a batch walk together. Of the emitted string, which has two
steps a character, a fingerprint samples `SLOTS` steps, each hashed to four bits. The sample is consistent: each slot
takes the step of lowest random rank below the text's length, so texts of similar length sample the same steps.

`classes` finds candidates by banding on sampled slots and verifies them on whole fingerprints. Bands are so wide that
texts without relation rarely share one, whatever the number of texts, and so many that of pairs just at the threshold
about `MISSED` share none. `neighbours` pairs every document with the next one in descending id.

Nulls and odd input: a null text counts as empty, and an empty one emits padding only; a null id is ordered after all
others; rows with repeated ids follow one another in the order of a hash of their texts. Very long texts are walked
whole. In a table of one row the next document is the row itself. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from batchlens.llm.common import discard, partitions, stage, table
from batchlens.llm.kernels import U64, mix

SLOTS, SEGMENT, KINDS = 256, 4096, 64
#: Steps of a segment that the sample may fall on: two a character.
STEPS = 2 * SEGMENT
#: How often slots of unrelated texts agree: equal hashes of different characters and equal characters.
CHANCE = 0.12
#: Likeness of near duplicates, and the share of pairs just there that no band finds.
LIKENESS, MISSED = 0.85, 0.01
#: How often slots of texts of one language agree by chance, at most, and slots of a band beyond what keeps chance to one partner a text.
ALIKE, BEYOND = 1 / 7, 3

_tables: dict[str, np.ndarray] = {}


def _next_move() -> np.ndarray:
    """For each kind of character and step, the first step from there on at which the walk goes on."""
    if "move" not in _tables:
        n = 3 * STEPS
        bit = (mix(np.arange(KINDS * n, dtype=U64) + U64(0xC6BC279692B5C323)) >> U64(63)).astype(bool).reshape(KINDS, n)
        bit[:, -1] = True
        at = np.where(bit, np.arange(n), n)
        _tables["move"] = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1].astype(np.int32).ravel()
    return _tables["move"]


def _records() -> list[np.ndarray]:
    """For each slot, the steps of successively lower rank: the step it samples in a text is the last of them below the text's steps."""
    if "records" not in _tables:
        draw = np.random.Generator(np.random.PCG64(20240229))
        out = []
        for _ in range(SLOTS):
            at, steps = 1, [0]
            while at < 1 << 44:
                at = int(at / max(draw.random(), 1e-12)) + 1
                steps.append(at - 1)
            out.append(np.array(steps, np.int64))
        _tables["records"] = out
    return _tables["records"]


def fingerprint(texts: list[str]) -> np.ndarray:
    """One row of SLOTS numbers below 16 for each text."""
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    kind = ((code * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    count = -(-size // SEGMENT)
    of = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[of] + nth * SEGMENT
    length = np.minimum(SEGMENT, size[of] - nth * SEGMENT)
    # All segments walk together, longest first, so that those still walking are a prefix.
    order = np.argsort(-length, kind="stable")
    start, length, active = start[order], length[order], len(order)
    move, width = _next_move(), 3 * STEPS
    began = np.zeros(code.size + 1, np.int64)  # segment and step at which each character is entered
    base = np.empty(len(order), np.int64)
    base[:] = order * (1 << 20)
    step = np.zeros(len(order), np.int64)
    still = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), "right")
    kind *= width
    for j in range(int(length[0]) if active else 0):
        active = still[j]
        at = start[:active] + j
        now = step[:active]
        began[at] = base[:active] + now
        step[:active] = np.minimum(move[kind[at] + now] + 1, width - 1)
    ended = np.zeros(len(order), np.int64)
    ended[order] = step
    began = began[:-1]
    # Slots of a text: the step sampled, its segment, and the character the walk is on there.
    total = np.maximum(2 * size, 1)
    steps = np.column_stack([r[np.searchsorted(r, total, "left") - 1] for r in _records()]) if len(texts) else np.zeros((0, SLOTS), np.int64)
    segment, local = steps // STEPS, steps % STEPS
    held = segment < count[:, None]
    segment = np.minimum((np.cumsum(count) - count)[:, None] + segment, max(len(order) - 1, 0))
    symbol = np.zeros(steps.shape, U64)
    if len(order):
        held &= local < ended[segment]
        found = np.searchsorted(began, segment * (1 << 20) + local, "right") - 1
        symbol[held] = code[found[held]].astype(U64) + U64(1)
    return (mix(symbol * U64(SLOTS) + np.arange(SLOTS, dtype=U64)) >> U64(60)).astype(np.uint8)


DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def spelled(prints: np.ndarray) -> list[str]:
    return [row.tobytes().decode() for row in DIGITS[prints]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: the share of equal slots, above what chance gives."""
    return np.clip(((a == b).mean(-1) - CHANCE) / (1 - CHANCE), 0, 1)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following one."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _runs(zip(batch.column("doc_id").to_pylist(), batch.column("text").fill_null("").to_pylist(), strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spelled(fingerprint(texts)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _runs(rows, most: int = 2 << 20):
    """Lists of ids and texts with about `most` characters together."""
    ids, texts, size = [], [], 0
    for doc_id, text in rows:
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _dealt(spark: SparkSession, docs: DataFrame, parts: int) -> DataFrame | None:
    """docs dealt to parts of consecutive ids, descending, each part with the first row of the following one as a guest at its end."""
    low = -(1 << 63)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(low)).alias("key"))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] if parts > 1 else [0.5], 10000)).first()[0]
    if cuts is None:
        return None
    bounds = np.unique(np.array(cuts, np.int64))[::-1] if parts > 1 else np.zeros(0, np.int64)
    ascending = bounds[::-1].copy()

    def number(key: np.ndarray) -> np.ndarray:
        return len(ascending) - np.searchsorted(ascending, key, "left")

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(number(key.to_numpy(np.int64)).astype(np.int32))

    tops = {r["part"]: r["top"] for r in rows.select(part_of("key").alias("part"), "key").groupBy("part").agg(F.max("key").alias("top")).collect()}
    there = sorted(tops)
    before = {p: there[i - 1] for i, p in enumerate(there)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their part, once more as guests where they are; texts are compressed for the shuffle."""
        pack = ZstdCompressor(level=1).compress
        for batch in batches:
            key = batch.column("key").to_numpy()
            own = number(key)
            top = np.array([tops.get(p, low) for p in range(len(ascending) + 1)], np.int64)
            to = np.array([before.get(p, -1) for p in range(len(ascending) + 1)], np.int32)
            guests = np.flatnonzero((key == top[own]) & (to[own] >= 0))
            packed = pa.array([pack(t) for t in batch.column("text").fill_null("").cast(pa.binary()).to_pylist()], pa.binary())
            for at, part, guest in ((np.arange(len(key)), own, 0), (guests, to[own[guests]], 1)):
                if len(at):
                    pick = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick), packed.take(pick), batch.column("key").take(pick), batch.column("tie").take(pick), pa.array(part.astype(np.int32)), pa.array(np.full(len(at), guest, np.int32))], ["doc_id", "packed", "key", "tie", "part", "guest"])

    placed = rows.withColumn("tie", F.xxhash64("text")).mapInArrow(deal, "doc_id long, packed binary, key long, tie long, part int, guest int")
    return placed.repartitionById(max(parts, 1), "part").sortWithinPartitions("part", "guest", F.desc("key"), "tie")


NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the next document in descending id (after the last the first)."""
    dealt = _dealt(spark, docs, max(partitions(spark), 1))
    if dealt is None:
        return spark.createDataFrame([], NEIGHBOURS)

    def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of all but the last row, which is only the next of the one before it."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        prints = fingerprint(texts)
        other = fingerprint(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(spelled(prints[:-1]), pa.string()), pa.array(spelled(other), pa.string()), pa.array(likeness(prints[:-1], other)), pa.array(likeness(prints[:-1], prints[1:])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, now, closed = [], [], 0, None, True
        unpack = ZstdDecompressor().decompress
        for batch in batches:
            for doc_id, packed, part, guest in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), batch.column("part").to_pylist(), batch.column("guest").to_pylist(), strict=True):
                if part != now:
                    ids, texts, size, now, closed = [], [], 0, part, False
                if closed:  # further rows with the id of the first guest
                    continue
                text = unpack(packed).decode()
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if guest or size >= 2 << 20 and len(ids) > 1:
                    yield compared(ids, texts)
                    ids, texts, size, closed = ids[-1:], texts[-1:], len(texts[-1]), bool(guest)

    return dealt.mapInArrow(run, NEIGHBOURS)


def bands(n: int, least: float = LIKENESS) -> tuple[int, int]:
    """How many bands, and slots of each, for n different fingerprints."""
    width = max(1, math.ceil(math.log(max(n, 2)) / -math.log(ALIKE))) + BEYOND
    found = (CHANCE + (1 - CHANCE) * least) ** width
    return math.ceil(math.log(MISSED) / math.log(1 - found)), width


def classes(spark: SparkSession, docs: DataFrame, least: float = LIKENESS) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of docs (doc_id, fingerprint, sid), and per different one its component_id: the least id among documents reached by likenesses of at least `least`.

    Candidates share a band of sampled slots; links are verified on whole fingerprints. Equal fingerprints are one
    class. Only bands that several classes share become postings; these are linked to hubs first and expanded only
    between components.
    """
    from batchlens.llm.jaccard import linked

    prints = stage(spark, fingerprints(docs).withColumn("sid", F.xxhash64("fingerprint")), "edit-prints")
    known = stage(spark, prints.groupBy("sid").agg(F.first("fingerprint").alias("fingerprint"), F.min("doc_id").alias("least")), "edit-classes")
    number, width = bands(known.count(), least)
    draw = np.random.Generator(np.random.PCG64(7))
    slots = [draw.choice(SLOTS, min(width, SLOTS), replace=False) + 1 for _ in range(number)]
    tokens = F.array(*[F.xxhash64(F.lit(b), F.concat(*[F.substring("fingerprint", int(s), 1) for s in row])) for b, row in enumerate(slots)])
    every = known.select(F.explode(tokens).alias("token"), "sid")
    shared = every.groupBy("token").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).filter("x <> y").select("token")
    shared = stage(spark, shared, "edit-shared")
    zero = F.lit(0).cast("long")
    postings = every.join(shared.hint("merge"), "token", "left_semi").select("token", "sid", F.lit(1).cast("long").alias("n"), zero.alias("central"), zero.alias("pos"))
    postings = stage(spark, postings, "edit-bands")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer("".join(s).encode(), np.uint8).reshape(-1, SLOTS) for s in (a, b))
        return pd.Series(likeness(x, y))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (known.select(F.col("sid").alias(k), F.col("fingerprint").alias(f"f{k}")) for k in "ab")
        return pairs.join(a, "a").join(b, "b").filter(alike("fa", "fb") >= least).select("a", "b")

    labels = linked(spark, postings, verified)
    named = known.select("sid", "least").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = stage(spark, named.join(lowest, "label").select("sid", "component_id"), "edit-components")
    discard(spark, known, shared, postings)
    return prints, found


def near_duplicates(spark: SparkSession, docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """doc_id, fingerprint and component_id, the least id among documents reached by likenesses of at least `least`."""
    prints, found = classes(spark, docs, least)
    return prints.join(found, "sid").select("doc_id", "fingerprint", "component_id")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, table(spark, sf_dir, "documents"))
