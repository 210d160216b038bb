"""Packing documents into fixed-length token sequences by a grouping genetic algorithm on islands.

Texts become token ids (a tokenizer file named by the caller), each ends with one end id, and only documents longer
than a sequence are cut, into full pieces and a shorter last one. Full pieces fill a sequence each. All other pieces
are items of a bin packing: they are dealt by hash into blocks of bounded size, and for every block several islands
evolve packings of it. An individual is a list of bins. Each island starts from packings of its own (best fit of items
in decreasing and in disturbed orders). Crossover injects whole well-filled bins of one parent into the other, removes
the other's bins that hold an injected item, and puts the items so displaced back by best fit; mutation dissolves some
of the emptiest bins and some random ones. Items are put back in a decreasing order that is a little disturbed, so that
no two tries are the same. Fewer bins are better, and of as many the more unevenly filled, as room then gathers in few
of them; of packings equal in both one lives. There is no early end: an island goes through all its generations.
After each of `ROUNDS` rounds but the last every island hands its elite to the next one in a ring; its other packings
live on in it. The best packing of a block's islands counts: its well-filled bins stand, and the fuller half of its bins
at least; the others are opened and their items packed again together with those of other blocks, level by level, each
with at most half the bins, until one block is left.

Nulls and odd input: a null or empty text is the end id alone. Null and repeated ids are allowed: pieces are identified
by a row id drawn when the pieces are first written, not by doc_id. Very long texts are cut as said. An empty table
gives an empty result. Extra columns are ignored.

A block holds about `BLOCK` items whatever the input's size, and blocks are dealt by a hash, so a hot source or length
cannot fill one. Only lengths travel; token ids stay in the task that made them, which keeps their checksum. An island
is one row, of four bytes an item and packing, so migration moves whole packings and no item by item tables.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.common import discard, partitions, stage, table
from batchlens.llm.kernels import SPACES, slices, text_bytes

CAPACITY = 4096
END_ID = 1
#: Items of a block, islands that evolve each block, packings of an island, generations of a round, and rounds, between which elites migrate.
BLOCK, ISLANDS, POPULATION, GENERATIONS, ROUNDS = 3000, 3, 8, 20, 3
#: How far the order in which items are put back is disturbed.
DISTURBED = 0.1
#: A bin filled to this share stands; others are opened for the next level.
WELL_FILLED = 0.995
#: Words whose ids a worker keeps.
KEPT_WORDS = 700_000

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


#: ASCII punctuation but the apostrophe: the pattern never joins it to letters before it.
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
#: Kinds of bytes that the pattern tells apart: letters a-z 1, punctuation but the apostrophe 2, all others 0.
KINDS = np.zeros(256, np.uint8)
KINDS[97:123] = 1
KINDS[[*PUNCTUATION]] = 2
#: Lower-case letters of Latin scripts: one code point each in normal form, letters for every version of Unicode.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(shown)))
    return names


class WordIds:
    """Token ids of texts, word by word: ids of a run of non-space bytes do not depend on its neighbours.

    That holds for tokenizers that lower-case, split at white space, drop it, and split letters from punctuation, as
    the one of op8 does; the tests compare with encoding whole texts. So words are also split where a letter a-z and
    punctuation meet (but at apostrophes, and in texts that may have a special token), which leaves fewer different
    ones. Ids of words seen before are kept, up to a bound.
    Words of Latin letters go to the vocabulary's merges directly, all others through the whole tokenizer.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.ids, self.names = Tokenizer.from_file(path), kept, {}, _byte_names()
        self.model = self.tokenizer.model

    def _merged(self, letters: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _one(self, word: bytes) -> bytes:
        found = self.ids.get(word)
        if found is not None:
            return found
        if word.isalpha():  # ASCII letters, which stand for themselves
            found = self._merged(word.lower().decode())
        elif b"<|" not in word:
            stem = word.rstrip(PUNCTUATION)
            if len(stem) < len(word) and (stem[-1:].islower() or LATIN.fullmatch(stem.decode().lower())):
                found = self._one(stem) + self._one(word[len(stem) :])
            elif LATIN.fullmatch(text := word.decode().lower()):
                found = self._merged(text.encode().decode("latin-1").translate(self.names))
        if found is None:
            found = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        self.ids[word] = found
        return found

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; every different word of them is looked up once."""
        if len(self.ids) > self.kept:
            self.ids.clear()
        get, one = self.ids.get, self._one
        special = np.array([b"<|" in x for x in texts], bool)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join([x if as_is else x.lower() for x, as_is in zip(texts, special, strict=True)]), np.uint8)
        starts, inside = np.concatenate(([0], np.cumsum(size))), ~SPACES[data]
        kind = KINDS[data]
        if special.any():
            kind[np.repeat(special, size)] = 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        edge = starts[:-1][size > 0]
        first[edge] = inside[edge]
        begin = np.flatnonzero(first)
        upto = np.concatenate(([0], np.cumsum(inside, dtype=np.int32)))
        offsets = upto[np.append(begin, data.size)].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        letters, at = text_bytes(coded.dictionary)
        letters, at = letters.tobytes(), at.tolist()
        found = [get(word) or one(word) for word in [letters[a:b] for a, b in zip(at, at[1:], strict=False)]]
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        first, ids = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4")
        word = coded.indices.to_numpy()
        length = size[word]
        upto = np.concatenate(([0], np.cumsum(length)))
        place = np.repeat((first[word] - upto[:-1]).astype(np.int32), length)
        place += np.arange(upto[-1], dtype=np.int32)
        ids = ids[place]
        edge = upto[np.searchsorted(begin, starts)]
        for a, b in zip(edge, edge[1:], strict=False):
            yield ids[a:b].tobytes()


_word_ids: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: uid, doc_id, piece, start, length, ids_crc32. Write it before use: uid is drawn anew each time."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _word_ids:
            _word_ids[tokenizer] = WordIds(tokenizer)
        encode, row = _word_ids[tokenizer], TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                out = []
                texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        out.append((row, doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class Packing(list):
    """Bins, lists of items, with the length that each holds, so that it is not added up again for every child."""

    def __init__(self, bins: list[list[int]], fill: list[int]):
        super().__init__(bins)
        self.fill = fill


def _fill(bins: list[list[int]], lengths: list[int]) -> list[int]:
    return bins.fill if isinstance(bins, Packing) else [sum([lengths[i] for i in items]) for items in bins]


def best_fit(bins: list[list[int]], order: list[int], lengths: list[int], capacity: int) -> Packing:
    """The packing with each item of `order` put into the fullest bin that holds it, or a new one. Packings share bins that are equal."""
    bins = Packing(bins, list(_fill(bins, lengths)))
    fill = bins.fill
    # Room and number of each bin in one number, so that the list is searched without tuples.
    room = sorted([capacity - n << 32 | at for at, n in enumerate(fill) if n < capacity])
    for item in order:
        size = lengths[item]
        at = bisect_left(room, size << 32)
        if at < len(room):
            found = room.pop(at)
            b = found & 0xFFFFFFFF
            bins[b] = [*bins[b], item]
            fill[b] += size
            found -= size << 32
        else:
            found = capacity - size << 32 | len(bins)
            bins.append([item])
            fill.append(size)
        if found >> 32:
            insort(room, found)
    return bins


def _decreasing(items: list[int], lengths: list[int], draw: Random, disturbed: float = DISTURBED) -> list[int]:
    """Items by decreasing length, each length taken a little wrong."""
    least, width, some = 1 - disturbed, 2 * disturbed, draw.random
    wrong = [-lengths[i] * (least + width * some()) for i in items]
    return [items[at] for at in sorted(range(len(items)), key=wrong.__getitem__)]


def crossover(one: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, draw: Random) -> Packing:
    """Up to half of the well-filled bins of `other` go whole into `one`; bins of `one` that share an item go, and their other items are put back by best fit."""
    fill = _fill(other, lengths)
    full = sorted(range(len(other)), key=fill.__getitem__, reverse=True)
    chosen = full[: max(1, len(full) // 2)]
    injected = draw.sample(chosen, draw.randint(1, max(1, len(chosen) // 2)))
    inside = {i for b in injected for i in other[b]}
    kept, held, displaced = [], [], []
    for items, n in zip(one, _fill(one, lengths), strict=True):
        if inside.isdisjoint(items):
            kept.append(items)
            held.append(n)
        else:
            displaced += [i for i in items if i not in inside]
    start = Packing(kept + [other[b] for b in injected], held + [fill[b] for b in injected])
    return best_fit(start, _decreasing(displaced, lengths, draw), lengths, capacity)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, draw: Random) -> Packing:
    """Dissolve some of the emptiest bins and some random ones; their items are put back by best fit."""
    fill = _fill(bins, lengths)
    order, most = sorted(range(len(bins)), key=fill.__getitem__), max(1, len(bins) // 20)
    gone = {*order[: draw.randint(1, most)], *draw.sample(order, draw.randint(1, most))}
    items = [i for b in sorted(gone) for i in bins[b]]
    kept = [b for b in range(len(bins)) if b not in gone]
    return best_fit(Packing([bins[b] for b in kept], [fill[b] for b in kept]), _decreasing(items, lengths, draw), lengths, capacity)


def score(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more uneven their fill the better."""
    return len(bins), -sum([n * n for n in _fill(bins, lengths)]) / capacity**2


def inhabitants(lengths: list[int], capacity: int, seed: int, before: list[list[list[int]]] = (), population: int = POPULATION, generations: int = GENERATIONS, down: bool = True) -> tuple[list[list[list[int]]], int]:
    """The packings of an island after some generations, best first, and how many children of crossovers lived on.

    It starts from the packings `before` and, as far as these are fewer than `population`, best fits of its own (one of
    them in decreasing order with `down`, if there are none before).
    """
    draw, lived = Random(seed), 0
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    starts = list(before)
    if down and not starts:
        starts.append(best_fit([], order, lengths, capacity))
    while len(starts) < population:
        starts.append(best_fit([], _decreasing(order, lengths, draw, 0.2), lengths, capacity))
    people: dict[tuple[int, float], list[list[int]]] = {}
    for bins in starts:
        people.setdefault(score(bins, lengths, capacity), bins)
    for _ in range(generations):
        ranks = sorted(people)
        one, other = people[min(draw.choice(ranks), draw.choice(ranks))], people[draw.choice(ranks)]
        children = [crossover(one, other, lengths, capacity, draw), crossover(other, one, lengths, capacity, draw), mutate(one, lengths, capacity, draw)]
        new = {}
        for crossed, bins in zip((True, True, False), children, strict=True):
            rank = score(bins, lengths, capacity)
            if rank not in people:
                people[rank], new[rank] = bins, crossed
        people = {rank: people[rank] for rank in sorted(people)[:population]}
        lived += sum(crossed for rank, crossed in new.items() if rank in people)
    return [people[rank] for rank in sorted(people)], lived


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = (), population: int = POPULATION, generations: int = GENERATIONS, down: bool = True) -> tuple[list[list[int]], int]:
    """The best of the `inhabitants`, and how many children of crossovers lived on."""
    people, lived = inhabitants(lengths, capacity, seed, elites, population, generations, down)
    return people[0], lived


#: `bins` has the bin of each item in each packing of the island, best packing first; n_bins and even are the best's.
STATE = "block long, island int, uids binary, lengths binary, bins binary, n_bins int, even double, crossovers int"
PLACED = "uid long, length long, sequence_id long, offset long, stands boolean, crossovers int"


def _bins(of: np.ndarray) -> list[list[int]]:
    """Lists of items from the bin of each item."""
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def _arrays(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _round(capacity: int, seed: int):
    """One round of every island (a row): from its own packings and the elite that came to it, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, island, uids = row["block"], row["island"], row["uids"]
                lengths = np.frombuffer(row["lengths"], np.int32)
                before = [_bins(of) for c in ("bins", "elite") if row[c] is not None for of in np.frombuffer(row[c], np.int32).reshape(-1, len(lengths))]
                people, lived = inhabitants(lengths.tolist(), capacity, int(np.uint64(block * 1_000_003 + island * 101 + seed)), before, down=not island)
                of = np.empty((len(people), len(lengths)), np.int32)
                for at, found in enumerate(people):
                    for b, items in enumerate(found):
                        of[at, items] = b
                n, even = score(people[0], lengths.tolist(), capacity)
                yield _arrays(STATE, [(block, island, uids, row["lengths"], of.tobytes(), n, even, row["crossovers"] + lived)])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of islands before their first round, from arrays of uids and lengths."""
    for batch in batches:
        rows = [(*ids, np.array(uids, np.int64).tobytes(), np.array(lengths, np.int32).tobytes(), None, 0, 0.0, 0) for *ids, uids, lengths in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        yield _arrays(STATE, rows)


def _opened(capacity: int, everything: bool):
    """The items of packings: their sequence (the least uid in it), place there, and whether the sequence stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uid, length, of = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["bins"], np.int32)
                of = of[: len(uid)]
                used = np.bincount(of, length).astype(np.int64)
                stands = used >= WELL_FILLED * capacity
                stands[np.argsort(-used, kind="stable")[: -(-len(used) // 2)]] = True
                order = np.lexsort((uid, of))
                uid, length, of = uid[order], length[order], of[order]
                first = np.searchsorted(of, np.arange(len(used)))
                upto = np.cumsum(length) - length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), pa.array(length), pa.array(uid[first][of]), pa.array(upto - upto[first][of]), pa.array(stands[of] | everything), pa.array(np.full(len(uid), row["crossovers"], np.int32))],
                    [c.split()[0] for c in PLACED.split(", ")],
                )

    return run


def _solve(spark: SparkSession, items: DataFrame, blocks: int, capacity: int, islands: int, rounds: int, seed: int) -> DataFrame:
    """Pack items (uid, length) block by block: PLACED."""
    dealt = items.groupBy(F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
    start = dealt.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths")).mapInArrow(_blocks, STATE)
    # Each island by itself to a task.
    tasks = max(partitions(spark), min(blocks * islands, spark.sparkContext.defaultParallelism))
    now = start.withColumn("elite", F.lit(None).cast("binary")).repartition(tasks, "block", "island").mapInArrow(_round(capacity, seed), STATE)
    now = stage(spark, now, "pack-islands")
    for turn in range(1, rounds):
        moved = now.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.expr("substring(bins, 1, length(lengths))").alias("elite"))
        before = now
        now = stage(spark, now.join(moved.hint("merge"), ["block", "island"]).select(*now.columns, "elite").repartition(tasks, "block", "island").mapInArrow(_round(capacity, seed + turn * 7919), STATE), "pack-islands")
        discard(spark, before)
    winner = now.groupBy("block").agg(F.min(F.struct("n_bins", "even", "island"))["island"].alias("island"))
    out = stage(spark, now.join(winner, ["block", "island"]).mapInArrow(_opened(capacity, blocks == 1), PLACED), "pack-level")
    discard(spark, now)
    return out


def pack(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """A packing of items (uid unique, length at most capacity): uid, sequence_id (the least uid of the sequence), offset, level, and crossovers, whose children lived on in the island that packed it."""
    done, left, level = None, items.select("uid", "length"), 0
    while n := left.count():
        blocks = -(-n // block)
        solved = _solve(spark, left, blocks, capacity, islands, rounds, seed + level)
        stands = solved.filter("stands").select("uid", "sequence_id", "offset", F.lit(level).alias("level"), "crossovers")
        done = stands if done is None else done.unionByName(stands)
        if blocks == 1:
            break
        left, level = solved.filter("NOT stands").select("uid", "length"), level + 1
    if done is None:
        return items.select("uid", F.col("uid").alias("sequence_id"), F.col("length").alias("offset"), F.lit(0).alias("level"), F.lit(0).alias("crossovers"))
    return done


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset, level and crossovers (null for full pieces)."""
    cut = stage(spark, pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    placed = pack(spark, cut.filter(F.col("length") < capacity), capacity)
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long"), "level": F.lit(None).cast("int"), "crossovers": F.lit(None).cast("int")})
    return full.unionByName(cut.join(placed, "uid")).drop("uid")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
