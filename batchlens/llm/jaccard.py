"""N-gram Jaccard join by rare-first prefix filtering, and the components of its links.

A document's set is its distinct shingles of `size` words (kernels.shingle_sets); two link when their Jaccard
similarity reaches `percent` / 100. Equal sets form one class, and classes are joined instead of documents.

1. Every set is cut by shingle hash into parts of bounded size (`PART` bytes on average, each a task of its own); a part
   counts the documents (classes) of each of its shingles, so the counts cover all documents. Shingles of one class can
   join nothing and go no further than their number.
2. A class orders its shingles rarest first. If two sets link, their prefixes of n - ceil(t * n) + 1 shingles share
   one, so only prefix shingles that another class has become postings.
3. Candidates come from equal postings, pass the length and positional filters, and each pair once the suffix filter
   and the exact check. In turns, each posting list first only proposes links to hubs (one of every `HUB` members), which is
   linear in the list. Their links give components. When turns join no more, all pairs of a list whose ends are still in
   different components are proposed; pairs inside a component could change nothing. Nothing is capped, and lists inside
   one component are not expanded. Long lists are salted over tasks.
4. Components are found by stars of links: task by task, then in one task as far as they are few (`TOGETHER`), else by
   large and small stars over tables.

Nulls and odd input: a document with null, empty or blank text has an empty set, links with nothing and is its own
component; null ids are allowed (a component's id is the least id that is not null). Rows with equal texts are linked.
Very long texts are taken whole. An empty table gives an empty result. Extra columns are ignored by `components`.
Shingles and sets are held as 64-bit hashes throughout, the exact check included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.common import discard, partitions, stage, table
from batchlens.llm.kernels import U64, mix, shingle_sets, slices

SIZE, PERCENT = 5, 75
#: Members of a posting list for each hub, and of a salted share of a long list.
HUB, SHARE = 512, 2048
#: Bytes of shingles of a part.
PART = 32 << 20
#: Links that one task takes: as many as that are labelled there, of more each task only makes a forest of its own.
TOGETHER = 1 << 20


def _signature(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, from its size and the sum of its shingles' mixed hashes; 0 for the empty set."""
    total = np.zeros(len(counts) + 1, U64)
    upto = np.concatenate(([U64(0)], np.cumsum(mix(values ^ U64(0x5851F42D4C957F2D)), dtype=U64)))
    edge = np.concatenate(([0], np.cumsum(counts)))
    total = mix(upto[edge[1:]] - upto[edge[:-1]] + counts.astype(U64) * U64(0x9E3779B97F4A7C15))
    return np.where(counts > 0, total, U64(0)).view(np.int64)


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles and the class (signature of the set) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 3 << 20):
                values, counts = shingle_sets(batch.column("text"), size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(_signature(values, counts))], ["doc_id", "n_shingles", "sid"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sid long")


PARTED = "part int, sids binary, sizes binary, counts binary, values binary"


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours start, and their lengths."""
    if not owner.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return new, np.diff(np.append(new, owner.size))


def _blobs(schema: str, columns: list[list]) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(columns)], names)


def _streamed(batches: Iterator[pa.RecordBatch], finish) -> Iterator[pa.RecordBatch]:
    """Call finish with the key and rows of each run of equal keys (the first column) of sorted batches."""
    now, rows = None, []
    for batch in batches:
        for key, *blobs in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if key != now and rows:
                yield from finish(now, rows)
                rows = []
            now = key
            rows.append(blobs)
    if rows:
        yield from finish(now, rows)


def _parted(docs: DataFrame, parts: int, size: int) -> DataFrame:
    """Shingles of all documents by part: for each part and slice of rows, the classes, their set sizes, how many shingles each has here, and the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", min(max(3 << 20, parts << 14), 16 << 20)):
                values, counts = shingle_sets(batch.column("text"), size)
                if not values.size:
                    continue
                sids = _signature(values, counts)
                _, first = np.unique(sids, return_index=True)
                keep = np.zeros(len(counts), bool)
                keep[first] = True
                owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                chosen = keep[owner]
                values, owner = values[chosen], owner[chosen]
                part = ((values >> U64(40)) % U64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                values, owner, part = values[order], owner[order], part[order]
                edge = np.searchsorted(part, np.arange(parts + 1))
                rows: list[list] = [[] for _ in range(5)]
                for p in np.flatnonzero(np.diff(edge)):
                    a, b = edge[p], edge[p + 1]
                    new, lengths = _runs(owner[a:b])
                    own = owner[a:b][new]
                    for column, value in zip(rows, (int(p), sids[own].tobytes(), counts[own].astype(np.uint32).tobytes(), lengths.astype(np.uint32).tobytes(), values[a:b].tobytes()), strict=True):
                        column.append(value)
                yield _blobs(PARTED, rows)

    return docs.select("text").mapInArrow(run, PARTED)


SHARED = "bucket int, sids binary, sizes binary, counts binary, tokens binary, df binary"


def _shared(parted: DataFrame, buckets: int) -> DataFrame:
    """Of every part the shingles that more than one class has, with the number of classes, by bucket of their class."""

    def finish(part: int, rows: list[list]) -> Iterator[pa.RecordBatch]:
        sids, sizes, counts = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in ((0, np.int64), (1, np.uint32), (2, np.uint32)))
        value = np.concatenate([np.frombuffer(r[3], U64) for r in rows])
        # A class that several slices sent is kept once.
        _, first = np.unique(sids, return_index=True)
        once = np.zeros(len(sids), bool)
        once[first] = True
        keep = np.repeat(once, counts)
        value, owner = value[keep], np.repeat(np.arange(len(sids)), counts)[keep]
        order = np.argsort(value, kind="stable")
        new, runs = _runs(value[order])
        df = np.empty(value.size, np.int64)
        df[order] = np.repeat(runs, runs)
        common = df > 1
        value, owner, df = value[common], owner[common], np.minimum(df[common], 65535).astype(np.uint16)
        bucket = (sids[owner] % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        value, owner, df, bucket = value[order], owner[order], df[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        out: list[list] = [[] for _ in range(6)]
        for k in np.flatnonzero(np.diff(edge)):
            a, b = edge[k], edge[k + 1]
            new, lengths = _runs(owner[a:b])
            own = owner[a:b][new]
            for column, x in zip(out, (int(k), sids[own].tobytes(), sizes[own].tobytes(), lengths.astype(np.uint32).tobytes(), value[a:b].tobytes(), df[a:b].tobytes()), strict=True):
                column.append(x)
        yield _blobs(SHARED, out)

    return parted.mapInArrow(lambda batches: _streamed(batches, finish), SHARED)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _taken(n: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """How many shared shingles are in the prefix of sets of n shingles; none if they are too few to link with any set."""
    take = np.clip(n - _needed(n, percent) + 1 - (n - shared), 0, shared)
    return np.where(shared < _needed(n, percent), 0, take)


def _members(shared: DataFrame, percent: int) -> DataFrame:
    """Per class whose prefix has shared shingles: sid, n (its set's size), central (how shared its shingles are on average) and its shared shingles rarest first."""

    def finish(_: int, rows: list[list]) -> Iterator[pa.RecordBatch]:
        sids, sizes, counts, tokens, df = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.int64, np.uint32, np.uint32, np.int64, np.uint16)))
        names, first, owner = np.unique(sids, return_index=True, return_inverse=True)
        owner = np.repeat(owner, counts)
        chosen = _taken(sizes[first].astype(np.int64), np.bincount(owner, minlength=len(names)), percent) > 0
        keep = chosen[owner]
        names, first, tokens, df, owner = names[chosen], first[chosen], tokens[keep], df[keep], (np.cumsum(chosen) - 1)[owner[keep]]
        order = np.lexsort((tokens, df, owner))
        tokens, edge = tokens[order], np.searchsorted(owner[order], np.arange(len(names) + 1))
        n = sizes[first].astype(np.int64)
        central = np.bincount(owner, df, len(names)).astype(np.int64) * 1000 // np.maximum(n, 1)
        for at in range(0, len(names), 2000):
            to = min(at + 2000, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names[at:to]), pa.array(n[at:to]), pa.array(central[at:to]), pa.array([tokens[edge[i] : edge[i + 1]].tobytes() for i in range(at, to)], pa.binary())], ["sid", "n", "central", "tokens"])

    return shared.mapInArrow(lambda batches: _streamed(batches, finish), "sid long, n long, central long, tokens binary")


def _postings(members: DataFrame, percent: int) -> DataFrame:
    """Prefix shingles that another class has: token, sid, n, central, pos (place in the rarest-first order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n = batch.column("sid").to_numpy(), batch.column("n").to_numpy()
            tokens = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
            shared = np.array([len(x) for x in tokens], np.int64)
            alone = n - shared
            take = _taken(n, shared, percent)
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[:k] for x, k in zip(tokens, take, strict=True)]) if len(tokens) else np.zeros(0, np.int64)), pa.array(np.repeat(sid, take)), pa.array(np.repeat(n, take)), pa.array(np.repeat(batch.column("central").to_numpy(), take)), pa.array(np.repeat(alone, take) + at)], ["token", "sid", "n", "central", "pos"]
            )

    return members.mapInArrow(run, "token long, sid long, n long, central long, pos long")


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs of rows (a, na, pa, b, nb, pb) that pass the length and positional filters."""
    long_enough = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    # Of a pair that links, the first common shingle has nothing in common before it and at most the shorter rest after
    # it. So it is enough to keep the rows that could be that first one.
    bound = 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    possible = F.lit(100 + percent) * bound >= F.lit(percent) * (F.col("na") + F.col("nb"))
    swap = F.col("a") > F.col("b")
    return joined.filter(long_enough & possible).select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")).distinct()


def _verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs that link: the suffix filter (shared counts of hash ranges) and then the exact overlap of the two sets."""
    left = members.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = members.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                need = -(-percent * int(na[i] + nb[i]) // (100 + percent))
                if min(len(x), len(y)) < need:
                    continue
                if np.minimum(np.bincount(x & 63, minlength=64), np.bincount(y & 63, minlength=64)).sum() < need:
                    continue
                keep[i] = len(np.intersect1d(x, y)) >= need
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return joined.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of links (a, b), ascending, and the least end that each reaches."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label, (x, y) = np.arange(len(names)), at.reshape(2, -1)
    while True:
        x, y = label[x], label[y]
        apart = x != y
        if not apart.any():
            return names, names[label]
        x, y = x[apart], y[apart]
        # Each root goes to the least root that it has a link to, and all follow to where that ends.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _contracted(together: int, loops: bool):
    """Links as stars around least ends, for every `together` links of a task; with `loops`, roots get a row too."""

    def stars(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        names, least = _stars(*[np.concatenate([batch.column(c).to_numpy() for batch in rows]) for c in ("a", "b")])
        keep = (names != least) | loops
        return pa.RecordBatch.from_arrays([pa.array(least[keep]), pa.array(names[keep])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            if rows and n + batch.num_rows > together:
                yield stars(rows)
                rows, n = [], 0
            rows.append(batch)
            n += batch.num_rows
        if rows:
            yield stars(rows)

    return run


def connected(spark: SparkSession, links: DataFrame, together: int = TOGETHER) -> DataFrame:
    """sid and label (the least sid reachable) of every end of links (a, b). Links are read twice, so they are best written before.

    Tasks turn their links into stars first, which have fewer rows than ends. Up to `together` links are then labelled
    in one task. More are joined: large stars move a node's larger neighbours to the least of its neighbourhood, small
    stars its smaller ones and itself, in turn, until the links are stars around the least sid. The least neighbours are
    written before they are joined, so that the join of a node with very many links can be split.
    """
    edges = links.filter("a <> b").select("a", "b").mapInArrow(_contracted(together, False), "a long, b long")
    few = links.count() <= together
    if not few:
        edges = stage(spark, edges.distinct(), "join-links")
        few = edges.count() <= together
    if few:
        labels = edges.repartition(1).mapInArrow(_contracted(2 * together, True), "a long, b long")
        return stage(spark, labels.select(F.col("b").alias("sid"), F.col("a").alias("label")), "join-labels")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == before:
            return stage(spark, edges.select(F.col("b").alias("sid"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("sid"), F.col("a").alias("label"))).distinct(), "join-labels")
        # Of each smaller end, the least of itself and its neighbours.
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        near = stage(spark, near.select("a", F.least("a", "b").alias("to")), "join-least")
        large = stage(spark, edges.join(near, "a").select(F.col("to").alias("a"), "b").distinct(), "join-large")
        least = stage(spark, large.groupBy("b").agg(F.min("a").alias("to")), "join-small")
        small = large.join(least, "b").filter("a <> to").select(F.col("to").alias("a"), F.col("a").alias("b"))
        after = stage(spark, small.unionByName(least.select(F.col("to").alias("a"), "b")).distinct(), "join-links")
        discard(spark, edges, near, large, least)
        edges, before = after, state


def _named(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component of each member; without labels every class is its own."""
    if labels is None:
        return postings.withColumn("label", F.col("sid"))
    return postings.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _live(spark: SparkSession, named: DataFrame) -> DataFrame:
    """Postings of lists that more than one component has and that can propose a pair: with members, main (the largest component) and main_size.

    The smaller set of a pair has its first common shingle within what an equally large partner leaves it, so a list
    needs a member that close to its own beginning (`early`).
    """
    parts = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("size"), F.max("early").alias("early"))
    lists = parts.groupBy("token").agg(F.sum("size").alias("members"), F.max(F.struct("size", "label")).alias("m"), F.count(F.lit(1)).alias("components"), F.max("early").alias("any_early"))
    # Written, so that the join of a very long list can be split.
    lists = stage(spark, lists.filter("components > 1 AND any_early").select("token", "members", F.col("m.label").alias("main"), F.col("m.size").alias("main_size")), "join-lists")
    return stage(spark, named.join(lists, "token"), "join-live")


def _hub_pairs(live: DataFrame, percent: int, turn: int = 0) -> DataFrame:
    """Members of a posting list against the hub of their share, and hubs against the list's first hub, where components differ.

    The first turn's hubs are the members whose shingles are shared most, which near copies of one text have in
    common; later turns' are random ones.
    """
    weight = F.col("central") if turn == 0 else F.xxhash64("sid", F.lit(turn))
    dealt = live.withColumn("share", F.pmod(F.xxhash64("sid"), F.ceil(F.col("members") / HUB))).withColumn("weight", weight)
    hubs = dealt.groupBy("token", "share").agg(F.max(F.struct("weight", "sid", "n", "pos", "label")).alias("h"))
    hubs = hubs.select("token", "share", F.col("h.weight").alias("wb"), F.col("h.sid").alias("b"), F.col("h.n").alias("nb"), F.col("h.pos").alias("pb"), F.col("h.label").alias("lb"))
    near = dealt.select("token", "share", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la")).join(hubs.drop("wb"), ["token", "share"])
    heads = hubs.groupBy("token").agg(F.max(F.struct("wb", "b", "nb", "pb", "lb")).alias("h")).select("token", F.col("h.b").alias("a"), F.col("h.nb").alias("na"), F.col("h.pb").alias("pa"), F.col("h.lb").alias("la"))
    far = hubs.select("token", "b", "nb", "pb", "lb").join(heads, "token")
    columns = ["a", "na", "pa", "la", "b", "nb", "pb", "lb"]
    return _pairs(near.select(columns).unionByName(far.select(columns)).filter("la <> lb"), percent)


def _cross_pairs(live: DataFrame, percent: int) -> DataFrame:
    """All pairs of posting lists between different components: those outside a list's largest component against all.

    Both sides are dealt into shares, and each share of one meets each of the other on its own, so that a (token, share,
    turn) holds about `SHARE` members of either side however long the list or its part outside the largest component is.
    """
    outside = F.col("members") - F.col("main_size")
    mixed = live.withColumn("shares", F.ceil(F.col("members") / SHARE)).withColumn("turns", F.ceil(outside / SHARE))
    dealt = lambda seed, into: F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(into))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    probe = mixed.select("token", dealt(0, "shares").alias("share"), every("turns").alias("turn"), F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"), (F.col("label") == F.col("main")).alias("ma"))
    build = mixed.filter("label <> main").select("token", every("shares").alias("share"), dealt(1, "turns").alias("turn"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
    # The filters are part of the join, so that pairs that fail are never rows.
    joined = probe.join(build, ["token", "share", "turn"]).filter((F.col("la") != F.col("lb")) & (F.col("ma") | (F.col("a") < F.col("b"))))
    return _pairs(joined, percent)


def linked(spark: SparkSession, postings: DataFrame, verify, percent: int = PERCENT) -> DataFrame:
    """Components (sid, label) of classes whose posting lists (token, sid, n, central, pos) propose pairs that verify (pairs -> links) confirms.

    Hub turns go on while far more pairs than postings would be left to compare and each turn takes away a good part of
    them; then all pairs that are left between components are compared.
    """
    early = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    live, labels, found, pairs, turn = postings.withColumn("early", early), None, None, None, 0
    columns = live.columns
    while True:
        old, live = live, _live(spark, _named(live.select(columns), labels))
        if turn:
            discard(spark, old)
        rows, left = live.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("label") != F.col("main"), F.col("members"))), F.lit(0))).first()
        before, pairs = pairs, left
        last = pairs <= 2 * rows or before is not None and pairs > 0.8 * before
        links = stage(spark, verify(_cross_pairs(live, percent) if last else _hub_pairs(live, percent, turn)), "join-found")
        found = links if found is None else found.unionByName(links)
        labels = connected(spark, found)
        turn += 1
        if last:
            break
    discard(spark, live)
    return labels


def components(spark: SparkSession, docs: DataFrame, size: int = SIZE, percent: int = PERCENT, named: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable by links) and class_id (equal sets); with `named`, also the component's label, a class of it."""
    signed = stage(spark, signatures(docs, size), "join-signed")
    classes = stage(spark, signed.filter("n_shingles > 0").groupBy("sid").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("least")), "join-classes")
    shingles = signed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(partitions(spark), -(-8 * shingles // PART), 1)
    parted = _parted(docs, parts, size).repartitionById(parts, "part").sortWithinPartitions("part")
    shared = _shared(parted, parts).repartitionById(parts, "bucket").sortWithinPartitions("bucket")
    members = stage(spark, _members(shared, percent), "join-members")
    postings = stage(spark, _postings(members, percent), "join-postings")
    labels = linked(spark, postings, lambda pairs: _verified(pairs, members, percent), percent)
    known = classes.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    lowest = known.groupBy("label").agg(F.min("least").alias("component_id"))
    label = ["label"] if named else []
    found = stage(spark, known.join(lowest, "label").select("sid", "component_id", *label), "join-components")
    out = signed.join(found, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("sid")).alias("class_id"), *label)
    discard(spark, members, postings, classes)
    return out


def deduplicated(spark: SparkSession, docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, one with the least doc_id; of rows that tie, one that is first by text in one class.

    Rows are kept or go by their own set, also where a doc_id is null or repeats with other texts. A component of rows
    without a doc_id keeps one of them. Rows with an empty set are linked with nothing and all stay.
    """
    found = stage(spark, components(spark, docs, size, percent, named=True), "join-rows")
    goes = found.filter("doc_id IS NOT NULL AND component_id <> doc_id").select(F.col("doc_id").alias("__join_goes"))
    odd = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias("__join_goes"))
    odd = stage(spark, odd, "join-repeated")
    goes = stage(spark, goes.unionByName(odd).distinct(), "join-goes")
    # Both sides grow with the corpus, so the join is a sort-merge join at every size.
    once = docs.filter("doc_id IS NOT NULL").join(goes.hint("merge"), docs["doc_id"] == F.col("__join_goes"), "left_anti")
    # A null or repeated doc_id does not tell a row's set; its text does.
    many = docs.join(odd, docs["doc_id"] == F.col("__join_goes"), "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    many = stage(spark, many.withColumn("__join_text", F.xxhash64("text")), "join-odd")
    texts = many.groupBy("__join_text").agg(F.first("text").alias("text")).select(F.col("__join_text").alias("doc_id"), "text")
    own = stage(spark, signatures(texts, size).select(F.col("doc_id").alias("__join_text"), F.col("n_shingles").alias("__join_n"), F.col("sid").alias("__join_sid")), "join-own")
    many = many.join(own, "__join_text")
    first = found.filter("class_id IS NOT NULL AND doc_id <=> component_id").groupBy("label").agg(F.min("class_id").alias("__join_sid"), F.first("component_id").alias("__join_first"))
    first = many.join(stage(spark, first.drop("label"), "join-first"), "__join_sid").filter("doc_id <=> __join_first")
    first = first.groupBy("__join_sid").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "text").alias("__join_row")).select("__join_row.*")
    return once.unionByName(many.filter("__join_n = 0").select(*docs.columns)).unionByName(first)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
      ELSE list_transform(range(1, len(t) - 3), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2] || ' ' || t[i+3] || ' ' || t[i+4]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL
"""
