"""Training-data operators against brute force, exact round trips, held-out accuracy and odd input."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from batchlens.llm import edits, flac, jaccard, licences, lines, mixing, packing, quality, toxicity, warc
from batchlens.session import ship

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = "the of and to in is that for it was on are as with his they at be this from".split()


needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice(["", "x", "yz", "q"]) + str(draw.randint(0, 99)) for _ in range(n))


def docs(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source), with an extra column whose name clashes with an output."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5) for r in rows], DOC)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "a null id"), (4, "one"), (4, "one"), (5, "é ñ ß 中文 😀 ́"), (6, "x" * 70_000), (7, "a b c d e f " * 3_000)]


# Jaccard join


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return sorted((str(d), len(s), low.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_rows(seed):
    draw = random.Random(seed)
    rows = []
    for _ in range(12):
        words = prose(draw, draw.choice([3, 5, 8, 40, 120])).split()
        for _ in range(draw.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = "edit" + str(draw.randint(0, 9))
            rows.append((len(rows) * 3 + 1, " ".join(copy).upper() if draw.random() < 0.2 else " ".join(copy)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = near_rows(seed)
    got = jaccard.components(spark, docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_join_chain_across_hubs(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - 0] if not i else [*base[: 60 - i], *[f"n{i}_{k}" for k in range(i)]])) for i in range(14)]
    got = jaccard.components(spark, docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


@pytest.mark.parametrize("share", [1, 3, 2048])
def test_join_last_turn_meets_all_pairs(spark, monkeypatch, share):
    """Pairs between components of a list, whatever the size of its shares, against all pairs."""
    monkeypatch.setattr(jaccard, "SHARE", share)
    draw = random.Random(9)
    postings = [(token, sid, 40, 0, draw.randrange(3), draw.choice([1, 1, 1, 2, 3, sid + 10]), True) for token in (5, 6, 7) for sid in draw.sample(range(100), 20 * (token - 4))]
    live = jaccard._live(spark, spark.createDataFrame(postings, "token long, sid long, n long, central long, pos long, label long, early boolean"))
    got = [(r["a"], r["b"]) for r in jaccard._cross_pairs(live, 75).collect()]
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in postings for y in postings if x[0] == y[0] and x[5] != y[5]}
    assert sorted(got) == sorted(want)


def test_join_odd_input(spark):
    got = jaccard.components(spark, docs(spark, ODD)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == brute_components(ODD)
    assert jaccard.components(spark, docs(spark, [])).count() == 0


def test_join_keeps_one_of_each_group(spark):
    rows = near_rows(3) + [(2, None), (5, ""), (500, "same text here twice or more"), (500, "same text here twice or more")]
    kept = jaccard.deduplicated(spark, docs(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    want = {c if c is not None else int(d) for d, _, c in brute_components(rows)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_join_keeps_rows_of_repeated_and_null_ids_by_their_text(spark):
    draw = random.Random(21)
    a, b, c, d, e = (prose(draw, 40) for _ in range(5))
    # 7 repeats: one text links to 1, the other to nothing. 8 repeats in one component. Rows without an id link to 1 and to each other.
    rows = [(1, a), (7, a + " more"), (7, b), (7, b), (8, c), (8, c + " more"), (None, a), (None, d), (None, d + " more"), (None, d), (9, e), (None, None), (8, ""), (None, "")]
    kept = jaccard.deduplicated(spark, docs(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:60]) for r in kept.collect())
    assert got == sorted((str(i), t[:60]) for i, t in [(1, a), (7, b), (8, c), (None, d), (9, e), (None, ""), (8, ""), (None, "")])
    assert jaccard.deduplicated(spark, docs(spark, [])).count() == 0


# Mixing


def test_mixing_meets_targets(spark):
    draw = random.Random(4)
    rows = [(i, prose(draw, draw.randint(1, 60)), f"s{i % 5}" if i % 3 else "hot") for i in range(600)]
    rows = [(*r[:2], None if r[0] % 50 == 7 else r[2]) for r in rows]
    found = mixing.mixture(spark, docs(spark, rows)).collect()
    assert len(found) == 600
    by = {}
    for r in found:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
    for (_, target), group in by.items():
        assert abs(sum(r["taken"] for r in group) - target) <= 2
    again = mixing.mixture(spark, docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_mixing_targets_by_refilling(spark):
    sizes = {"a": 5, "b": 100, "c": 400, None: 90}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    weight = dict(zip(["a", "b", "c", None], [1, 2, 3, 1], strict=True))
    left, open_, target = float(sum(sizes.values())), set(sizes), {}
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target |= share
    got = {r["source_size"]: r["target"] for r in mixing.mixture(spark, docs(spark, rows)).collect()}
    assert got == pytest.approx({sizes[s]: t for s, t in target.items()})


def test_mixing_odd_input(spark):
    found = mixing.mixture(spark, docs(spark, ODD)).collect()
    assert len(found) == len(ODD) and all(r["taken"] == 0 for r in found if r["size"] == 0)
    assert mixing.mixture(spark, docs(spark, [])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mixture(spark, docs(spark, [(1, None), (2, "")])).collect())
    mixed = mixing.mix(spark, docs(spark, ODD))
    assert mixed.columns == [c.split()[0] for c in DOC.split(", ")]
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in found)


# Packing


def test_packing_places_and_ids(spark):
    from tokenizers import Tokenizer

    draw = random.Random(5)
    rows = [(i, prose(draw, draw.choice([1, 20, 300, 900, 5000]))) for i in range(60)] + ODD + [(90, "It's they're 'sun <|endoftext|> ÀÉ »q« a\x1cb ½ ≠ \x00!?"), (91, "ﬁ ǅ İ ª x́ ,́ ≮ a,'s")]
    path = packing.tokenizer_path()
    got = packing.pack_documents(spark, docs(spark, rows), path, capacity=512).collect()
    tokenizer, want = Tokenizer.from_file(path), []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(str(doc_id), p, at, len(ids[at : at + 512]), zlib.crc32(np.array(ids[at : at + 512], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 512) + 1
    assert packing.pack_documents(spark, docs(spark, []), path).count() == 0


def test_packing_over_blocks(spark):
    draw = random.Random(6)
    items = spark.createDataFrame([(i, draw.randint(1, 90)) for i in range(900)], "uid long, length long")
    got = packing.pack(spark, items, capacity=100, block=120).join(items, "uid").collect()
    assert len(got) == 900
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert sum(r["crossovers"] for r in got) > 0
    assert max(fill.values()) <= 100 and len(fill) <= 1.04 * math.ceil(sum(fill.values()) / 100)


def test_packing_genetics():
    draw = random.Random(7)
    lengths = [draw.randint(20, 70) for _ in range(80)]
    start = packing.best_fit([], sorted(range(80), key=lambda i: -lengths[i]), lengths, 100)
    other = packing.best_fit([], list(range(80)), lengths, 100)
    for child in (packing.crossover(start, other, lengths, 100, draw), packing.mutate(start, lengths, 100, draw), packing.evolve(lengths, 100, 1)[0]):
        assert sorted(i for items in child for i in items) == list(range(80)) and all(sum(lengths[i] for i in items) <= 100 for items in child)
    assert len(packing.evolve(lengths, 100, 1, [start, other])[0]) <= len(start)


def test_packing_crossover_beats_best_fit():
    """Triplets that fill their bins exactly, which best fit decreasing does not put together again."""
    draw, better, lived = random.Random(23), 0, 0
    for seed in range(8):
        lengths = []
        for _ in range(20):
            a, b = draw.randint(260, 400), draw.randint(260, 330)
            lengths += [a, b, 1000 - a - b]
        plain = packing.best_fit([], sorted(range(60), key=lambda i: (-lengths[i], i)), lengths, 1000)
        found, crossed = packing.evolve(lengths, 1000, seed, generations=40)
        assert packing.score(found, lengths, 1000) <= packing.score(plain, lengths, 1000) and sorted(i for b in found for i in b) == list(range(60))
        better, lived = better + (len(found) < len(plain)), lived + crossed
    assert better >= 4 and lived > 8


def test_packing_evolves_with_its_own_parameters():
    """What the query runs, on prose-like lengths: every block gets better than its best fit in decreasing order."""
    draw, lived = random.Random(29), 0
    for seed in range(4):
        lengths = [min(4095, 1 + int(draw.lognormvariate(6.3, 0.9))) for _ in range(1500)]
        plain = packing.best_fit([], sorted(range(1500), key=lambda i: (-lengths[i], i)), lengths, 4096)
        found, crossed = packing.evolve(lengths, 4096, seed)
        assert packing.score(found, lengths, 4096) < packing.score(plain, lengths, 4096)
        lived += crossed
    assert lived > 24


def test_packing_islands_keep_their_packings(spark):
    """All packings of an island go into its next round, and children of crossovers add up."""
    draw = random.Random(31)
    lengths = [draw.randint(20, 700) for _ in range(300)]
    island = (5, 0, np.arange(300, dtype=np.int64).tobytes(), np.array(lengths, np.int32).tobytes(), None, 0, 0.0, 0)
    counts, best = [], []
    for turn in range(3):
        batch = packing._arrays(packing.STATE, [island])
        batch = batch.append_column("elite", pa.array([island[4] and island[4][:1200]], pa.binary()))
        island = tuple(next(packing._round(1000, turn)(iter([batch]))).to_pylist()[0].values())
        people = [packing._bins(of) for of in np.frombuffer(island[4], np.int32).reshape(-1, 300)]
        scores = [packing.score(bins, lengths, 1000) for bins in people]
        assert len(people) == packing.POPULATION and scores == sorted(set(scores)) and scores[0] == pytest.approx(island[5:7])
        assert all(sorted(i for items in bins for i in items) == list(range(300)) and max(sum(lengths[i] for i in items) for items in bins) <= 1000 for bins in people)
        counts.append(island[7])
        best.append(scores[0])
    assert best == sorted(best, reverse=True) and 0 < counts[0] < counts[1] <= counts[2]


def test_packing_of_items_that_share_no_bin(spark):
    items = spark.createDataFrame([(i, 60 + i % 3) for i in range(500)], "uid long, length long")
    got = packing.pack(spark, items, capacity=100, block=60).collect()
    assert len(got) == 500 == len({r["sequence_id"] for r in got}) and all(r["offset"] == 0 for r in got) and max(r["level"] for r in got) > 1


# Line dedup


def brute_lines(rows):
    texts = {t for _, t in rows if t is not None}
    parsed = {}
    for t in texts:
        for no, raw in enumerate(t.split("\n")):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", raw).strip(" ")
            if line:
                parsed[t, no] = tuple("<*>" if re.search("[0-9]", w) else w for w in line.split(" "))
    leaf = lambda w: (len(w), w[:4])
    in_leaf, of_line, support = {}, {}, {}
    for (t, _), w in parsed.items():
        in_leaf.setdefault(leaf(w), set()).add(t)
        of_line.setdefault(w, set()).add(t)
    for w, held in of_line.items():
        for i, x in enumerate(w):
            support[leaf(w), i, x] = support.get((leaf(w), i, x), 0) + len(held)
    template, recurs = {}, {}
    for w in of_line:
        fixed = tuple((i, x) for i, x in enumerate(w) if x != "<*>" and support[leaf(w), i, x] >= 3)
        if len(in_leaf[leaf(w)]) >= 3 and len(fixed) >= 0.6 * len(w):
            template[w] = (leaf(w), fixed)
            recurs.setdefault(template[w], set()).update(of_line[w])
    gone, total = {}, {}
    for (t, no), w in parsed.items():
        total[t] = total.get(t, 0) + len(w)
        if w in template and len(recurs[template[w]]) >= 3:
            gone.setdefault(t, {})[no] = template[w]
    # Near copies among texts mostly of recurring lines: a class counts once.
    mostly = [t for t in gone if sum(len(parsed[t, no]) for no in gone[t]) > 0.6 * total[t]]
    by = {mostly[int(d)]: c for d, _, c in brute_components(list(enumerate(mostly)))}
    copies = {t: c for t, c in by.items() if list(by.values()).count(c) > 1}
    still = {}
    for t, held in gone.items():
        for tpl in held.values():
            still.setdefault(tpl, set()).add(("class", copies[t]) if t in copies else t)
    out = []
    for doc_id, t in rows:
        drop = {no for no, tpl in gone.get(t, {}).items() if t not in copies or len(still[tpl]) >= 3}
        out.append((str(doc_id), None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in drop)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for i in range(40):
        own = [" ".join(draw.choice("abcdefghijklmnop") * 3 + draw.choice("qrstuv") for _ in range(draw.randint(4, 12))) for _ in range(draw.randint(1, 5))]
        if i % 2:
            own.insert(draw.randint(0, len(own)), f"user number {draw.randint(1, 999)} logged in from host {draw.choice(['alpha', 'beta', 'gamma', 'delta', 'eps'])} today")
        if i % 5 == 0:
            own.append("share this page")
        rows.append((i, "\n".join(own)))
    rows += [(100, rows[1][1]), (101, rows[1][1] + "\none line more"), *ODD]
    body = "\n".join(prose(draw, 12).translate({48 + i: 107 + i for i in range(10)}) for _ in range(12))
    rows += [(200 + i, f"{body}\nshare this page\nend {'abcdef'[i]}") for i in range(6)] + [(210, "share this page"), (211, " share  this page \r")]
    got = lines.cleaned(spark, docs(spark, rows))
    assert got.columns == [c.split()[0] for c in DOC.split(", ")]
    want = brute_lines(rows)
    assert sorted(((str(r["doc_id"]), r["text"]) for r in got.collect()), key=str) == want
    assert any(t is not None and "logged in" not in t for d, t in want if d.isdigit() and int(d) % 2 and int(d) < 40)
    assert [t for d, t in want if d in ("210", "211")] == ["", ""] and all(t == f"{body}\nend {'abcdef'[int(d) - 200]}" for d, t in want if d.isdigit() and 200 <= int(d) < 206)
    assert lines.cleaned(spark, docs(spark, [])).count() == 0


def test_lines_of_a_very_long_text(spark):
    own = [f"line of words {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10 % 10]} {'uvwxyzabcd'[i // 100 % 10]} {'efghijklmn'[i // 1000 % 10]} stands here alone" for i in range(10_000)]
    rows = [(i, "\n".join(x for pair in zip(own[i * 3000 : i * 3000 + 3000], ["the notice of the house"] * 3000, strict=True) for x in pair)) for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in lines.cleaned(spark, docs(spark, rows)).collect()}
    assert got == {d: t for d, t in ((int(d), t) for d, t in brute_lines(rows))} and all("notice" not in t for t in got.values())


def test_lines_mostly_recurring_go_unless_near_copies(spark):
    draw = random.Random(20)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    some = lambda n: " ".join(word() for _ in range(n))
    notice = some(55)
    # Short texts, mostly of a notice; one of nothing else; near copies of one text, with and without the notice.
    rows = [(i, f"{notice}\n{some(30)}") for i in range(6)] + [(10, notice)]
    body, other = "\n".join(some(12) for _ in range(20)), "\n".join(some(60) for _ in range(3))
    rows += [(20 + i, f"{body}\n{some(3)}") for i in range(4)] + [(30 + i, f"{other}\n{notice}\n{some(3)}") for i in range(4)]
    want = {d: "" if d == 10 else t if 20 <= d < 30 else "\n".join(x for x in t.split("\n") if x != notice) for d, t in rows}
    got = {r["doc_id"]: r["text"] for r in corpus_lines(spark, rows)}
    assert got == want
    assert corpus_lines(spark, []) == []


def corpus_lines(spark, rows):
    import corpus_pipeline

    return corpus_pipeline.drop_lines(spark, docs(spark, rows), DIR).collect()


# Edit fingerprints


def test_edit_neighbours(spark):
    draw = random.Random(9)
    rows = [(i * 7 % 101, prose(draw, draw.randint(0, 400))) for i in range(40)] + [(i, t) for i, t in ODD if i is not None and i not in (4,)]
    rows = [(1000 + i, t) for i, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: r for r in edits.neighbours(spark, docs(spark, rows).repartition(3)).collect()}
    down = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(down, down[1:] + down[:1], strict=True):
        text, following, r = text or "", following or "", got[doc_id]
        k = len(text) // 2
        changed = text[: len(text) - k] + following[:k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r["fingerprint"] == edits.spelled(edits.fingerprint([text]))[0] and r["edited_fingerprint"] == edits.spelled(edits.fingerprint([changed]))[0]
    assert edits.neighbours(spark, docs(spark, [])).count() == 0
    assert edits.neighbours(spark, docs(spark, [(5, "alone")])).first()["near_next"] == 1.0
    assert edits.neighbours(spark, docs(spark, ODD)).count() == len(ODD)


def test_edit_walk_equals_plain_walk():
    text = "".join(random.Random(10).choice("abc déñ中") for _ in range(9000))
    move, records = edits._next_move().reshape(edits.KINDS, -1), edits._records()
    emitted = {}
    for part, at in enumerate(range(0, len(text), edits.SEGMENT)):
        step = 0
        for c in text[at : at + edits.SEGMENT]:
            kind = (ord(c) * 2654435761 & 0xFFFFFFFF) >> 26
            until = int(move[kind, step])
            for s in range(step, until + 1):
                emitted[part * edits.STEPS + s if s < edits.STEPS else None] = ord(c) + 1
            step = until + 1
    want = []
    for slot, steps in enumerate(records):
        step = max(int(s) for s in steps if s < 2 * len(text))
        want.append(int(edits.mix(np.array([emitted.get(step, 0) * edits.SLOTS + slot], np.uint64))[0] >> np.uint64(60)))
    assert edits.fingerprint([text])[0].tolist() == want


def test_edit_likeness_follows_edits():
    draw = random.Random(11)
    text = prose(draw, 600)
    few, many = list(text), list(text)
    for changed, n in ((few, 5), (many, 600)):
        for _ in range(n):
            changed.insert(draw.randrange(len(changed)), "z")
    a, b, c, d = edits.fingerprint([text, "".join(few), "".join(many), prose(draw, 600)])
    near, far, other = (float(edits.likeness(a, x)) for x in (b, c, d))
    assert near > 0.8 > far and other < 0.2 and edits.likeness(a, a) == 1


def test_edit_near_duplicates(spark):
    draw = random.Random(12)
    rows = []
    for g in range(8):
        base = prose(draw, 200)
        rows += [(g * 10 + k, base if k < 2 else base[: 50 * k] + "q" + base[50 * k :]) for k in range(4)]
    got = {r["doc_id"]: r["component_id"] for r in edits.near_duplicates(spark, docs(spark, rows)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}
    assert edits.near_duplicates(spark, docs(spark, [])).count() == 0


@needs_tables
def test_edit_near_duplicates_of_a_table_equal_brute_force(spark):
    """Components against likenesses of all pairs: nothing else is linked, and hardly a link is missed."""
    rows = edits.near_duplicates(spark, spark.read.parquet(f"{DIR}/documents.parquet")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    ids = sorted(texts)
    prints = edits.fingerprint([texts[i] for i in ids])
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == dict(zip(ids, edits.spelled(prints), strict=True))
    low, links = {i: i for i in ids}, []
    for i, a in enumerate(ids):
        near = edits.likeness(prints[i + 1 :], prints[i]) >= edits.LIKENESS
        links += [(a, ids[i + 1 + j]) for j in np.flatnonzero(near)]
    for _ in range(len(ids)):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(links) > 5 and all(low[got[i]] == low[i] for i in ids)
    assert sum(got[a] != got[b] for a, b in links) <= max(1, 0.05 * len(links))


# FLAC


def plain_flac(stream):
    """One frame after the other, bit by bit."""
    bits = "".join(f"{b:08b}" for b in stream)
    at = 42 * 8
    out = []

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at], 2) if n else 0

    def signed(n):
        v = take(n)
        return v - (1 << n) if v >> (n - 1) else v

    while at < len(bits):
        assert take(32) == 0xFFF81402
        lead = take(8)
        at += 8 * (0 if lead < 0x80 else 1 if lead < 0xE0 else 2)
        at += 8
        kind = take(8) >> 1
        if kind == 0:
            x = [signed(8)] * 192
        elif kind == 1:
            x = [signed(8) for _ in range(192)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(8) for _ in range(order)]
            coefficients, shift = flac.FIXED_COEFFICIENTS[order] if kind < 32 else (), 0
            if kind >= 32:
                precision = take(4) + 1
                shift = take(5)
                coefficients = [signed(precision) for _ in range(order)]
            assert take(6) == 0
            k = take(4)
            for i in range(order, 192):
                q = 0
                while not take(1):
                    q += 1
                f = q << k | take(k)
                x.append((f >> 1 ^ -(f & 1)) + (sum(c * x[i - 1 - j] for j, c in enumerate(coefficients)) >> shift))
        at = -(-at // 8) * 8 + 16
        out += x
    return bytes(v + 128 for v in out)


def waves():
    rng = np.random.default_rng(13)
    t = np.arange(192 * 200)
    return [rng.integers(0, 256, 192 * 3, dtype=np.uint8), np.full(192, 7, np.uint8), np.tile(np.array([0, 255], np.uint8), 96 * 2), (128 + 100 * np.sin(t / 9)).astype(np.uint8), (t % 256).astype(np.uint8), np.frombuffer(b"plain words and spaces ".ljust(192), np.uint8)]


def test_flac_round_trip():
    raw = waves()
    media = flac.encode(raw)
    assert [x.tobytes() for x in flac.decode(media)] == [x.tobytes() for x in raw]
    assert [plain_flac(m) for m in media[:3] + media[5:]] == [x.tobytes() for x in raw[:3] + raw[5:]]
    assert plain_flac(media[3]) == raw[3].tobytes() and len(media[3]) < 0.8 * len(raw[3])


@pytest.mark.parametrize("place", [60, 100, -1])
def test_flac_refuses_broken_bytes(place):
    media = bytearray(flac.encode(waves()[3:4])[0])
    media[place] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(media)])


def test_flac_partitions():
    """A frame with two Rice partitions, which the encoder itself never writes."""
    x = np.array([i % 5 - 2 for i in range(96)] + [(i * 37) % 101 - 50 for i in range(96)])
    bits = f"{8 << 1:08b}" + "00" + "0001"
    for half, k in ((x[:96], 1), (x[96:], 5)):
        bits += f"{k:04b}"
        for v in half.tolist():
            f = v << 1 if v >= 0 else (-v << 1) - 1
            bits += "0" * (f >> k) + "1" + f"{f & (1 << k) - 1:0{k}b}"
    bits += "0" * (-len(bits) % 8)
    head, size = flac._headers(np.array([0]))
    body = bytes(head[0][: size[0]].astype(np.uint8)) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = flac._crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0]
    samples = x.astype(np.int8).tobytes()
    media = flac._stream_header(samples, len(body) + 2, len(body) + 2) + body + int(crc).to_bytes(2, "big")
    assert flac.decode([media])[0].tobytes() == (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


def test_flac_query_and_blocks(spark):
    got = flac.digests(spark, docs(spark, ODD)).collect()
    want = []
    for doc_id, text in ODD:
        data = (text or "").encode()
        full = data.ljust(max(1, -(-len(data) // 192)) * 192)
        want.append((str(doc_id), len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    long = prose(random.Random(24), 9000)
    media = flac.stored(spark, docs(spark, [(6, long), (8, "short")]))
    assert {r["doc_id"]: flac.decode([r["media"]])[0].tobytes().rstrip() for r in media.collect()} == {6: long.encode(), 8: b"short"}
    pcm = flac.decoded(spark, media, 10)
    blocks = {r["doc_id"]: r["blocks"] for r in pcm.collect()}
    assert b"".join(b["pcm"] for b in blocks[6]).rstrip() == long.encode()
    assert [b["sample_offset"] for b in blocks[6]] == list(range(0, len(long), 1920))
    for start, n in ((0, 100), (1915, 20), (5000, 4000), (len(long) + 5000, 10)):
        assert {r["doc_id"]: bytes(r["samples"]).rstrip() for r in flac.seek(pcm, start, n).collect()} == {6: long.encode()[start : start + n].rstrip(), 8: b"short"[start : start + n]}
    assert flac.digests(spark, docs(spark, [])).count() == 0


# WARC


PAGE = "page_id long, url string, html string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, "clash") for i, h in rows], PAGE)


def test_warc_round_trip(spark, tmp_path):
    draw = random.Random(14)
    rows = [(i, prose(draw, draw.choice([0, 5, 400])) + draw.choice(["", "é😀" * 900, "WARC/1.1\r\n\r\n0\r\n\r\n"])) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(5)] + [(90, None), (91, ""), (None, "no id"), (92, "twice"), (92, "twice")]
    path = f"file://{tmp_path}/warc"
    warc.write(spark, pages(spark, rows).repartition(3), path, segment=700, per_file=7)
    got = warc.read(spark, path).collect()
    least = {}
    for i, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want = []
    for i, h in rows:
        payload = (h or "").encode()
        holder = least.get(h or "")
        response = holder is None or i == holder
        want.append((str(i), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if response else "revisit", None if response else holder, payload if response else None))
    assert all(r["complete"] for r in got) and max(r["segments"] for r in got) > 3
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)


def test_warc_reports_missing_segments(spark, tmp_path):
    path = tmp_path / "broken"
    path.mkdir()
    block = warc.HTTP + warc.chunked(b"payload " * 40)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("X-Page-Id", 1), ("WARC-Payload-Digest", f"sha1:{warc.digest(b'payload ' * 40)}"), ("X-Payload-Length", 320), ("WARC-Segment-Number", 1)]
    third = [("WARC-Type", "continuation"), ("WARC-Record-ID", "<c>"), ("WARC-Segment-Origin-ID", "<a>"), ("WARC-Segment-Number", 3), ("WARC-Segment-Total-Length", len(block))]
    (path / "x.txt").write_bytes(warc.record(fields, block[:100]) + b"\n" + warc.record(third, block[200:]) + b"\n")
    row = warc.read(spark, f"file://{path}").first()
    assert (row["page_id"], row["complete"], row["payload"], row["segments"]) == (1, False, None, 2)
    assert warc.unchunked(warc.chunked(b"abc" * 5000, 7)) == b"abc" * 5000
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_warc_empty(spark, tmp_path):
    warc.write(spark, pages(spark, []), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


# Licences


def brute_scan(files):
    n = len(files)
    split = licences._words
    df = {}
    for _, t in files:
        for w in set(split(t or "")):
            df[w] = df.get(w, 0) + 1
    vocabulary = {w for _, t in licences.TEMPLATES for w in split(t)}
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 if w in vocabulary else math.log(n + 1) + 1
    vector = lambda words: {w: words.count(w) * idf(w) for w in set(words)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    found = []
    for path, text in files:
        best, covered = None, 0
        for line in (text or "").split("\n"):
            v = vector(split(line))
            scores = []
            for name, t in licences.TEMPLATES:
                u = vector(split(t))
                if v:
                    scores.append((-round(sum(v[w] * u.get(w, 0) for w in v) / norm(v) / norm(u), 6), name))
            if scores and -min(scores)[0] >= licences.THRESHOLD:
                covered += len(split(line))
                best = min(best, min(scores)) if best else min(scores)
        found.append((path, best, covered >= 0.5 * max(len(split(text or "")), 1)))
    covers = {}
    for path, best, mostly in found:
        if best and (mostly or re.match(licences.LICENCE_FILE, path.rsplit("/", 1)[-1])):
            d = path.rsplit("/", 1)[0]
            covers[d] = min(covers.get(d, best), best)
    out = []
    for path, best, _ in found:
        d = path.rsplit("/", 1)[0]
        origin = "own" if best else None
        name, score, source = (best[1], -best[0], None) if best else (None, None, None)
        while not best and source is None:
            if d in covers:
                name, origin, source = covers[d][1], "inherited", d
            elif not d:
                break
            d = d.rpartition("/")[0]
        out.append((path, name, score, origin, source))
    return sorted(out)


def test_licences_equal_brute_force(spark):
    draw = random.Random(15)
    rows = []
    for i in range(40):
        text = "\n".join(prose(draw, draw.randint(1, 12)) for _ in range(draw.randint(0, 4)))
        if i % 6 == 0:
            text += "\n" + draw.choice(licences.TEMPLATES)[1] + draw.choice(["", " See notes."])
        rows.append((f"/{draw.choice('abc')}/{draw.choice('xy')}/f{i}", text))
    rows += [("/a/LICENSE", "Some words that are many and are not a notice at all\n" + licences.TEMPLATES[1][1]), ("/b/x/only", licences.TEMPLATES[13][1]), ("/c/none", None), ("/c/x/empty", "")]
    files = spark.createDataFrame([(i, p, t, 1.0) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, score double")
    got = licences.scan(spark, files).collect()
    assert sorted((r["path"], r["licence"], r["score"], r["origin"], r["directory"]) for r in got) == brute_scan(rows)
    long = [("/long/a", prose(draw, 40_000) + "\n" + licences.TEMPLATES[1][1]), ("/long/LICENSE", licences.TEMPLATES[13][1]), ("/long/b", "word " * 50_000)]
    got = licences.scan(spark, spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(long)], "doc_id long, path string, text string")).collect()
    assert sorted((r["path"], r["licence"], r["score"], r["origin"], r["directory"]) for r in got) == brute_scan(long)
    odd = spark.createDataFrame([(None, None, licences.TEMPLATES[0][1]), (1, None, None), (1, None, None)], "doc_id long, path string, text string")
    assert sorted(str(r["licence"]) for r in licences.scan(spark, odd).collect()) == ["AGPL-3.0", "None", "None"]
    assert licences.scan(spark, odd.limit(0)).count() == 0


# Classifiers


def labelled(spark, label):
    draw = random.Random(16)
    bad = ["awful", "nasty", "vile", "foul"]
    rows, marks = [], []
    for i in range(500):
        words = prose(draw, draw.randint(20, 80)).split()
        y = i % 4 == 0
        if y and label == "toxic":
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice(bad))
        if y and label == "quality":
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        marks.append((i, int(y)))
    return rows, spark.createDataFrame(marks, f"doc_id long, {label} int")


@pytest.mark.parametrize(("module", "label", "threshold"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_classifier_on_held_out_documents(spark, module, label, threshold):
    rows, marks = labelled(spark, label)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    score = {r["doc_id"]: r["score"] for r in module.scored(spark, docs(spark, rows), marks).collect()}
    right = sum((score[i] >= threshold) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held) and all(0 <= s <= 1 for s in score.values())
    flipped = marks.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r["doc_id"]: r["score"] for r in module.scored(spark, docs(spark, rows).repartition(3), flipped).collect()}
    assert again == pytest.approx(score)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_odd_input(spark, module, label):
    rows, marks = labelled(spark, label)
    odd = spark.createDataFrame([(None, 1), (7, None)], f"doc_id long, {label} int")
    got = module.scored(spark, docs(spark, rows + ODD), marks.unionByName(odd)).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in module.scored(spark, docs(spark, ODD), marks.limit(0)).collect()} == {0.0}
    assert module.scored(spark, docs(spark, []), marks).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark):
    rows, marks = labelled(spark, "toxic")
    kept = toxicity.clean(spark, docs(spark, rows), marks)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    assert len(ids & {i for i, _ in rows if i % 4}) >= 0.99 * 375 and len(ids & {i for i, _ in rows if i % 4 == 0}) <= 5


def test_statistics_equal_plain_counts():
    texts = ["Ab ab ab, 12 x|y\nAb ab ab, 12 x|y\n\nend.", "", "é"]
    found = quality.statistics(pa.array(texts))
    row = dict(zip(quality.NAMES, found[0], strict=True))
    data = texts[0].encode()
    words = data.split()
    assert row["share_digit"] == pytest.approx(sum(48 <= b < 58 for b in data) / len(data)) and row["words"] == pytest.approx(math.log1p(len(words)))
    assert row["distinct_words"] == pytest.approx(len({w.lower() for w in words}) / len(words)) and row["distinct_lines"] == pytest.approx(2 / 3)
    assert np.isfinite(found).all()


def test_flattened_trees_equal_plain_traversal():
    rng = np.random.default_rng(17)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.boost(x, y, 20)
    score = trees.score(x)
    for i in range(0, 600, 97):
        total = trees.base
        for t in range(20):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + 1 + int(x[i, trees.feature[t, node]] > trees.threshold[t, node])
            total += trees.value[t, node - (2**quality.DEPTH - 1)]
        assert score[i] == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((score > 0.5) == y).mean() > 0.95


def test_boosted_trees_equal_plain_split_search():
    """Each split the best of all cuts between bins of all features, sought row by row."""
    rng = np.random.default_rng(23)
    x = np.column_stack([rng.normal(size=(260, 2)), rng.integers(0, 4, 260)])
    y = ((x[:, 0] + 0.5 * x[:, 2] + rng.normal(scale=0.4, size=260)) > 0.6).astype(float)
    trees = quality.boost(x, y, 3)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(3)]
    total = np.full(260, math.log(y.mean() / (1 - y.mean())))

    def gain(g, h):
        return sum(g) ** 2 / (sum(h) + quality.SMOOTH)

    def grow(rows, g, h, depth, out):
        best = None
        for f in range(3) if depth else ():
            for cut in edges[f]:
                low, high = [i for i in rows if x[i, f] <= cut], [i for i in rows if x[i, f] > cut]
                if min(len(low), len(high)) >= quality.LEAST:
                    found = gain(g[low], h[low]) + gain(g[high], h[high]) - gain(g[rows], h[rows])
                    if found > 1e-9 and (best is None or found > best[0] + 1e-9):
                        best = found, low, high
        if best is None:
            out[rows] = -quality.RATE * sum(g[rows]) / (sum(h[rows]) + quality.SMOOTH)
            return
        for part in best[1:]:
            grow(part, g, h, depth - 1, out)

    for _ in range(3):
        p = 1 / (1 + np.exp(-total))
        step = np.zeros(260)
        grow(list(range(260)), p - y, p * (1 - p), quality.DEPTH, step)
        total += step
    assert trees.score(x) == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


# Queries and pipeline on the driver's tables


@needs_tables
@pytest.mark.parametrize("name", ["op2_warc", "op3_licence_scan", "op7_mixing", "op9_jaccard_join", "op10_line_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    from batchlens.llm import queries

    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{DIR}/{table}.parquet')")
    ours = queries.queries()[name](spark, DIR)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    order = sorted(set(names))
    assert order == sorted(ours.columns)
    want = sorted(json.dumps([dict(zip(names, r, strict=True))[c] for c in order]) for r in cursor.fetchall())
    assert sorted(json.dumps([r[c] for c in order]) for r in ours.collect()) == want


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline
    from batchlens.llm.common import stage, table

    before = table(spark, DIR, "documents")
    columns = before.columns
    for name, function in corpus_pipeline.STAGES:
        after = stage(spark, function(spark, before, DIR), "test")
        if name != "packing":
            assert after.columns == columns
        if name in ("toxicity", "near_copies"):
            assert after.exceptAll(before).count() == 0 and after.count() > 0.7 * before.count()
        if name == "line_dedup":
            assert after.count() == before.count()
        if name == "near_copies":
            ids = jaccard.components(spark, before).select("doc_id", "component_id").collect()
            assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in ids}
        if name == "mixing":
            assert after.select(columns).distinct().exceptAll(before.distinct()).count() == 0
        if name == "packing":
            assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        before = after


def test_components_of_links(spark):
    draw = random.Random(18)
    links = [(draw.randint(0, 120), draw.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)]
    label = {x: x for pair in links for x in pair}
    for _ in range(300):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    label = {x: y for x, y in label.items() if any(x in pair and pair[0] != pair[1] for pair in links)}
    links = [(a, b) for a, b in links if a != b]
    got = jaccard.connected(spark, spark.createDataFrame(links, "a long, b long"))
    assert {r["sid"]: r["label"] for r in got.collect()} == label


def test_words_are_looked_up_without_punctuation():
    """A word is looked up once, whatever punctuation follows or precedes it; ids are those of whole texts."""
    encode = packing.WordIds(packing.tokenizer_path())
    texts = ["Word, word. (word) word! a-word", "it's. 's-x it's.'d x'.s", "caf\u00e9, e\u0301. <a|>", " \t", "", "Word.<|endoftext|>word, word."]
    whole = [np.array(encode.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(encode([texts[0].encode()])) == whole[:1]
    assert set(encode.ids) == {b"word", b",", b".", b"(", b")", b"!", b"a", b"-"}
    assert list(encode([x.encode() for x in texts])) == whole
    draw = random.Random(21)
    letters = [*"aabzAZ09 \t\n\x0b.,-'()<|>_*&", "'s", "'re", "\u00e9", "e\u0301", "\u00c9", "\u00a0", "\u00df", "\u65e5", "<|endoftext|>", "\u0130"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(500)]
    assert list(encode([x.encode() for x in texts])) == [np.array(encode.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_few_links_are_labelled_in_few_jobs_and_many_by_stars(spark):
    """A long chain of links takes no round of joins for each doubling; past the bound the joins give the same."""
    draw = random.Random(19)
    chain = draw.sample(range(-500, 500), 300)
    links = list(zip(chain, chain[1:], strict=False)) + [(2000, i) for i in range(1000, 1100)] + [(7, 7)]
    want = dict.fromkeys(chain, min(chain)) | dict.fromkeys(range(1000, 1100), 1000) | {2000: 1000}
    found = jaccard.stage(spark, spark.createDataFrame(links, "a long, b long"), "test")
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        labels = jaccard.connected(spark, found)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 4, jobs
    assert {r["sid"]: r["label"] for r in labels.collect()} == want
    assert {r["sid"]: r["label"] for r in jaccard.connected(spark, found, 40).collect()} == want
    assert jaccard.connected(spark, found.filter("a > 9999")).count() == 0


def test_ftrl_equals_plain_updates():
    """FTRL-proximal one coordinate at a time, with scalars in dictionaries."""
    draw = random.Random(5)
    documents = [(label, sorted(draw.sample(range(40 * label, 40 * label + 60), draw.randrange(0, 25)))) for label in (draw.randrange(2) for _ in range(300))]
    weights, bias = toxicity.ftrl([(label, np.array(found, np.int32)) for label, found in documents], bits=7, epochs=3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for label, found in documents:
            at = [*found, "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    assert weights == pytest.approx([weight(i) for i in range(128)], abs=1e-9) and bias == pytest.approx(weight("bias"), abs=1e-9)
    assert 0 < np.count_nonzero(weights) < 100
