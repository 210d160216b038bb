"""Line dedup by a fixed-depth log-template tree.

Every line is parsed down a tree of fixed depth: its number of words, then its first `DEPTH` words, where a word with a
digit is variable. Lines that reach the same leaf share a template tree node; inside a leaf, a word at a place is
constant if at least `MIN_DOCS` texts have it there, otherwise that place is a variable field. A line's template is its
words with variable fields generalised. That gives each leaf its templates without an order of arrival, so it is the
same however the lines are partitioned. A template recurs if at least `MIN_DOCS` different texts have lines of it and
at least `CONSTANT` of its places are constant. Lines of recurring templates are dropped.

Equal texts count as one, so copies of a document do not make its lines recur. Nor do near copies: texts with more than
`MOSTLY` of their words in recurring lines are put into classes by the n-gram Jaccard join. The texts of a class of
several count as one, and they lose only the lines whose templates recur even so. Any other text loses all its recurring
lines, whatever their share; if it has no others, its text is left empty and its row stays.

Nulls and odd input: a null text stays null and has no lines; lines without words are kept; null and repeated ids are
allowed, as rows are told apart by their text. Very long texts are taken whole. An empty table gives an empty result.
Extra columns pass through `cleaned`; working columns have names starting with `__line_`.

Lines are parsed once, a batch of texts at a time, into hashes (64 bits; texts by 96 bits and their number of lines).
Only lines whose leaf several texts reach go on, and of those one example of each is spelled out. Counts are aggregated
before they are shuffled, and a template with one line that enough texts have is known to recur without joining its
texts. Joins of tables that grow with the corpus are sort-merge joins at every size. Both sides are written before, as
the engine splits the partition of a hot key only where a join reads nothing but exchanges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm import jaccard
from batchlens.llm.common import discard, stage, table
from batchlens.llm.kernels import EXACT, ROOT, U64, mix, powers, slices, text_bytes, word_hashes, words

DEPTH, MIN_DOCS, CONSTANT, MOSTLY = 4, 3, 0.6, 0.6
GAP = "[\\x20\\x09-\\x0D]+"
VARIABLE = "<*>"
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True

#: A line with words: its text (two hashes), its number there, its words and the text's, its leaf and its own hash.
PARSED = "text long, more int, no int, words int, total int, leaf long, line long"


def parsed(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """All lines with words of all texts, as PARSED. Words with a digit hash like the variable word; the leaf is of the number of words and the first `depth`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.frombuffer(VARIABLE.encode(), np.uint8)
        variable = word_hashes(mark, np.array([0]), np.array([mark.size]), EXACT)[0]
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                data, starts = text_bytes(batch.column("text"))
                begin, end, counts = words(data, starts)
                if not begin.size:
                    continue
                hashed = word_hashes(data, begin, end, EXACT)
                digits = np.concatenate(([0], np.cumsum(DIGITS[data], dtype=np.int32)))
                hashed[digits[end] > digits[begin]] = variable
                feeds = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int32)))
                owner = np.repeat(np.arange(len(counts)), counts)
                at = feeds[begin]
                first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
                size = np.diff(np.append(first, at.size))
                place = np.arange(at.size) - np.repeat(first, size)
                power = powers(int(size.max()))[0]
                weighted = hashed * power[place]
                line = mix(np.add.reduceat(weighted, first) + size.astype(U64))
                leaf = mix(np.add.reduceat(np.where(place < depth, weighted, U64(0)), first) + size.astype(U64) * U64(ROOT))
                text = owner[first]
                columns = [batch.column("key").take(pa.array(text)), batch.column("more").take(pa.array(text)), pa.array((at[first] - feeds[starts[text]]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(counts[text].astype(np.int32)), pa.array(leaf.view(np.int64)), pa.array(line.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PARSED.split(", ")])

    return docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("key"), F.hash("text").alias("more"), "text").mapInArrow(run, PARSED)


def spelled(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """The words of example lines (leaf, line, texts, text, no), with variable words generalised: leaf, line, texts, words (an array)."""
    of_text = examples.groupBy("text").agg(F.collect_list(F.struct("no", "leaf", "line", "texts")).alias("wanted"))
    texts = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("key"), F.col("text").alias("whole"))
    found = texts.join(of_text.withColumnRenamed("text", "key").hint("merge"), "key").select(F.split("whole", "\n").alias("lines"), "wanted")
    found = found.select(F.expr("inline(transform(wanted, w -> struct(w.leaf AS leaf, w.line AS line, w.texts AS texts, get(lines, w.no) AS spelled)))"))
    plain = F.trim(F.regexp_replace("spelled", GAP, " "))
    masked = F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", VARIABLE)
    # Copies of a document spell the same line again.
    return found.groupBy("leaf", "line", "texts").agg(F.first("spelled").alias("spelled")).select("leaf", "line", "texts", F.split(masked, " ").alias("words"))


def templates(spark: SparkSession, docs: DataFrame, near: DataFrame, min_docs: int, constant: float) -> DataFrame:
    """Lines (leaf, line) whose template recurs over `min_docs` texts, with their template."""
    of_text = near.groupBy("leaf", "line", "text").agg(F.first("no").alias("no"))
    leaves = near.select("leaf", "text").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("in_texts")).filter(F.col("in_texts") >= min_docs).select("leaf")
    leaves = stage(spark, leaves, "line-leaves")
    examples = of_text.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("texts"), F.first("text").alias("text"), F.first("no").alias("no"))
    # An inner join: a semi-join would be pushed below the counts, which would then be taken leaf by leaf.
    examples = stage(spark, examples.join(leaves.hint("merge"), "leaf"), "line-examples")
    lines = stage(spark, spelled(docs, examples), "line-spelled")
    fields = lines.select("leaf", "line", "texts", F.size("words").alias("n"), F.posexplode("words").alias("place", "word")).filter(F.col("word") != VARIABLE)
    steady = fields.groupBy("leaf", "place", "word").agg(F.sum("texts").alias("in_texts")).filter(F.col("in_texts") >= min_docs).select("leaf", "place", "word")
    steady = stage(spark, steady, "line-steady")
    # A template is its constant words at their places, whatever order they come in.
    fixed = fields.join(steady.hint("merge"), ["leaf", "place", "word"]).withColumn("at", F.xxhash64("place", "word"))
    fixed = fixed.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("fixed"), F.first("n").alias("n"), F.first("texts").alias("texts"), F.bit_xor("at").alias("x"), F.bit_xor(F.xxhash64("at")).alias("y"))
    fixed = fixed.filter(F.col("fixed") >= F.lit(constant) * F.col("n")).select("leaf", "line", "texts", F.xxhash64("leaf", "fixed", "x", "y").alias("template"))
    fixed = stage(spark, fixed, "line-templates")
    by = fixed.groupBy("template").agg(F.max("texts").alias("most"), F.count(F.lit(1)).alias("lines"))
    sure = by.filter(F.col("most") >= min_docs).select("template")
    # Of templates whose lines are each in few texts, the texts are counted.
    rest = fixed.join(by.filter((F.col("most") < min_docs) & (F.col("lines") > 1)).select("template").hint("merge"), "template", "left_semi")
    several = of_text.join(rest.select("leaf", "line", "template").hint("merge"), ["leaf", "line"]).select("template", "text").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("in_texts"))
    recurs = sure.unionByName(several.filter(F.col("in_texts") >= min_docs).select("template"))
    out = stage(spark, fixed.join(recurs.hint("merge"), "template", "left_semi").select("leaf", "line", "template"), "line-recurring")
    discard(spark, leaves, examples, lines, steady, fixed)
    return out


def _copies(spark: SparkSession, docs: DataFrame, mostly: DataFrame) -> DataFrame:
    """Of the texts in mostly (text, more), those that are near copies of one another: text and class."""
    texts = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("doc_id"), F.hash("text").alias("more"), "text")
    texts = texts.join(mostly.select(F.col("text").alias("doc_id"), "more").hint("merge"), ["doc_id", "more"], "left_semi")
    texts = stage(spark, texts.groupBy("doc_id").agg(F.first("text").alias("text")), "line-mostly")
    found = jaccard.components(spark, texts).select(F.col("doc_id").alias("text"), F.col("component_id").alias("class"))
    found = stage(spark, found, "line-classes")
    several = found.groupBy("class").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("class")
    copies = stage(spark, found.join(several.hint("merge"), "class", "left_semi").select("text", "class"), "line-copies")
    discard(spark, texts, found)
    return copies


def dropped(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, mostly: float = MOSTLY) -> DataFrame:
    """Per text that loses lines: its hashes and the numbers of the lines dropped, ascending."""
    lines = stage(spark, parsed(docs), "line-parsed")
    # Leaves that one text alone reaches go first; what is left is a small part of most corpora.
    shared = lines.groupBy("leaf").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("leaf")
    shared = stage(spark, shared, "line-shared")
    near = stage(spark, lines.join(shared.hint("merge"), "leaf", "left_semi"), "line-near")
    recurring = templates(spark, docs, near, min_docs, constant)
    gone = near.join(recurring.hint("merge"), ["leaf", "line"]).groupBy("text", "more", "no").agg(F.first("words").alias("words"), F.first("total").alias("total"), F.first("template").alias("template"))
    gone = stage(spark, gone, "line-gone")
    heavy = gone.groupBy("text", "more").agg(F.sum("words").alias("lost"), F.first("total").alias("total")).filter(F.col("lost") > F.lit(mostly) * F.col("total"))
    copies = _copies(spark, docs, heavy)
    held = gone.select("template", "text").distinct().join(copies.hint("merge"), "text", "left")
    held = stage(spark, held, "line-held")
    still = held.select("template", F.coalesce("class", "text").alias("by")).distinct().groupBy("template").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") >= min_docs).select("template")
    stays = held.filter("class IS NOT NULL").join(still.hint("merge"), "template", "left_anti").select("template", "text")
    left = gone.join(stays.hint("merge"), ["template", "text"], "left_anti")
    out = stage(spark, left.groupBy("text", "more").agg(F.sort_array(F.collect_list("no")).alias("drop")), "line-dropped")
    discard(spark, lines, shared, near, recurring, gone, copies, held)
    return out


def _without(lines: Column, drop: Column) -> Column:
    """lines without the numbers in drop (ascending), in time linear in both: the runs between them."""
    n, last = F.size(lines), F.size(drop)
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(drop, k - 1) + 1)
    stop = lambda k: F.when(k == last, n).otherwise(F.get(drop, k))
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(lines, start(k) + 1, stop(k) - start(k))))


def cleaned(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, keep: bool = False) -> DataFrame:
    """docs with the lines of recurring templates taken out of text; with `keep`, also __line_n and __line_lost, the lines there were and those dropped."""
    drop = dropped(spark, docs, min_docs).select(F.col("text").alias("__line_text"), F.col("more").alias("__line_more"), F.col("drop").alias("__line_drop"))
    rows = docs.withColumns({"__line_text": F.xxhash64("text"), "__line_more": F.hash("text")}).join(drop.hint("merge"), ["__line_text", "__line_more"], "left")
    rows = rows.withColumn("__line_all", F.split("text", "\n"))
    text = F.when(F.col("__line_drop").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("__line_all"), F.col("__line_drop")), "\n"))
    extra = [F.when(F.col("text").isNull(), 0).otherwise(F.size("__line_all")).cast("long").alias("__line_n"), F.when(F.col("__line_drop").isNull(), 0).otherwise(F.size("__line_drop")).cast("long").alias("__line_lost")] if keep else []
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *extra)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleaned(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), keep=True)
    return found.select("doc_id", F.col("__line_n").alias("n_lines"), F.col("__line_lost").alias("n_dropped"), "text")


OP10_SQL = r"""
WITH RECURSIVE l0 AS (
  SELECT text, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS no
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
l1 AS (SELECT text, no, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l0),
l2 AS (SELECT text, no, string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS w FROM l1 WHERE line <> ''),
l AS (SELECT text, no, w, len(w) AS n, w[1:4] AS lead FROM l2),
leaf AS (SELECT n, lead FROM l GROUP BY n, lead HAVING count(DISTINCT text) >= 3),
s AS (SELECT n, lead, w, count(DISTINCT text) AS texts FROM l JOIN leaf USING (n, lead) GROUP BY n, lead, w),
x AS (SELECT n, lead, w, texts, unnest(range(1, n + 1)) AS place, unnest(w) AS word FROM s),
c AS (SELECT n, lead, place, word FROM x WHERE word <> '<*>' GROUP BY n, lead, place, word HAVING sum(texts) >= 3),
t AS (SELECT n, lead, w, string_agg(place || ' ' || word, ' ' ORDER BY place) AS tpl FROM x JOIN c USING (n, lead, place, word) GROUP BY n, lead, w HAVING count(*) >= 0.6 * n),
r AS (SELECT n, lead, tpl FROM l JOIN t USING (n, lead, w) GROUP BY n, lead, tpl HAVING count(DISTINCT text) >= 3),
g AS (SELECT text, no, n, lead, tpl FROM l JOIN t USING (n, lead, w) JOIN r USING (n, lead, tpl)),
tot AS (SELECT text, sum(n) AS total FROM l GROUP BY text),
m AS (SELECT text FROM (SELECT text, sum(n) AS lost FROM g GROUP BY text) JOIN tot USING (text) WHERE lost > 0.6 * total),
-- near copies among texts that consist mostly of recurring lines
mw AS (SELECT text, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS k FROM m),
ms AS (SELECT DISTINCT text, sh FROM (SELECT text, unnest(CASE WHEN len(k) < 5 THEN [array_to_string(k, ' ')]
    ELSE list_transform(range(1, len(k) - 3), lambda i: k[i] || ' ' || k[i+1] || ' ' || k[i+2] || ' ' || k[i+3] || ' ' || k[i+4]) END) AS sh FROM mw)),
mn AS (SELECT text, count(*) AS n FROM ms GROUP BY text),
mi AS (SELECT a.text AS a, b.text AS b, count(*) AS c FROM ms a JOIN ms b ON a.sh = b.sh AND a.text <> b.text GROUP BY 1, 2),
ml AS (SELECT a, b FROM mi JOIN mn na ON na.text = a JOIN mn nb ON nb.text = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
mr AS (SELECT DISTINCT a, a AS b FROM ml UNION SELECT mr.a, ml.b FROM mr JOIN ml ON mr.b = ml.a),
cl AS (SELECT a AS text, min(b) AS class FROM mr GROUP BY a),
still AS (SELECT n, lead, tpl FROM g LEFT JOIN cl USING (text) GROUP BY n, lead, tpl HAVING count(DISTINCT coalesce(class, text)) >= 3),
d AS (SELECT text, list(no) AS nos FROM g LEFT JOIN cl USING (text) LEFT JOIN (SELECT *, true AS over FROM still) USING (n, lead, tpl) WHERE class IS NULL OR over GROUP BY text)
SELECT doc_id, coalesce(len(string_split(f.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(nos), 0)::BIGINT AS n_dropped,
  CASE WHEN nos IS NULL THEN f.text ELSE coalesce((SELECT string_agg(ln, chr(10) ORDER BY i) FROM
    (SELECT unnest(string_split(f.text, chr(10))) AS ln, unnest(range(0, len(string_split(f.text, chr(10))))) AS i) WHERE NOT list_contains(nos, i)), '') END AS text
FROM documents f LEFT JOIN d ON d.text = f.text
"""
