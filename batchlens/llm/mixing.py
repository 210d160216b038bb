"""Mixing sources to target weights by Pareto order sampling.

All of it is DataFrame functions. A document's measure is its number of words. Every source gets a target number of
words: its weight's share of all words, but at most `limit` times what it has; what a source cannot take goes to the
others by weight until none is above. Each document of a source first gets floor(target / words of the source) certain
whole copies. The rest of the target is drawn without replacement by Pareto order sampling: a document with inclusion
probability p and random number u ranks by odds(u) / odds(p), and the lowest ranks are taken while they fit. One more
document, the one that comes nearest to what is then left, closes the gap. p is the share still wanted, tilted towards
documents longer than the mean (`tilt`), so documents of a source have unequal odds.

Nulls and odd input: a null text has 0 words and is never short of its target; a null source is a source of its own,
last in order; null ids are allowed. u derives from a digest of id, source and text, so reruns agree and equal rows
share their draw (they are taken or left together, and count together). An empty table gives an empty result. Extra
columns pass through; working columns have names starting with `__mix_`.

Hot sources: the running sum over a source is taken over rank buckets of bounded expected size and only the one bucket
where the target falls is sorted, so no task holds a source. Tables by source are joined with whatever join their
written size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from batchlens.llm.common import stage, table

WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "mix-1"
#: No document is taken more often than this.
LIMIT = 3
#: How far a document's odds lean towards longer ones: 0 not at all, 1 fully.
TILT = 0.5
#: Expected documents of a rank bucket, and the most buckets of a source.
BUCKET_ROWS, MOST_BUCKETS = 4096, 1 << 16


def _measured(docs: DataFrame, seed: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("source"), F.lit("null")), text))
    return (
        docs.withColumn("__mix_size", F.regexp_count(text, F.lit(WORD)).cast("long"))
        .withColumn("__mix_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")))
        .withColumn("__mix_key", digest)
        .withColumn("__mix_u", (F.conv(F.substring("__mix_key", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4503599627370496.0))
    )


def _targets(measured: DataFrame, limit: int) -> DataFrame:
    """One row per source: its words, documents, target, certain copies, words still to draw and rank buckets."""
    order = W.partitionBy(F.lit(0)).orderBy("__mix_source")
    ratio = W.partitionBy(F.lit(0)).orderBy("__mix_ratio", "__mix_source")
    upto = ratio.rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy(F.lit(0))
    by = measured.groupBy("__mix_source").agg(F.sum("__mix_size").alias("__mix_words"), F.count(F.lit(1)).alias("__mix_docs"))
    by = by.withColumn("__mix_weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    by = by.withColumn("__mix_ratio", F.col("__mix_words") / F.col("__mix_weight"))
    # A source is full when it meets its limit no later than the level that the remaining ones then share.
    left = F.sum("__mix_words").over(everything) - limit * (F.sum("__mix_words").over(upto) - F.col("__mix_words"))
    weight = F.sum("__mix_weight").over(everything) - (F.sum("__mix_weight").over(upto) - F.col("__mix_weight"))
    by = by.withColumn("__mix_level", left / weight)
    by = by.withColumn("__mix_full", F.col("__mix_level") * F.col("__mix_weight") >= limit * F.col("__mix_words"))
    level = F.min(F.when(~F.col("__mix_full"), F.struct("__mix_ratio", "__mix_source", "__mix_level"))).over(everything)["__mix_level"]
    share = F.least((level * F.col("__mix_weight")).cast("double"), (limit * F.col("__mix_words")).cast("double"))
    by = by.withColumn("__mix_target", F.when(F.col("__mix_full"), (limit * F.col("__mix_words")).cast("double")).otherwise(share))
    by = by.withColumn("__mix_whole", F.when(F.col("__mix_words") == 0, F.lit(0)).otherwise(F.floor(F.col("__mix_target") / F.greatest("__mix_words", F.lit(1)))).cast("long"))
    by = by.withColumn("__mix_rest", F.col("__mix_target") - F.col("__mix_whole") * F.col("__mix_words"))
    buckets = F.least(F.greatest(F.ceil(F.col("__mix_docs") / BUCKET_ROWS), F.lit(1)), F.lit(MOST_BUCKETS)).cast("long")
    return by.withColumn("__mix_buckets", buckets).select("__mix_source", "__mix_words", "__mix_docs", "__mix_target", "__mix_whole", "__mix_rest", "__mix_buckets")


def _rank(tilt: float) -> Column:
    """Odds of the random number over odds of inclusion, brought into 0 to 1."""
    size, mean = F.col("__mix_size"), F.col("__mix_words") / F.col("__mix_docs")
    lean = F.lit(1.0 - tilt) + F.lit(2.0 * tilt) * (size / (size + mean))
    p = F.least(F.greatest(F.col("__mix_rest") / F.col("__mix_words") * lean, F.lit(1e-9)), F.lit(0.999999))
    odds = (F.col("__mix_u") / (1 - F.col("__mix_u"))) / (p / (1 - p))
    return odds / (1 + odds)


def plan(spark: SparkSession, docs: DataFrame, seed: str = SEED, limit: int = LIMIT, tilt: float = TILT) -> tuple[DataFrame, DataFrame]:
    """Measured rows of docs (narrow), and per source the target and what separates taken from left documents."""
    narrow = stage(spark, _measured(docs, seed).select("doc_id", "__mix_source", "__mix_key", "__mix_u", "__mix_size"), "mix-rows")
    targets = stage(spark, _targets(narrow, limit), "mix-targets")
    drawn = narrow.filter("__mix_size > 0").join(targets.filter("__mix_rest > 0"), "__mix_source").withColumn("__mix_rank", _rank(tilt))
    drawn = drawn.withColumn("__mix_bucket", F.least(F.floor(F.col("__mix_rank") * F.col("__mix_buckets")), F.col("__mix_buckets") - 1))
    sums = drawn.groupBy("__mix_source", "__mix_bucket").agg(F.sum("__mix_size").alias("__mix_in"), F.first("__mix_rest").alias("__mix_rest"))
    upto = W.partitionBy("__mix_source").orderBy("__mix_bucket")
    sums = sums.withColumn("__mix_upto", F.sum("__mix_in").over(upto))
    # The bucket in which the rest of the target runs out, and what lower buckets hold.
    cut = sums.filter(F.col("__mix_upto") > F.col("__mix_rest")).groupBy("__mix_source")
    cut = stage(spark, cut.agg(F.min(F.struct("__mix_bucket", (F.col("__mix_upto") - F.col("__mix_in")).alias("__mix_below"))).alias("c")).select("__mix_source", "c.*"), "mix-cuts")
    tied = drawn.join(cut, ["__mix_source", "__mix_bucket"]).groupBy("__mix_source", "__mix_bucket", "__mix_rank", "__mix_key")
    tied = tied.agg(F.sum("__mix_size").alias("__mix_in"), F.first("__mix_rest").alias("__mix_rest"), F.first("__mix_below").alias("__mix_below"))
    within = W.partitionBy("__mix_source", "__mix_bucket").orderBy("__mix_rank", "__mix_key")
    tied = tied.withColumn("__mix_upto", F.col("__mix_below") + F.sum("__mix_in").over(within))
    taken = F.max(F.when(F.col("__mix_upto") <= F.col("__mix_rest"), F.struct("__mix_rank", "__mix_key", "__mix_upto")))
    last = tied.groupBy("__mix_source").agg(taken.alias("t"), F.first("__mix_below").alias("__mix_below"))
    last = last.select("__mix_source", F.col("t.__mix_rank").alias("__mix_last_rank"), F.col("t.__mix_key").alias("__mix_last_key"), F.coalesce("t.__mix_upto", "__mix_below").alias("__mix_sum"))
    cut = cut.join(last, "__mix_source").select("__mix_source", F.col("__mix_bucket").alias("__mix_cut"), "__mix_last_rank", "__mix_last_key", "__mix_sum")
    targets = stage(spark, targets.join(cut, "__mix_source", "left"), "mix-drawn")
    # Among documents left out, the one whose words come nearest to what is missing, if that is better than nothing.
    rest = narrow.filter("__mix_size > 0").join(targets.filter("__mix_cut IS NOT NULL"), "__mix_source").withColumn("__mix_rank", _rank(tilt))
    rest = rest.filter(~_drawn()).groupBy("__mix_source", "__mix_rank", "__mix_key")
    rest = rest.agg(F.sum("__mix_size").alias("__mix_in"), (F.first("__mix_rest") - F.first("__mix_sum")).alias("__mix_gap"))
    rest = rest.withColumn("__mix_miss", F.abs(F.col("__mix_in") - F.col("__mix_gap"))).filter(F.col("__mix_miss") < F.col("__mix_gap"))
    fill = rest.groupBy("__mix_source").agg(F.min(F.struct("__mix_miss", "__mix_rank", "__mix_key")).alias("f")).select("__mix_source", F.col("f.__mix_key").alias("__mix_fill"))
    return narrow, stage(spark, targets.join(fill, "__mix_source", "left"), "mix-plan")


def _drawn() -> Column:
    """Whether a row's rank is below the cut of its source; with no cut, all are."""
    bucket = F.least(F.floor(F.col("__mix_rank") * F.col("__mix_buckets")), F.col("__mix_buckets") - 1)
    before = F.col("__mix_last_rank").isNotNull() & ((F.col("__mix_rank") < F.col("__mix_last_rank")) | ((F.col("__mix_rank") == F.col("__mix_last_rank")) & (F.col("__mix_key") <= F.col("__mix_last_key"))))
    return F.col("__mix_cut").isNull() | (bucket < F.col("__mix_cut")) | ((bucket == F.col("__mix_cut")) & before)


def _copies(rows: DataFrame, targets: DataFrame, tilt: float) -> DataFrame:
    """Rows with __mix_copies, how often each is taken. Rows need the measured columns."""
    joined = rows.join(targets, "__mix_source", "left").withColumn("__mix_rank", F.when((F.col("__mix_size") > 0) & (F.col("__mix_rest") > 0), _rank(tilt)))
    extra = F.when(F.col("__mix_rank").isNotNull() & (_drawn() | (F.col("__mix_key") == F.coalesce("__mix_fill", F.lit("")))), 1).otherwise(0)
    return joined.withColumn("__mix_copies", (F.col("__mix_whole") + extra).cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, seed: str = SEED, limit: int = LIMIT, tilt: float = TILT) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target and taken (words the mix takes, repeats counted)."""
    narrow, targets = plan(spark, docs, seed, limit, tilt)
    return _copies(narrow, targets, tilt).select(
        "doc_id", F.col("__mix_size").alias("size"), F.col("__mix_words").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_size") * F.col("__mix_copies")).alias("taken")
    )


def mix(spark: SparkSession, docs: DataFrame, seed: str = SEED, limit: int = LIMIT, tilt: float = TILT) -> DataFrame:
    """The mixed corpus itself: the rows of docs, each as often as the mix takes it, with the columns of docs."""
    _, targets = plan(spark, docs, seed, limit, tilt)
    rows = _copies(_measured(docs, seed), targets, tilt).filter("__mix_copies > 0")
    return rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH m AS (
  SELECT doc_id, coalesce('=' || source, '~') AS s,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(source, 'null') || '|' || coalesce(text, '')) AS k
  FROM documents),
u AS (SELECT *, (CAST('0x' || substr(k, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM m),
a AS (SELECT s, CAST(sum(size) AS BIGINT) AS words, count(*) AS docs, CAST((row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS BIGINT) AS weight FROM m GROUP BY s),
b AS (SELECT *, CAST(sum(words) OVER () AS BIGINT) - 3 * coalesce(CAST(sum(words) OVER w AS BIGINT), 0) AS lft,
    CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER w AS BIGINT), 0) AS wl, words::DOUBLE / weight::DOUBLE AS ratio
  FROM a WINDOW w AS (ORDER BY words::DOUBLE / weight::DOUBLE, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, lft::DOUBLE / wl::DOUBLE AS lev, lft::DOUBLE / wl::DOUBLE * weight::DOUBLE >= 3 * words AS f FROM b),
lv AS (SELECT min_by(lev, (ratio, s)) FILTER (NOT f) AS level FROM c),
t AS (SELECT c.s, words, docs, CASE WHEN f THEN (3 * words)::DOUBLE ELSE least(level * weight::DOUBLE, (3 * words)::DOUBLE) END AS target FROM c, lv),
t2 AS (SELECT *, CASE WHEN words = 0 THEN 0 ELSE CAST(floor(target / words::DOUBLE) AS BIGINT) END AS whole FROM t),
t3 AS (SELECT *, target - (whole * words)::DOUBLE AS rest FROM t2),
p AS (SELECT u.*, t3.words, t3.docs, t3.target, t3.whole, t3.rest,
    least(greatest(rest / words::DOUBLE * (0.5::DOUBLE + 1.0::DOUBLE * (size::DOUBLE / (size::DOUBLE + words::DOUBLE / docs::DOUBLE))), 1e-9::DOUBLE), 0.999999::DOUBLE) AS pi
  FROM u JOIN t3 USING (s)),
r AS (SELECT *, CASE WHEN size > 0 AND rest > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS odds FROM p),
r2 AS (SELECT *, odds / (1 + odds) AS rnk FROM r),
c2 AS (SELECT *, sum(CASE WHEN rnk IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY s ORDER BY rnk NULLS LAST, k) AS upto FROM r2),
d AS (SELECT *, rnk IS NOT NULL AND upto <= rest AS drawn FROM c2),
g AS (SELECT s, any_value(rest) - sum(CASE WHEN drawn THEN size ELSE 0 END) AS gap FROM d GROUP BY s),
tie AS (SELECT s, rnk, k, sum(size) AS size FROM d WHERE rnk IS NOT NULL AND NOT drawn GROUP BY s, rnk, k),
fl AS (SELECT s, arg_min(k, (abs(size - gap), rnk, k)) AS fill FROM tie JOIN g USING (s) WHERE abs(size - gap) < gap GROUP BY s)
SELECT doc_id, size, words AS source_size, target, CAST(size * (whole + CASE WHEN drawn OR (rnk IS NOT NULL AND k = fill) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d LEFT JOIN fl USING (s)
"""
