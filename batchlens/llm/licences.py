"""Licence scans: sparse TF-IDF cosine of single lines to templates of notices, and inheritance from directories.

All of it is DataFrame functions. A word's weight is its count times ln((N + 1) / (df + 1)) + 1 over all N files; words
outside the templates' vocabulary weigh as if no file had them. Every line of every file is compared with the templates
that it can reach: by the Cauchy-Schwarz inequality a line whose cosine to a template reaches the threshold shares one
of its anchors, its heaviest words up to where the rest cannot reach the threshold alone. Only such lines are expanded
into words. A file's licence is the best match of its lines. A file is a licence file if its name says so or matching
lines hold at least half of its words; its licence then covers its directory. A file without a match inherits from the
nearest ancestor directory that has one, by equi-joins of directories with their ancestors.

Not compared: runs of lines, notices inside longer lines, and whole files with full licence texts; the templates are
notices of one sentence. A wrapped notice or a full licence text is found only as far as one of its lines matches.

Nulls and odd input: a null or empty text matches nothing but may inherit; a null path is no directory's and inherits
nothing; rows that repeat path and text share a result; null ids are allowed. Ties go to the first licence by name. Very
long texts are taken whole. An empty table gives an empty result. Extra columns are ignored.

Directories are aggregated before they are joined and the join is salted, so a directory that holds a third of all files
(or the root) is no single task's. Collected to the driver: anchors, at most the words of the templates.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from batchlens.llm.common import stage, table

THRESHOLD, FILE_SHARE, SALTS = 0.6, 0.5, 16
WORDS = "[^a-z0-9]+"
#: Usual notices of licences.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work under CC0 1.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. Unauthorized copying is prohibited."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


def _words(text: str) -> list[str]:
    return [w for w in re.split(WORDS, text.lower()) if w]


def _constant(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Rows that are part of the query itself."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows])))


def _split(column: str) -> F.Column:
    return F.split(F.lower(F.col(column)), WORDS)


def weights(spark: SparkSession, files: DataFrame, templates: tuple = TEMPLATES) -> tuple[DataFrame, float, DataFrame]:
    """Words and their weights, the weight of other words, and words of templates with their weights and the template's norm."""
    vocabulary = sorted({w for _, text in templates for w in _words(text)})
    known = F.array(*[F.lit(w) for w in vocabulary])
    df = files.filter("text IS NOT NULL").select(F.explode(F.array_intersect(_split("text"), known)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = files.count()
    words = _constant(spark, [(w,) for w in vocabulary], ["word"]).join(df, "word", "left")
    words = stage(spark, words.select("word", (F.log(F.lit(n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")), "scan-words")
    terms = [(i, licence, w, _words(text).count(w)) for i, (licence, text) in enumerate(templates) for w in sorted(set(_words(text)))]
    terms = _constant(spark, terms, ["template", "licence", "word", "tf"]).join(words, "word").withColumn("tw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("tw") * F.col("tw")).over(W.partitionBy("template")))
    return words, math.log(n + 1) + 1, stage(spark, terms.withColumn("tnorm", norm).select("template", "licence", "word", "tw", "tnorm"), "scan-terms")


def matches(spark: SparkSession, files: DataFrame, threshold: float = THRESHOLD, templates: tuple = TEMPLATES) -> DataFrame:
    """Per file with a matching line (key): licence, score and share, the part of the file's words in matching lines."""
    words, other, terms = weights(spark, files, templates)
    heavy = W.partitionBy("template").orderBy(F.desc("tw"), "word").rowsBetween(W.unboundedPreceding, -1)
    rest = F.col("tnorm") * F.col("tnorm") - F.coalesce(F.sum(F.col("tw") * F.col("tw")).over(heavy), F.lit(0.0))
    anchors = terms.withColumn("rest", rest).filter(F.col("rest") >= F.lit(threshold * threshold * (1 - 1e-9)) * F.col("tnorm") * F.col("tnorm")).select("word").distinct()
    anchors = F.array(*[F.lit(r["word"]) for r in anchors.orderBy("word").collect()])
    # The words of a whole text are counted only for texts that have an anchor at all.
    texts = files.filter("text IS NOT NULL").filter(F.arrays_overlap(_split("text"), anchors))
    texts = texts.select("key", "text", F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+")).alias("total"))
    lines = texts.select("key", "total", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("words", _split("line"))
    lines = lines.filter(F.arrays_overlap("words", anchors)).withColumn("words", F.filter("words", lambda w: w != ""))
    lines = lines.select("key", "line_no", "words", "total").distinct()
    lines = stage(spark, lines, "scan-lines")
    tokens = lines.select("key", "line_no", F.size("words").alias("length"), "total", F.explode("words").alias("word")).groupBy("key", "line_no", "word").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"), F.first("total").alias("total"))
    tokens = tokens.join(words, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    tokens = stage(spark, tokens.select("key", "line_no", "word", "w", "length", "total"), "scan-tokens")
    norms = tokens.groupBy("key", "line_no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.first("length").alias("length"), F.first("total").alias("total"))
    dots = tokens.select("key", "line_no", "word", "w").join(terms, "word").groupBy("key", "line_no", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.first("tnorm").alias("tnorm"))
    scored = dots.join(norms, ["key", "line_no"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6)).filter(F.col("score") >= threshold)
    best = scored.groupBy("key", "line_no").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"), F.first("length").alias("length"), F.first("total").alias("total"))
    found = best.groupBy("key").agg(F.min("b").alias("b"), (F.sum("length") / F.first("total")).alias("share"))
    return stage(spark, found.select("key", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), "share"), "scan-found")


def scan(spark: SparkSession, files: DataFrame, threshold: float = THRESHOLD, templates: tuple = TEMPLATES) -> DataFrame:
    """Licences of files (doc_id, path, text): doc_id, path, licence, score, origin ('own', 'inherited' or null) and directory it comes from."""
    keyed = files.select("doc_id", "path", "text", F.xxhash64("path", "text").alias("key"))
    found = matches(spark, keyed, threshold, templates)
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    narrow = stage(spark, keyed.select("doc_id", "path", "key", F.when(F.col("path").isNotNull(), parent).alias("dir")).join(found, "key", "left"), "scan-files")
    named = F.substring_index("path", "/", -1).rlike(LICENCE_FILE)
    covering = narrow.filter(F.col("licence").isNotNull() & F.col("dir").isNotNull() & (named | (F.col("share") >= FILE_SHARE)))
    covering = covering.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("c")).select(F.col("dir").alias("from"), F.col("c.licence").alias("inherited"))
    covering = stage(spark, covering.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "scan-directories")
    # Every directory that has files without a licence, with its ancestors and itself; the nearest that covers wins.
    needy = narrow.filter("licence IS NULL AND dir IS NOT NULL").select("dir").distinct()
    steps = F.split("dir", "/")
    up = needy.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).withColumn("from", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    up = up.withColumn("salt", F.pmod(F.xxhash64("dir"), F.lit(SALTS)).cast("int"))
    near = up.join(covering, ["from", "salt"]).groupBy("dir").agg(F.max(F.struct("depth", "inherited", "from")).alias("n")).select("dir", "n.inherited", "n.from")
    near = stage(spark, near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "scan-near")
    out = narrow.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(near, ["dir", "salt"], "left")
    own = F.col("licence").isNotNull()
    origin = F.when(own, "own").when(F.col("inherited").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("licence", "inherited").alias("licence"), "score", origin.alias("origin"), F.when(~own, F.col("from")).alias("directory"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree, /source/lang/d<thousands>/d<hundreds>/name; one name in 16 is that of a licence file."""
    docs = table(spark, sf_dir, "documents")
    step = lambda by: F.concat(F.lit("d"), F.floor(F.col("doc_id") / by).cast("string"))
    name = F.when(F.pmod("doc_id", F.lit(16)) == 5, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(spark, docs.select("doc_id", F.concat_ws("/", F.lit(""), "source", "lang", step(1000), step(100), name).alias("path"), "text"))


_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
OP3_SQL = f"""
WITH RECURSIVE tpl(id, licence, txt) AS (VALUES {_VALUES}),
tw AS (SELECT id, licence, word, count(*) AS tf FROM (SELECT id, licence, unnest(regexp_split_to_array(lower(txt), '[^a-z0-9]+')) AS word FROM tpl) WHERE word <> '' GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
f0 AS (SELECT doc_id, concat_ws('/', '', source, lang, 'd' || CAST(doc_id // 1000 AS VARCHAR), 'd' || CAST(doc_id // 100 AS VARCHAR)) AS dir,
  CASE WHEN doc_id % 16 = 5 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS name, text FROM documents),
f AS (SELECT doc_id, dir || '/' || name AS path, dir, name, text FROM f0),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) AS word FROM f) WHERE word IN (SELECT word FROM tw) GROUP BY word),
idf AS (SELECT word, ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word), n),
t AS (SELECT id, licence, word, tf * idf AS tw, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS tnorm FROM tw JOIN idf USING (word)),
l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM f),
w AS (SELECT doc_id, no, word, count(*) AS tf FROM (SELECT doc_id, no, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS word FROM l) WHERE word <> '' GROUP BY ALL),
x AS (SELECT doc_id, no, word, tf, tf * coalesce(idf, ln((SELECT n FROM n) + 1.0::DOUBLE) + 1) AS w FROM w LEFT JOIN idf USING (word)),
nm AS (SELECT doc_id, no, sqrt(sum(w * w)) AS norm, sum(tf) AS length FROM x GROUP BY ALL),
d AS (SELECT doc_id, no, id, licence, sum(w * tw) AS dot, any_value(tnorm) AS tnorm FROM x JOIN t USING (word) GROUP BY ALL),
s AS (SELECT doc_id, no, licence, length, round(dot / (norm * tnorm), 6) AS score FROM d JOIN nm USING (doc_id, no) WHERE round(dot / (norm * tnorm), 6) >= {THRESHOLD}),
b AS (SELECT doc_id, no, arg_min(licence, (-score, licence)) AS licence, max(score) AS score, any_value(length) AS length FROM s GROUP BY ALL),
o AS (SELECT doc_id, arg_min(licence, (-score, licence)) AS licence, max(score) AS score, sum(length) AS covered FROM b GROUP BY ALL),
tot AS (SELECT doc_id, sum(tf) AS total FROM w GROUP BY ALL),
c AS (SELECT dir, arg_min(licence, (-score, licence)) AS inherited FROM o JOIN tot USING (doc_id) JOIN f USING (doc_id) WHERE covered >= {FILE_SHARE} * total OR regexp_matches(name, '{LICENCE_FILE}') GROUP BY ALL),
up AS (SELECT DISTINCT dir, dir AS anc FROM f UNION SELECT dir, regexp_replace(anc, '/[^/]*$', '') FROM up WHERE anc <> ''),
near AS (SELECT up.dir, arg_max(inherited, length(anc)) AS inherited, max(anc) AS covering FROM up JOIN c ON c.dir = up.anc GROUP BY up.dir)
SELECT f.doc_id, f.path, coalesce(licence, inherited) AS licence, score, CASE WHEN licence IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN licence IS NULL AND inherited IS NOT NULL THEN covering END AS directory
FROM f LEFT JOIN o USING (doc_id) LEFT JOIN near USING (dir)
"""
