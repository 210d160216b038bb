"""Foreign batch files in one shape: three ways of naming id, body and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.functions.json_text import line_members
from batchlens.functions.scalars import default_path, is_blank, valid_custom_id
from batchlens.schemas import KINDS


def infer_url(keys: Column, default: str = "chat") -> Column:
    """The path that a body's keys imply."""
    has = lambda key: F.coalesce(F.array_contains(keys, key), F.lit(False))
    return default_path(F.when(has("messages"), "chat").when(has("input"), "embeddings").when(has("prompt"), "completions").otherwise(default))


IDS, BODIES = ("custom_id", "recordId"), ("body", "params", "modelInput")


def normalize(rows: DataFrame, default: str = "chat", value: str = "value") -> DataFrame:
    """rows without blank lines, with custom_id, method, url, body and error.

    A key that is present decides even if its value is null; of a key that comes twice the last; an empty url is kept.
    A line is parsed once, in one Arrow function.
    """
    if default not in KINDS:
        raise ValueError(f"{default} is no kind of endpoint")
    found = rows.filter(~is_blank(F.col(value))).withColumn("__line", line_members(F.col(value), *IDS, "method", "url", *BODIES, raw=BODIES))
    first = lambda names: F.coalesce(*[F.when(F.col(f"__line.{n}.kind").isNotNull(), F.col(f"__line.{n}")) for n in names])
    named, body = first(IDS), first(BODIES)
    custom_id, strict = named["text"], F.col("__line.error")
    error = (
        F.when(strict.isNotNull(), F.concat(F.lit("invalid JSON: "), strict)).when(custom_id.isNull(), "missing custom_id / recordId").when(~valid_custom_id(custom_id), "invalid custom_id")
        .when(body.isNull(), "missing body / params / modelInput").when(body["kind"] != "object", "body / params / modelInput is not a JSON object")
    )
    return found.withColumn("error", error).select(
        *rows.columns, "error", F.when(F.col("error").isNull(), custom_id).alias("custom_id"), F.coalesce("__line.method.text", F.lit("POST")).alias("method"),
        F.coalesce("__line.url.text", infer_url(F.col("__line.keys"), default)).alias("url"), body["raw"].alias("body"),
    )


def import_batch(rows: DataFrame, default: str = "chat") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of numbered lines: requests (first line of each id), rejects (line_no, error, input) and one row of statistics.

    Requests and statistics come from one aggregation by id each; only the rejects join lines with the first of their id.
    """
    found = normalize(rows, default)
    valid = found.filter("error IS NULL")
    good = valid.groupBy("custom_id").agg(F.min(F.struct("line_no", "method", "url", "body")).alias("r")).select("custom_id", "r.method", "r.url", "r.body", F.col("r.line_no").alias("ordinal"))
    first = valid.groupBy("custom_id").agg(F.min("line_no").alias("first"))
    marked = found.join(first, "custom_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("line_no") > F.col("first"), "duplicate custom_id")))
    rejects = marked.filter("error IS NOT NULL").select("line_no", "error", F.col("value").alias("input"))
    known = F.col("custom_id").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    stats = found.groupBy("custom_id").agg(F.count(F.lit(1)).alias("n")).agg(total(F.col("n")).alias("lines_read"), F.count_if(known).alias("written"), total(F.when(~known, F.col("n"))).alias("rejected"), total(F.when(known, F.col("n") - 1)).alias("duplicates"))
    return good, rejects, stats


def write_import(spark: SparkSession, source: str, out: str, default: str = "chat") -> DataFrame:
    """Import a file into a folder of request lines; the statistics. Refuses to write onto the source."""
    from batchlens.operators.results import same_place
    from batchlens.sources.jsonl import numbered_lines

    if same_place(spark, source, out):
        raise ValueError("the input and the output are one place")
    good, rejects, stats = import_batch(numbered_lines(spark, source), default)
    head = F.to_json(F.struct("custom_id", "method", "url"))  # escapes what it holds; the body goes on as written
    record = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"body":'), F.col("body"), F.lit("}"))
    good.select(record.alias("value")).write.mode("overwrite").text(out)
    if rejects.limit(1).count():
        rejects.write.mode("overwrite").json(f"{out.rstrip('/')}.reject")
    return stats
