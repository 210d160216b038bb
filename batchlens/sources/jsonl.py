"""Request files: JSONL lines with numbers and offsets, validation and rejects, batch and streaming."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.window import Window as W

from batchlens.functions.json_text import line_members
from batchlens.functions.scalars import is_blank, valid_custom_id

LINES = "file string, line_no long, byte_end long, value string"


class _Span(InputPartition):
    def __init__(self, path: str, start: int, line: int, end: int):
        self.path, self.start, self.line, self.end = path, start, line, end


def _spans(path: str, span: int) -> list[_Span]:
    """Cut files at line ends near every `span` bytes; one pass counts the lines before each cut."""
    out = []
    for name in sorted(glob.glob(path)) if glob.has_magic(path) else [path]:
        start = line = lines = offset = 0
        with open(name, "rb") as file:
            for raw in file:
                offset += len(raw)
                lines += 1
                if offset - start >= span:
                    out.append(_Span(name, start, line, offset))
                    start, line = offset, lines
        if offset > start:
            out.append(_Span(name, start, line, offset))
    return out


def _read(span: _Span):
    with open(span.path, "rb") as file:
        file.seek(span.start)
        offset, line = span.start, span.line
        while offset < span.end and (raw := file.readline()):
            offset += len(raw)
            line += 1
            yield span.path, line, offset, raw.rstrip(b"\r\n").decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.span = options["path"], int(options.get("span", 64 << 20))

    def partitions(self):
        return _spans(self.path, self.span)

    def read(self, partition):
        yield from _read(partition)


class _Stream(SimpleDataSourceStreamReader):
    """Reads on from a byte and line; a file that became shorter is read anew."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self):
        return {"byte": 0, "line": 0}

    def read(self, start):
        size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        begin, line = (start["byte"], start["line"]) if start["byte"] <= size else (0, 0)
        rows = list(_read(_Span(self.path, begin, line, size)))
        end = {"byte": rows[-1][2], "line": rows[-1][1]} if rows else {"byte": begin, "line": line}
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        begin = start if start["byte"] <= end["byte"] else {"byte": 0, "line": 0}
        return _read(_Span(self.path, begin["byte"], begin["line"], end["byte"]))


class RequestLines(DataSource):
    """format("request_lines"): file, line_no (from 1, blank lines counted), byte_end and value of a local or mounted file."""

    @classmethod
    def name(cls):
        return "request_lines"

    def schema(self):
        return LINES

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RequestLines)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files in any store, without numbers: split at line feeds alone, carriage returns at the end dropped."""
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r+\z", "").alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1 in each file, blank lines counted) and value of the lines of files in any store.

    Files are read in splits, wherever they lie. A first pass counts the lines of each split; what comes before a split
    in its file is a running sum over that small table, and a line's place in its split is the order in which it was read.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("read_at")]
    rows = spark.read.option("lineSep", "\n").text(path)
    splits = rows.select(*meta).groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("read_at").alias("from"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from") + 1).alias("shift"))
    numbered = rows.select("value", *meta).join(splits, ["file", "block"])
    return numbered.select("file", (F.col("read_at") + F.col("shift")).alias("line_no"), F.regexp_replace("value", r"\r+\z", "").alias("value"))


def marks(spark: SparkSession, path: str) -> DataFrame:
    """How far files go: file, byte_end (their size) and line_end (their lines), to be kept once they have been read."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("byte_end"))
    return rows.groupBy("file").agg(F.max("byte_end").alias("byte_end"), F.count(F.lit(1)).alias("line_end"))


def lines_after(spark: SparkSession, path: str, read: DataFrame) -> DataFrame:
    """Numbered lines of files beyond what marks (file, byte_end, line_end) say was read. A file that became shorter is read anew."""
    now = marks(spark, path).select("file", F.col("byte_end").alias("size"))
    known = read.groupBy("file").agg(F.max_by("line_end", "byte_end").alias("line_end"), F.max("byte_end").alias("byte_end")).join(now, "file")
    known = known.select("file", F.when(F.col("size") >= F.col("byte_end"), F.col("line_end")).otherwise(0).alias("line_end"))
    return numbered_lines(spark, path).join(known, "file", "left").filter(F.col("line_no") > F.coalesce("line_end", F.lit(0))).drop("line_end")


def parse(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows without blank lines, with custom_id, method, url, body (JSON text) and error (null where the line is valid).

    recordId stands for custom_id, but not beside it. method is POST and url empty where absent; body is required.
    """
    text, strict = F.col(value), F.col("__line.error")
    lines = rows.filter(~is_blank(text)).withColumn("__line", line_members(text, "custom_id", "recordId", "method", "url", "body", raw=("body",)))
    kind = lambda name: F.col(f"__line.{name}.kind")
    said = lambda name: F.col(f"__line.{name}.text")
    custom_id = F.coalesce(said("custom_id"), said("recordId"))
    optional = lambda name: kind(name).isNull() | (kind(name) == "string")
    error = (
        F.when(~F.is_valid_utf8(text), "invalid UTF-8").when(strict.isNotNull(), F.concat(F.lit("invalid JSON: "), strict)).when(~F.col("__line.object") | ~F.col("__line.distinct"), "not a JSON object with distinct keys")
        .when(kind("custom_id").isNotNull() & kind("recordId").isNotNull(), "duplicate field custom_id").when(custom_id.isNull(), "missing custom_id")
        .when(~optional("method"), "method is not a string").when(~optional("url"), "url is not a string").when(kind("body").isNull(), "missing body")
        .when(~valid_custom_id(custom_id), "invalid custom_id")
    )
    out = lines.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return out.select(
        *rows.columns, "error", good(custom_id).alias("custom_id"), good(F.coalesce(said("method"), F.lit("POST"))).alias("method"),
        good(F.coalesce(said("url"), F.lit(""))).alias("url"), good(F.col("__line.body.raw")).alias("body"),
    )


def ingest(spark: SparkSession, rows: DataFrame, emitted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid requests (first line of each id, without ids already there), rejects (line_no, error, input) and one row of statistics.

    rows are numbered lines.
    """
    found = parse(rows)
    rejects = found.filter("error IS NOT NULL").select("line_no", "error", F.col("value").alias("input"))
    valid = found.filter("error IS NULL").groupBy("custom_id").agg(F.min(F.struct("line_no", "method", "url", "body")).alias("r"), F.count(F.lit(1)).alias("n"))
    items = valid.select("custom_id", "r.method", "r.url", "r.body", F.col("r.line_no").alias("ordinal"))
    if emitted is not None:
        items = items.join(emitted.select("custom_id"), "custom_id", "left_anti")
    stats = found.agg(F.count(F.lit(1)).alias("lines_read"), F.count_if(F.col("error").isNull()).alias("hydrated"), F.count_if(F.col("error").isNotNull()).alias("rejected"))
    return items, rejects, stats


def write_rejects(rejects: DataFrame, path: str) -> bool:
    """Append rejects as JSON lines if there are any; whether there were."""
    if not rejects.limit(1).count():
        return False
    rejects.write.mode("append").json(path)
    return True


def ordered_by_prefix(rows: DataFrame, buckets: int, value: str = "value") -> DataFrame:
    """rows with bucket (of model and shared prompt prefix; `buckets` where there is no key), range-partitioned and sorted by bucket and line."""
    from batchlens.functions.json_text import bucket_key, fnv_bucket

    n = min(max(buckets, 1), 256)
    keyed = rows.withColumn("bucket", F.coalesce(fnv_bucket(bucket_key(F.col(value)), n), F.lit(n)))
    return keyed.repartitionByRange("bucket", "line_no").sortWithinPartitions("bucket", "line_no")
