"""REST views of files and batches, their life cycle, and the wire messages of remote workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.operators.ledger import counts


def file_objects(files: DataFrame) -> DataFrame:
    return files.select("id", F.lit("file").alias("object"), "bytes", "created_at", "filename", "purpose")


def register_file(files: DataFrame, id: str, filename: str, size: int, created_at: int, purpose: str = "batch", most: int = 512 << 20) -> DataFrame:
    """files with one more; a file above `most` bytes is refused."""
    if size > most:
        raise ValueError(f"{filename} has more than {most} bytes")
    row = files.sparkSession.createDataFrame([(id, size, created_at, filename, purpose)], "id string, bytes long, created_at long, filename string, purpose string")
    return files.unionByName(row)


def batch_objects(batches: DataFrame, states: DataFrame) -> DataFrame:
    """Batches with their live request_counts, from the ledger states of all batches (batch_id, status)."""
    by = states.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("completed"), F.count_if(F.col("status") == "dead_letter").alias("failed"))
    joined = batches.join(by, batches["id"] == by["batch_id"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        "id", F.lit("batch").alias("object"), "endpoint", "input_file_id", "completion_window", "status", "output_file_id", "error_file_id", "created_at", "in_progress_at", "completed_at", "cancelled_at",
        F.struct(n("total"), n("completed"), n("failed")).alias("request_counts"),
    )


def listed(objects: DataFrame, most: int = 20) -> DataFrame:
    """Newest batches first."""
    return objects.orderBy(F.desc("created_at"), "id").limit(most)


def list_envelope(objects: DataFrame, most: int = 20) -> DataFrame:
    """One JSON line: an object list with nulls present."""
    rows = listed(objects, most).withColumn("o", F.struct(*objects.columns))
    data = rows.agg(F.sort_array(F.collect_list(F.struct((-F.col("created_at")).alias("k"), "id", "o"))).alias("x")).select(F.lit("list").alias("object"), F.transform("x", lambda e: e["o"]).alias("data"))
    return data.select(F.to_json(F.struct("object", "data"), {"ignoreNullFields": "false"}).alias("json"))


def create(batches: DataFrame, files: DataFrame, requests: DataFrame, at_ms: int) -> DataFrame:
    """New batches in progress for requests (id, input_file_id, endpoint, completion_window) whose file exists."""
    known = requests.join(files.select(F.col("id").alias("input_file_id")), "input_file_id", "left_semi")
    null = F.lit(None).cast("long")
    return known.select(
        "id", "endpoint", "input_file_id", F.coalesce("completion_window", F.lit("24h")).alias("completion_window"), F.lit("in_progress").alias("status"), F.lit(None).cast("string").alias("output_file_id"),
        F.lit(None).cast("string").alias("error_file_id"), F.lit(at_ms).cast("long").alias("created_at"), F.lit(at_ms).cast("long").alias("in_progress_at"), null.alias("completed_at"), null.alias("cancelled_at"),
    )


def finished(batches: DataFrame, states: DataFrame, at_ms: int) -> DataFrame:
    """batches with those completed that are in progress, have requests and none left open. Cancelled ones stay cancelled."""
    by = states.groupBy("batch_id").agg(F.count_if(F.col("status").isin("pending", "leased")).alias("open"), F.count_if(F.col("status") == "dead_letter").alias("dead"), F.count(F.lit(1)).alias("all"))
    done = (F.col("status") == "in_progress") & (F.col("all") > 0) & (F.col("open") == 0)
    joined = batches.join(by, batches["id"] == by["batch_id"], "left")
    changed = {
        "status": F.when(done, "completed").otherwise(F.col("status")), "completed_at": F.when(done, F.lit(at_ms).cast("long")).otherwise(F.col("completed_at")),
        "output_file_id": F.when(done & (F.col("all") > F.col("dead")), F.concat(F.lit("file-out-"), "id")).otherwise(F.col("output_file_id")), "error_file_id": F.when(done & (F.col("dead") > 0), F.concat(F.lit("file-err-"), "id")).otherwise(F.col("error_file_id")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in batches.columns])


def cancelled(batches: DataFrame, id: str, at_ms: int) -> DataFrame:
    """batches with one cancelled, if it is in progress."""
    hit = (F.col("id") == id) & (F.col("status") == "in_progress")
    return batches.withColumns({"cancelled_at": F.when(hit, F.lit(at_ms).cast("long")).otherwise(F.col("cancelled_at")), "status": F.when(hit, "cancelled").otherwise(F.col("status"))})


def failed(batches: DataFrame, id: str) -> DataFrame:
    return batches.withColumn("status", F.when((F.col("id") == id) & (F.col("status") == "in_progress"), "failed").otherwise(F.col("status")))


def request_counts(states: DataFrame) -> DataFrame:
    return counts(states).select("total", F.col("done").alias("completed"), F.col("dead").alias("failed"))


def to_wire(items: DataFrame) -> DataFrame:
    """Leased items as a remote worker gets them: the lease's attempt is the generation that its result must name."""
    return items.select("custom_id", "method", "url", "body", F.col("attempts").alias("generation"))


def from_wire(items: DataFrame) -> DataFrame:
    return items.select("custom_id", "method", "url", "body", F.col("generation").alias("attempts"))


def to_post(results: DataFrame) -> DataFrame:
    """Results as a remote worker posts them; cached and reasoning tokens and the request id do not travel."""
    ok = F.col("kind") == "done"
    return results.select(
        "custom_id", F.col("attempt").alias("generation"), ok.alias("ok"), F.when(ok, F.col("status_code")).alias("status_code"), F.when(ok, F.col("body")).alias("body"), F.when(~ok, F.col("error_message")).alias("error"),
        "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms", "worker_id",
    )


def from_post(posts: DataFrame, at_ms: int) -> DataFrame:
    """Posted results as result rows; a failure is a worker error without usage or latency."""
    ok = F.col("ok")
    usage = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c)
    zero = F.lit(0).cast("long")
    return posts.select(
        "custom_id", F.when(ok, "done").otherwise("dead").alias("kind"), "status_code", F.lit(None).cast("string").alias("request_id"), "body", F.when(~ok, "worker_error").alias("error_code"), F.when(~ok, F.col("error")).alias("error_message"),
        usage("prompt_tokens"), usage("completion_tokens"), usage("total_tokens"), zero.alias("cached_tokens"), zero.alias("reasoning_tokens"), "worker_id", usage("latency_ms"), F.col("generation").alias("attempt"), F.lit(at_ms).cast("long").alias("completed_at"),
    )
