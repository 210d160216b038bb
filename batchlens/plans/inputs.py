"""Requests, results, ledger states, events and workers derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant at which states are judged.
NOW = 1_700_000_000_000
#: A total arrival order of results.
ARRIVAL = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str) -> F.Column:
    return F.floor(F.expr(column) + 0.5).cast("long")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of orders."""
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("ord-"), "o_orderkey").alias("custom_id"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of lineitems, dead where returned."""
    dead = F.col("l_returnflag") == "R"
    prompt, completion = whole("l_quantity * 10"), (F.col("l_linenumber") * 7).cast("long")
    zero = F.lit(0).cast("long")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("ord-"), "l_orderkey").alias("custom_id"), F.when(dead, "dead").otherwise("done").alias("kind"), F.when(~dead, F.lit(200)).alias("status_code"), F.lit(None).cast("string").alias("request_id"),
        F.when(~dead, F.concat(F.lit('{"n":'), "l_linenumber", F.lit("}"))).alias("body"), F.when(dead, "worker_error").alias("error_code"), F.when(dead, F.concat(F.lit("HTTP 5"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))).alias("error_message"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"), F.when(F.col("l_linestatus") == "O", F.floor(prompt / 4)).otherwise(zero).cast("long").alias("cached_tokens"), zero.alias("reasoning_tokens"),
        F.concat(F.lit("w"), "l_suppkey").alias("worker_id"), whole("l_tax * 10000").alias("latency_ms"), F.col("l_linenumber").cast("long").alias("attempt"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("completed_at"), *ARRIVAL,
    )


RES = """
res AS (SELECT 'ord-' || l_orderkey AS custom_id, CASE WHEN l_returnflag = 'R' THEN 'dead' ELSE 'done' END AS kind, CASE WHEN l_returnflag <> 'R' THEN 200 END AS status_code,
  CASE WHEN l_returnflag <> 'R' THEN '{"n":' || l_linenumber || '}' END AS body, CASE WHEN l_returnflag = 'R' THEN 'worker_error' END AS error_code,
  CASE WHEN l_returnflag = 'R' THEN 'HTTP 5' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') END AS error_message,
  CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) AS prompt_tokens, CAST(l_linenumber * 7 AS BIGINT) AS completion_tokens, CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) + CAST(l_linenumber * 7 AS BIGINT) AS total_tokens,
  CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_quantity * 10 + 0.5) AS BIGINT) // 4 ELSE 0 END AS cached_tokens, 'w' || l_suppkey AS worker_id, CAST(floor(l_tax * 10000 + 0.5) AS BIGINT) AS latency_ms,
  CAST(l_linenumber AS BIGINT) AS attempt, epoch_us(l_shipdate) // 1000 AS completed_at, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger states of orders."""
    k = F.col("o_orderkey")
    status = F.when(k % 10 <= 5, "done").when(k % 10 == 6, "dead_letter").when(k % 10 <= 8, "leased").otherwise("pending")
    until = F.when((k % 10).isin(7, 8) & (k % 13 != 0), F.lit(NOW) + ((k % 11) - 5) * 1000)
    error = F.when(k % 10 == 6, F.element_at(F.array(*[F.lit(e) for e in ERRORS]), (k % 5 + 1).cast("int")))
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("ord-"), k).alias("custom_id"), k.alias("ordinal"), status.alias("status"), (1 + F.col("o_custkey") % 3).alias("attempts"), until.cast("long").alias("leased_until"),
        F.when((k % 10).isin(7, 8) & (k % 7 != 0), F.concat(F.lit("w"), k % 4)).alias("leased_by"), error.alias("error"),
    )


ERRORS = ("HTTP 429 Too Many Requests", "HTTP 504 Gateway Timeout", "HTTP 400 (terminal): connection reset", "request error: operation timed out", "validation failed: the text is blank")
ERROR_LIST = "[" + ", ".join(f"'{e}'" for e in ERRORS) + "]"
ST = f"""
st AS (SELECT 'ord-' || o_orderkey AS custom_id, o_orderkey AS ordinal, CASE WHEN o_orderkey % 10 <= 5 THEN 'done' WHEN o_orderkey % 10 = 6 THEN 'dead_letter' WHEN o_orderkey % 10 <= 8 THEN 'leased' ELSE 'pending' END AS status,
  1 + o_custkey % 3 AS attempts, CASE WHEN o_orderkey % 10 IN (7, 8) AND o_orderkey % 13 <> 0 THEN CAST({NOW} + ((o_orderkey % 11) - 5) * 1000 AS BIGINT) END AS leased_until,
  CASE WHEN o_orderkey % 10 IN (7, 8) AND o_orderkey % 7 <> 0 THEN 'w' || (o_orderkey % 4) END AS leased_by, CASE WHEN o_orderkey % 10 = 6 THEN {ERROR_LIST}[CAST(o_orderkey % 5 + 1 AS INTEGER)] END AS error FROM orders)"""
#: The same rules in SQL, in their order.
CLASSIFY = """CASE WHEN contains(e, 'validation failed') THEN 'validation' WHEN contains(e, 'http 429') OR contains(e, 'too many requests') THEN 'rate_limited' WHEN contains(e, 'http 408') THEN 'timeout'
  WHEN contains(e, 'http 5') THEN 'server_error' WHEN regexp_matches(e, 'request error|connect|refused|reset|dns') THEN CASE WHEN regexp_matches(e, 'timed out|timeout') THEN 'timeout' ELSE 'connection' END
  WHEN contains(e, '(terminal)') OR contains(e, 'http 4') THEN 'client_error' WHEN regexp_matches(e, 'timed out|timeout') THEN 'timeout' ELSE 'other' END"""


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error texts of events by their type."""
    kind = F.col("event_type")
    text = F.when(kind == "click", ERRORS[0]).when(kind == "error", ERRORS[1]).when(kind == "purchase", ERRORS[2]).when(kind == "signup", ERRORS[3]).otherwise(ERRORS[4])
    return read(spark, sf_dir, "events").select("event_id", text.alias("error"))


FAIL = f"""
fl AS (SELECT event_id, CASE event_type WHEN 'click' THEN '{ERRORS[0]}' WHEN 'error' THEN '{ERRORS[1]}' WHEN 'purchase' THEN '{ERRORS[2]}' WHEN 'signup' THEN '{ERRORS[3]}' ELSE '{ERRORS[4]}' END AS error FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger events, legal and illegal ones, of users. seq orders by time and id in one number."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    lease = kind == "view"
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("u-"), "user_id").alias("custom_id"), (at * 1_000_000 + F.col("event_id") % 1_000_000).alias("seq"), F.when(kind == "signup", "enqueue").when(lease, "lease").when(kind == "click", "ack").when(kind == "purchase", "dead").otherwise("reap").alias("kind"),
        (1 + F.floor("value") % 3).cast("long").alias("attempt"), at.alias("at_ms"), F.when(lease, at + 21_600_000).alias("leased_until"), F.when(lease, F.concat(F.lit("w"), F.col("event_id") % 5)).alias("leased_by"), F.when(kind == "purchase", "HTTP 500").alias("error"),
    )


LOG = """
lg AS (SELECT 'u-' || user_id AS custom_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n, event_id, event_type AS kind, CAST(1 + floor(value) % 3 AS BIGINT) AS attempt, epoch_us(ts) // 1000 AS at_ms FROM events)"""


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as workers."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey").cast("long")).alias("load"), (1 + F.col("s_suppkey") % 4).alias("cap"), (F.col("s_suppkey") % 9 != 0).alias("ready"))


WRK = """
wk AS (SELECT s_suppkey AS worker, CASE WHEN s_nationkey % 5 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS load, 1 + s_suppkey % 4 AS cap, s_suppkey % 9 <> 0 AS ready FROM supplier)"""


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as request lines: value, line_no (conv_id)."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    body = F.struct(F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
    line = F.to_json(F.struct(F.concat(F.lit("conv-"), "conv_id").alias("custom_id"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    return turns.select(F.col("conv_id").alias("line_no"), line.alias("value"))


def foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of foreign batch files, some broken: line_no (doc_id) and value."""
    k = F.col("doc_id")
    name = F.concat(F.when(k % 17 == 0, F.lit("bad doc ")).otherwise(F.lit("doc-")), F.when(k % 29 == 1, k - 1).otherwise(k))
    text = F.col("text")
    native = F.to_json(F.struct(name.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages")).alias("body")))
    params = F.to_json(F.struct(name.alias("custom_id"), F.struct(text.alias("prompt")).alias("params")))
    record = F.to_json(F.struct(name.alias("recordId"), F.struct(text.alias("input")).alias("modelInput")))
    line = F.when(k % 3 == 0, native).when(k % 3 == 1, params).otherwise(record)
    return read(spark, sf_dir, "documents").select(k.alias("line_no"), F.when(k % 23 == 0, line.substr(F.lit(1), F.length(line) - 2)).otherwise(line).alias("value"))


FOREIGN = """
fd AS (SELECT doc_id AS line_no, doc_id % 3 AS shape, doc_id % 17 = 0 AS bad_id, doc_id % 23 = 0 AS cut, CASE WHEN doc_id % 17 = 0 THEN 'bad doc ' ELSE 'doc-' END || CASE WHEN doc_id % 29 = 1 THEN doc_id - 1 ELSE doc_id END AS name FROM documents),
fv AS (SELECT *, NOT bad_id AND NOT cut AS ok, CASE WHEN NOT bad_id AND NOT cut THEN row_number() OVER (PARTITION BY name, NOT bad_id AND NOT cut ORDER BY line_no) END AS rn FROM fd)"""
