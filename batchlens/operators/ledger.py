"""The request ledger: an append-only log of events, folded into states, and the reports over them.

An event takes effect only if it is legal in the state it meets: enqueue when the id is unknown, lease when pending or
leased and expired, ack and dead when leased under the same attempt number, reap when leased and expired. All others
are void, which makes stale workers harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from batchlens.functions.scalars import classify_failure, is_terminal

STATE = "struct<status:string,attempts:bigint,leased_until:bigint,leased_by:string,error:string>"


def _step(s: Column, e: Column) -> Column:
    kind = e["kind"]
    lapsed = (s["status"] == "leased") & (s["leased_until"] < e["at_ms"])
    ours = (s["status"] == "leased") & (s["attempts"] == e["attempt"])
    void = F.lit(None)

    def state(status: str, attempts: Column, until: Column = void, by: Column = void, error: Column = void) -> Column:
        return F.struct(F.lit(status).alias("status"), attempts.alias("attempts"), until.cast("bigint").alias("leased_until"), by.cast("string").alias("leased_by"), error.cast("string").alias("error")).cast(STATE)

    return (
        F.when((kind == "enqueue") & s["status"].isNull(), state("pending", F.lit(0).cast("bigint")))
        .when((kind == "lease") & ((s["status"] == "pending") | lapsed), state("leased", s["attempts"] + 1, e["leased_until"], e["leased_by"], s["error"]))
        .when((kind == "ack") & ours, state("done", s["attempts"]))
        .when((kind == "dead") & ours, state("dead_letter", s["attempts"], error=e["error"]))
        .when((kind == "reap") & lapsed, state("pending", s["attempts"], error=s["error"]))
        .otherwise(s)
    )


def fold(events: DataFrame) -> DataFrame:
    """The state of every id that was enqueued. One shuffle by id; an id's events are ordered by seq inside its group."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "kind", "attempt", "at_ms", "leased_until", "leased_by", "error")))
    folded = events.groupBy("custom_id").agg(F.aggregate(listed, F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (x.split(":") for x in STATE[7:-1].split(","))]), _step).alias("s"))
    return folded.filter("s.status IS NOT NULL").select("custom_id", "s.*")


def enqueue(states: DataFrame, items: DataFrame, first_seq: int, at_ms: int) -> DataFrame:
    """Enqueue events of ids that states does not have, first occurrence by ordinal."""
    new = items.groupBy("custom_id").agg(F.min("ordinal").alias("ordinal")).join(states.select("custom_id"), "custom_id", "left_anti")
    return new.select("custom_id", (F.col("ordinal") + first_seq).alias("seq"), F.lit("enqueue").alias("kind"), F.lit(0).cast("long").alias("attempt"), F.lit(at_ms).cast("long").alias("at_ms"), *_nulls())


def _nulls() -> list[Column]:
    return [F.lit(None).cast("long").alias("leased_until"), F.lit(None).cast("string").alias("leased_by"), F.lit(None).cast("string").alias("error")]


def eligible(now_ms: int) -> Column:
    """Pending, or leased with an expiry before now (no expiry is never before)."""
    return (F.col("status") == "pending") | ((F.col("status") == "leased") & F.coalesce(F.col("leased_until") < now_ms, F.lit(False)))


def pick(states: DataFrame, n: int, now_ms: int, policy: str = "fifo") -> DataFrame:
    """The next n ids to lease, by ordinal (`fifo`) or with expired ones first (`expired_first`): one top-n, no full sort."""
    ready = states.filter(eligible(now_ms))
    order = [F.col("ordinal")] if policy == "fifo" else [(F.col("status") == "leased").desc(), F.col("ordinal")]
    return ready.orderBy(*order).limit(n)


def lease(states: DataFrame, n: int, now_ms: int, ttl_ms: int, holder: str, policy: str = "fifo") -> DataFrame:
    """States after leasing: the picked ids with a new attempt, expiry and holder."""
    picked = pick(states, n, now_ms, policy)
    return picked.withColumn("status", F.lit("leased")).withColumn("attempts", F.col("attempts") + 1).withColumn("leased_until", F.lit(now_ms + ttl_ms).cast("long")).withColumn("leased_by", F.lit(holder))


def close(states: DataFrame, posts: DataFrame, kind: str = "ack") -> DataFrame:
    """posts (custom_id, attempt) with `applied`: whether closing is legal, that is, leased under that attempt."""
    held = states.select("custom_id", "status", "attempts")
    return posts.join(held, "custom_id", "left").select("custom_id", "attempt", F.coalesce((F.col("status") == "leased") & (F.col("attempts") == F.col("attempt")), F.lit(False)).alias("applied"), F.lit(kind).alias("kind"))


def reap(states: DataFrame, now_ms: int) -> DataFrame:
    """States with expired leases pending again, attempts kept."""
    lapsed = (F.col("status") == "leased") & F.coalesce(F.col("leased_until") < now_ms, F.lit(False))
    gone, keep = F.col("reaped"), lambda c: F.when(~F.col("reaped"), F.col(c))
    return states.withColumn("reaped", lapsed).withColumns({"status": F.when(gone, "pending").otherwise(F.col("status")), "leased_until": keep("leased_until"), "leased_by": keep("leased_by")})


def counts(states: DataFrame) -> DataFrame:
    """One row: pending, leased, done, dead, total, drained."""
    by = states.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pending", "pending"), ("leased", "leased"), ("done", "done"), ("dead_letter", "dead"))])
    return by.withColumn("total", F.col("pending") + F.col("leased") + F.col("done") + F.col("dead")).withColumn("drained", (F.col("pending") == 0) & (F.col("leased") == 0))


def attempt_histogram(states: DataFrame) -> DataFrame:
    """attempts and n over terminal rows."""
    return states.filter(is_terminal(F.col("status"))).groupBy("attempts").agg(F.count(F.lit(1)).alias("n"))


def failure_breakdown(rows: DataFrame) -> DataFrame:
    """reason and n over rows with an error column, most frequent first."""
    return rows.groupBy(classify_failure(F.col("error")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def resume_audit(states: DataFrame, now_ms: int) -> DataFrame:
    """One row: counts with live_leases, orphaned_leases, reclaimable and interrupted. A lease that ends just now is orphaned here."""
    leased = F.col("status") == "leased"
    live = leased & F.coalesce(F.col("leased_until") > now_ms, F.lit(False))
    out = states.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pending", "pending"), ("leased", "leased"), ("done", "done"), ("dead_letter", "dead"))], F.count_if(live).alias("live_leases"), F.count_if(leased & ~live).alias("orphaned_leases"))
    return out.withColumn("reclaimable", F.col("pending") + F.col("orphaned_leases")).withColumn("interrupted", F.col("orphaned_leases") > 0)


def live_holders(states: DataFrame, now_ms: int) -> DataFrame:
    """holder and n of live leases, most first."""
    live = states.filter((F.col("status") == "leased") & (F.col("leased_until") > now_ms))
    return live.groupBy(F.coalesce("leased_by", F.lit("(unknown)")).alias("holder")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "holder")


def status_report(states: DataFrame) -> DataFrame:
    """One row: counts, retried, success_rate (null before anything ended), attempt histogram and failure reasons as maps. One pass."""
    end, dead = is_terminal(F.col("status")), F.col("status") == "dead_letter"
    by = states.groupBy("status", F.when(end, F.col("attempts")).alias("attempts"), F.when(dead, classify_failure(F.col("error"))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    sums = by.agg(*[total(F.col("status") == s).alias(n) for s, n in (("pending", "pending"), ("leased", "leased"), ("done", "done"), ("dead_letter", "dead"))], total(F.col("attempts") > 1).alias("retried"), F.collect_list(F.struct("attempts", "reason", "n")).alias("cells"))

    def summed(field: str) -> Column:
        cells = F.filter("cells", lambda c: c[field].isNotNull())
        keys = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c[field])))
        value = lambda k: F.aggregate(F.filter("cells", lambda c: c[field] == k), F.lit(0).cast("long"), lambda a, c: a + c["n"])
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value"))))

    ended = F.col("done") + F.col("dead")
    return sums.select("pending", "leased", "done", "dead", "retried", F.when(ended > 0, F.col("done") / ended).alias("success_rate"), summed("attempts").alias("attempt_histogram"), summed("reason").alias("failure_reasons"))


def metrics_text(report: DataFrame, prefix: str = "batchlens") -> DataFrame:
    """A status report as Prometheus text: one row of one column."""
    state = [F.format_string(f'{prefix}_items{{state="{s}"}} %d', F.col(s)) for s in ("pending", "leased", "done", "dead")]
    reasons = F.transform(F.map_entries("failure_reasons"), lambda e: F.concat(F.lit(f'{prefix}_failures{{reason="'), e["key"], F.lit('"} '), e["value"].cast("string")))
    rate = F.when(F.col("success_rate").isNotNull(), F.array(F.lit(f"# HELP {prefix}_success_rate Terminal success ratio."), F.lit(f"# TYPE {prefix}_success_rate gauge"), F.concat(F.lit(f"{prefix}_success_rate "), F.col("success_rate").cast("string")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.lit(f"# HELP {prefix}_items Items by state."), F.lit(f"# TYPE {prefix}_items gauge"), *state, F.lit(f"# HELP {prefix}_failures Dead letters by reason."), F.lit(f"# TYPE {prefix}_failures gauge")),
        reasons, F.array(F.lit(f"# HELP {prefix}_retried Ended items that took more than one attempt."), F.lit(f"# TYPE {prefix}_retried gauge"), F.format_string(f"{prefix}_retried %d", F.col("retried"))), rate,
    )
    return report.select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def json_report(report: DataFrame) -> DataFrame:
    """Any one-row report as one JSON line, nulls present."""
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def job_totals(results: DataFrame) -> DataFrame:
    """One row over a run's results: done, dead and tokens of done rows."""
    done = F.col("kind") == "done"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long")
    return results.agg(F.count_if(done).alias("done"), F.count_if(F.col("kind") == "dead").alias("dead"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"))


def resume_settings(jobs: DataFrame, out: str | None, concurrency: int | None) -> DataFrame:
    """Where a resumed job writes and how wide it runs: its recorded output first; the given width first, then the recorded one, then 256."""
    return jobs.select("job", F.coalesce("output", F.lit(out)).alias("output"), F.coalesce(F.lit(concurrency), F.col("concurrency"), F.lit(256)).cast("long").alias("concurrency"))


def latest_checkpoint(shards: DataFrame) -> DataFrame:
    """The furthest byte and line a file was read to."""
    return shards.agg(F.max_by(F.struct("byte_end", "line_end"), "byte_end").alias("m")).select("m.*")


def with_job(jobs: DataFrame, job: str, started_at: int, output: str | None = None, concurrency: int | None = None) -> DataFrame:
    """jobs (job, started_at, output, concurrency) with one put in or brought up to date: a known job keeps its start, and what is not given keeps its value."""
    row = jobs.sparkSession.createDataFrame([(job, started_at, output, concurrency)], "job string, started_at long, output string, concurrency long")
    both = jobs.select(*row.columns, F.lit(0).alias("new")).unionByName(row.withColumn("new", F.lit(1)))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("new"))).alias(c)
    return both.groupBy("job").agg(F.min_by("started_at", "new").alias("started_at"), latest("output"), latest("concurrency"))


def status_line(report: DataFrame) -> DataFrame:
    """A status report as one line for people: text."""
    shown = F.array_join(F.transform(F.map_entries("failure_reasons"), lambda e: F.concat(e["key"], F.lit(" x"), e["value"].cast("string"))), ", ")
    rate = F.when(F.col("success_rate").isNotNull(), F.concat(F.round(F.col("success_rate") * 100, 1).cast("string"), F.lit("%"))).otherwise("none ended")
    parts = [F.concat(F.col(c).cast("string"), F.lit(f" {c}")) for c in ("pending", "leased", "done", "dead", "retried")]
    return report.select(F.concat(F.concat_ws(" | ", *parts), F.lit(" | success "), rate, F.when(shown != "", F.concat(F.lit(" | "), shown)).otherwise("")).alias("text"))
