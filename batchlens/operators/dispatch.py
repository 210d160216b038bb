"""Assigning items to workers, and replays of the controls that pace them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

UNKNOWN = 4294967295


def free_slots(workers: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Ready workers (worker, cap, load) with cap as the slots that are free."""
    busy = in_flight.groupBy("worker").agg(F.count(F.lit(1)).alias("busy"))
    out = workers.filter("ready").join(busy, "worker", "left")
    return out.select("worker", F.greatest(F.greatest("cap", F.lit(1)) - F.coalesce("busy", F.lit(0)), F.lit(0)).alias("cap"), "load")


def assign(workers: DataFrame, n_items: int, base: int = 0, load_aware: bool = True, fall_back: bool = True) -> DataFrame:
    """item (from 0) and worker for n_items items over workers (worker, load, cap).

    Without a load signal slots are dealt in rotation, each worker's k-th slot in the k-th round; if there are more
    items than slots, plainly in rotation. With one, the least loaded worker's slots come first, workers of unknown load
    last, and what exceeds all slots goes round in that order. If no load at all is known, they are dealt as without a
    signal; with `fall_back` off the order by load stands even then. Workers are numbered by their id, null last; a cap
    below 1 is no slot.
    """
    ready = workers.withColumn("w", F.row_number().over(W.orderBy(F.asc_nulls_last("worker"))) - 1)
    # A fleet is a small table; its size and slots decide the branch.
    n, total, known = ready.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest("cap", F.lit(0))), F.lit(0)), F.count("load")).first()
    if not n or n_items <= 0:
        return workers.limit(0).select(F.lit(0).cast("long").alias("item"), "worker")
    spark = workers.sparkSession
    turn = F.pmod(F.col("w") - base, F.lit(n))
    biased = load_aware and (known > 0 or not fall_back)
    slots = ready.filter("cap > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cap").cast("int") - 1)))
    if not biased and n_items > total:
        items = spark.range(n_items).withColumn("w", (F.col("id") + base) % n)
        return items.join(ready, "w").select(F.col("id").alias("item"), "worker")
    order = [F.coalesce("load", F.lit(UNKNOWN)), turn, F.col("k")] if biased else [F.col("k"), turn]
    dealt = slots.withColumn("item", (F.row_number().over(W.orderBy(*order)) - 1).cast("long")).filter(F.col("item") < n_items).select("item", "worker")
    if n_items <= total:
        return dealt
    ranked = ready.withColumn("r", F.row_number().over(W.orderBy(F.coalesce("load", F.lit(UNKNOWN)), turn)) - 1)
    rest = spark.range(int(total), n_items).withColumn("r", F.col("id") % n)
    return dealt.unionByName(rest.join(ranked, "r").select(F.col("id").alias("item"), "worker"))


def aimd(outcomes: DataFrame, ceiling: int, grow_after: int = 8) -> DataFrame:
    """Per worker the in-flight limit after its outcomes (worker, seq, ok) in order: one more after a streak, half after a failure.

    Outcomes are sorted by worker and order in the shuffle and streamed through with two numbers of state, so a busy
    worker is no array in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, limit, streak, out, kind = None, ceiling, 0, [], pa.null()
        for batch in batches:
            kind = batch.schema.field("worker").type
            for worker, ok in zip(batch.column("worker").to_pylist(), batch.column("ok").to_pylist(), strict=True):
                if worker != now:
                    out += [(now, limit, streak)] if now is not None else []
                    now, limit, streak = worker, ceiling, 0
                if not ok:
                    limit, streak = max(limit // 2, 1), 0
                elif streak + 1 >= grow_after and limit < ceiling:
                    limit, streak = limit + 1, 0
                else:
                    streak += 1
        out += [(now, limit, streak)] if now is not None else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((kind, pa.int64(), pa.int64()))], ["worker", "limit", "streak"])

    dealt = outcomes.select("worker", "seq", "ok").filter("worker IS NOT NULL").repartition("worker").sortWithinPartitions("worker", "seq")
    return dealt.mapInArrow(run, f"worker {dict(outcomes.dtypes)['worker']}, limit long, streak long")


def cooldown_until(signals: DataFrame) -> DataFrame:
    """signals (worker, seq, at_ms, pause_ms) with blocked_until, the latest end of any pause so far."""
    order = W.partitionBy("worker").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return signals.withColumn("blocked_until", F.max(F.col("at_ms") + F.col("pause_ms")).over(order))


def rate_ceiling(requests: DataFrame, rate: float) -> DataFrame:
    """requests (worker, seq, at_ms) with start_ms under a rate per second that allows bursts of one second's worth.

    The k-th request starts at the earliest when a bucket that fills at `rate` has let all before it through: a running
    maximum of at_ms - k / rate, k counted from the burst on.
    """
    order = W.partitionBy("worker").orderBy("seq")
    k = F.row_number().over(order) - 1
    gap = 1000.0 / rate
    shifted = requests.withColumn("k", k).withColumn("lead", F.col("at_ms") - F.col("k") * gap)
    best = F.max("lead").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    burst = max(int(rate), 1) - 1
    return shifted.withColumn("start_ms", F.greatest(F.col("at_ms").cast("double"), best + (F.col("k") - burst) * gap)).drop("k", "lead")


def lease_ttl_of(results: DataFrame, base_ms: int = 300_000, most_ms: int = 1_800_000) -> DataFrame:
    """The lease time of the next round from all latencies seen."""
    from batchlens.functions.scalars import lease_ttl

    return results.agg(F.coalesce(F.max("latency_ms"), F.lit(0)).alias("peak_ms")).select("peak_ms", lease_ttl(F.col("peak_ms"), base_ms, most_ms).alias("ttl_ms"))
