"""Streaming forms: ledger events folded with state and expiry, results appended once, requests read on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from batchlens.operators.results import append
from batchlens.sources.jsonl import parse, register

STATE = "status string, attempts long, leased_until long, leased_by string, error string"
OUT = "custom_id string, seq long, " + STATE


def _apply(s: tuple, e) -> tuple:
    status, attempts, until, by, error = s
    lapsed = status == "leased" and until is not None and until < e.at_ms
    ours = status == "leased" and attempts == e.attempt
    if e.kind == "enqueue" and status is None:
        return "pending", 0, None, None, None
    if e.kind == "lease" and (status == "pending" or lapsed):
        return "leased", attempts + 1, int(e.leased_until), e.leased_by, error
    if e.kind == "ack" and ours:
        return "done", attempts, None, None, None
    if e.kind == "dead" and ours:
        return "dead_letter", attempts, None, None, e.error
    if e.kind == "reap" and lapsed:
        return "pending", attempts, None, None, error
    return s


def _fold(timers: bool):
    """The fold of one id's events; with timers, a lease that is still held when event time passes its expiry is given back."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *s, seq = state.get if state.exists else (None, 0, None, None, None, -1)
        if state.hasTimedOut:
            s = ("pending", s[1], None, None, s[4])
        else:
            # A repeated event has no effect.
            events = pd.concat(list(frames)).sort_values("seq")
            for e in events[events["seq"] > seq].itertuples():
                s, seq = _apply(tuple(s), e), int(e.seq)
            if timers and s[0] == "leased" and s[2] is not None:
                if s[2] < state.getCurrentWatermarkMs():
                    s = ("pending", s[1], None, None, s[4])
                else:
                    state.setTimeoutTimestamp(s[2] + 1)
        state.update((*s, seq))
        if s[0] is not None:
            yield pd.DataFrame([(key[0], seq, *s)], columns=[c.split()[0] for c in OUT.split(", ")]).astype({"attempts": "Int64", "leased_until": "Int64"})

    return run


def ledger_states(events: DataFrame, late: str | None = None) -> DataFrame:
    """A stream of states from a stream of events: a row for each id whose events came in a micro-batch.

    With `late`, how late events may come ("10 minutes"), expired leases are reaped as event time goes on: once all of
    the stream is later than a lease's expiry, its id is pending again and gets a row, without an event of its own.
    """
    if late is None:
        return events.groupBy("custom_id").applyInPandasWithState(_fold(False), OUT, STATE + ", seq long", "update", GroupStateTimeout.NoTimeout)
    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("custom_id").applyInPandasWithState(_fold(True), OUT, STATE + ", seq long", "update", GroupStateTimeout.EventTimeTimeout)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A stream of parsed request lines that reads on where the last run's checkpoint ended."""
    register(spark)
    return parse(spark.readStream.format("request_lines").option("path", path).load())


def append_results(results: DataFrame, store: str, order: list[str], checkpoint: str, job: str = "job"):
    """Start writing a stream of results into a store, each id once, however often micro-batches are repeated."""

    def once(batch: DataFrame, _: int) -> None:
        append(batch.sparkSession, batch, store, order, job)

    return results.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
