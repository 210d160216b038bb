"""Calling endpoints: a deterministic stand-in as column expressions, and an HTTP client partition by partition."""

from __future__ import annotations

import http.client
import json
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions.json_text import strict_error
from batchlens.functions.scalars import endpoint_kind
from batchlens.schemas import CHECKS

OUT = "custom_id string, kind string, status_code int, request_id string, body string, error_code string, error_message string, worker_id string, latency_ms long, attempt long, tries int, completed_at long"


def replay(items: DataFrame, worker_id: str = "replay", at_ms: int = 0) -> DataFrame:
    """Results that depend on the request alone: every id whose CRC-32 is divisible by 17 fails."""
    h = F.crc32(F.col("custom_id").cast("binary"))
    fails = h % 17 == 0
    kind = endpoint_kind(F.col("url"))
    text = F.concat(F.lit("echo "), F.col("custom_id"))
    body = F.when(kind == "embeddings", F.to_json(F.struct(F.array(F.struct(F.array(h / 4294967295.0).alias("embedding"))).alias("data")))).when(kind == "completions", F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("choices")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))))
    prompt, completion = F.length("body").cast("long"), (h % 50).cast("long")
    zero = lambda c: F.when(fails, F.lit(0).cast("long")).otherwise(c)
    return items.select(
        "custom_id", F.when(fails, "dead").otherwise("done").alias("kind"), F.when(~fails, F.lit(200)).alias("status_code"), F.lit(None).cast("string").alias("request_id"), F.when(~fails, body).alias("body"),
        F.when(fails, "worker_error").alias("error_code"), F.when(fails, "HTTP 400 (terminal): refused by rule").alias("error_message"), zero(prompt).alias("prompt_tokens"), zero(completion).alias("completion_tokens"), zero(prompt + completion).alias("total_tokens"),
        F.lit(0).cast("long").alias("cached_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"), F.lit(worker_id).alias("worker_id"), (h % 900 + 100).cast("long").alias("latency_ms"), F.lit(1).cast("long").alias("attempt"), F.lit(at_ms).cast("long").alias("completed_at"),
    )


@dataclass
class Endpoint:
    """Where and how to call: tries per lease, backoff, concurrency and limits on time."""

    base_url: str
    worker_id: str = "http"
    api_key: str | None = None
    tries: int = 5
    base_ms: int = 500
    cap_ms: int = 30_000
    concurrency: int = 8
    timeout_s: float = 600.0
    per_second: float | None = None
    check: str = "any"
    seed: int = 7

    def __post_init__(self):
        if self.check not in CHECKS:
            raise ValueError(f"{self.check} is no check")


def _retryable(status: int) -> bool:
    return status in (429, 408) or 500 <= status <= 599


class Limit:
    """What all calls of a task share: how many may be in flight, and until when none may start.

    One more may be in flight after eight successes in a row, half after a congestion signal. Calls in flight above a
    lowered limit are not cut off; no new one starts until enough have ended.
    """

    def __init__(self, ceiling: int, grow_after: int = 8):
        self.ceiling, self.now, self.streak, self.grow_after = max(ceiling, 1), max(ceiling, 1), 0, grow_after
        self.busy, self.until, self.lock = 0, 0.0, threading.Lock()

    def start(self) -> bool:
        with self.lock:
            if self.busy >= self.now or time.monotonic() < self.until:
                return False
            self.busy += 1
            return True

    def end(self) -> None:
        with self.lock:
            self.busy -= 1

    def record(self, ok: bool) -> None:
        with self.lock:
            if not ok:
                self.now, self.streak = max(self.now // 2, 1), 0
                return
            self.streak += 1
            if self.streak >= self.grow_after and self.now < self.ceiling:
                self.now, self.streak = self.now + 1, 0

    def pause(self, seconds: float) -> None:
        with self.lock:
            self.until = max(self.until, time.monotonic() + seconds)

    def rest(self) -> float:
        return max(0.0, self.until - time.monotonic())


def _kind(url: str) -> str:
    """The kind of endpoint a path names; chat where it names none."""
    return next((kind for part, kind in (("/embeddings", "embeddings"), ("/chat/completions", "chat"), ("/completions", "completions"), ("/messages", "messages")) if part in url), "chat")


def _within(value: object, *path: str | int) -> object:
    """What a parsed body has at a path, whatever its shape; None where there is nothing."""
    for step in path:
        fits = isinstance(value, dict) and step in value if isinstance(step, str) else isinstance(value, list) and len(value) > step
        if not fits:
            return None
        value = value[step]
    return value


def problem(check: str, kind: str, body: object) -> str | None:
    """Why a parsed response fails a check, or None if it passes: the rules of json_text.response_problem for one body."""
    if check == "any":
        return None
    if kind == "embeddings":
        vector = _within(body, "data", 0, "embedding")
        return None if isinstance(vector, list) and vector else "the embedding is empty" if vector == [] else "no embedding in the response"
    text = _within(body, *{"messages": ("content", 0, "text"), "chat": ("choices", 0, "message", "content"), "completions": ("choices", 0, "text")}[kind])
    if not isinstance(text, str):
        return "no text block in the response" if kind == "messages" else "no choice in the response" if _within(body, "choices", 0) is None else "the choice holds no text"
    if not text.strip():
        return "the text is blank"
    return "the text is no JSON" if check == "json" and strict_error(text) else None


def _call(endpoint: Endpoint, limit: Limit, item: dict, draw: random.Random) -> dict:
    path = item["url"] or "/v1/chat/completions"
    began, last, tries = time.monotonic(), "no try was made", 0
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {endpoint.api_key}"} if endpoint.api_key else {})
    out = {"custom_id": item["custom_id"], "kind": "dead", "status_code": None, "request_id": None, "body": None, "error_code": "worker_error", "error_message": None, "worker_id": endpoint.worker_id, "latency_ms": 0, "attempt": item["attempts"], "tries": 0, "completed_at": 0}
    for tries in range(1, max(endpoint.tries, 1) + 1):
        time.sleep(limit.rest())
        try:
            request = urllib.request.Request(endpoint.base_url.rstrip("/") + path, (item["body"] or "").encode(), head, method=item["method"])
            with urllib.request.urlopen(request, timeout=endpoint.timeout_s) as answer:
                text, status, request_id = answer.read().decode(), answer.status, answer.headers.get("x-request-id")
            limit.record(True)
            wrong = problem(endpoint.check, _kind(path), json.loads(text))  # a body that is no JSON ends the lease at once
            if wrong is None:
                return out | {"kind": "done", "status_code": status, "request_id": request_id, "body": text, "error_code": None, "latency_ms": int((time.monotonic() - began) * 1000), "tries": tries, "completed_at": int(time.time() * 1000)}
            last = f"validation failed: {wrong}"  # no congestion signal
        except urllib.error.HTTPError as error:
            if not _retryable(error.code):
                return out | {"error_message": f"HTTP {error.code} (terminal): {error.read().decode(errors='replace')[:300]}", "tries": tries}
            limit.record(False)
            last = f"HTTP {error.code}"
            after = (error.headers.get("retry-after") or "").strip()
            if after.isdigit():
                limit.pause(min(float(after), 120.0))
        except (ValueError, RecursionError) as error:
            return out | {"error_message": f"decode error: {error}", "tries": tries}
        except (OSError, http.client.HTTPException) as error:  # a reply that breaks off included
            limit.record(False)
            last = f"request error: {error}"
        if tries < endpoint.tries:
            time.sleep(draw.random() * min(endpoint.cap_ms, endpoint.base_ms * 2 ** (tries - 1)) / 1000)
    return out | {"error_message": f"gave up after {tries} tries: {last}", "tries": tries}


def call(items: DataFrame, endpoint: Endpoint, parts: int | None = None) -> DataFrame:
    """Results of leased items (custom_id, method, url, body, attempts) from an HTTP endpoint.

    Every partition keeps up to `concurrency` calls in flight, fewer while the endpoint shows overload, and starts the
    next one as soon as one ends, so a slow call holds up no other. A pause that the endpoint asks for holds for all of
    the partition's calls. Results come as they end. A task that is run again calls again; the sink keeps the first
    result of each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, draw, due, flying = Limit(endpoint.concurrency), random.Random(endpoint.seed), 0.0, set()
        rows = (row for batch in batches for row in batch.to_pylist())
        with ThreadPoolExecutor(endpoint.concurrency) as pool:
            row = next(rows, None)
            while row is not None or flying:
                while row is not None and time.monotonic() >= due and limit.start():
                    call = pool.submit(_call, endpoint, limit, row, draw)
                    call.add_done_callback(lambda _: limit.end())
                    flying.add(call)
                    due = max(due, time.monotonic() - 1.0) + 1.0 / endpoint.per_second if endpoint.per_second else 0.0
                    row = next(rows, None)
                if not flying:
                    time.sleep(max(limit.rest(), due - time.monotonic(), 0.001))
                    continue
                ended, flying = wait(flying, timeout=max(due - time.monotonic(), 0.001) if endpoint.per_second and row is not None else 0.05, return_when=FIRST_COMPLETED)
                if ended:
                    yield pa.RecordBatch.from_pylist([call.result() for call in ended], schema=SCHEMA)

    items = items.select("custom_id", "method", "url", "body", "attempts")
    return (items.repartition(parts) if parts else items).mapInArrow(run, OUT)


SCHEMA = pa.schema([("custom_id", pa.string()), ("kind", pa.string()), ("status_code", pa.int32()), ("request_id", pa.string()), ("body", pa.string()), ("error_code", pa.string()), ("error_message", pa.string()), ("worker_id", pa.string()), ("latency_ms", pa.int64()), ("attempt", pa.int64()), ("tries", pa.int32()), ("completed_at", pa.int64())])


def probe(endpoints: DataFrame, timeout_s: float = 2.0) -> DataFrame:
    """endpoints (worker, base_url, health_path) with ready: whether the health path answers 2xx. A fleet is a small table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready = []
            for base, path in zip(batch.column("base_url").to_pylist(), batch.column("health_path").to_pylist(), strict=True):
                try:
                    with urllib.request.urlopen(base.rstrip("/") + (path or "/health"), timeout=timeout_s) as answer:
                        ready.append(200 <= answer.status < 300)
                except OSError:
                    ready.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("worker"), pa.array(ready)], ["worker", "ready"])

    return endpoints.select("worker", "base_url", "health_path").mapInArrow(run, "worker long, ready boolean")
