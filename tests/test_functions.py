"""Goldens of the scalar rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from batchlens.functions import json_text as J
from batchlens.functions import scalars as X
from batchlens.functions.json_text import fnv1a, strict_error


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "ok"), [("a", True), ("a" * 64, True), ("a" * 65, False), ("", False), ("has space", False), ("é", False), ("a\n", False), (None, False)])
def test_custom_id(spark, text, ok):
    assert one(spark, X.valid_custom_id(F.lit(text).cast("string"))) is ok


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("validation failed: empty", "validation"), ("HTTP 429 Too Many Requests", "rate_limited"), ("HTTP 504 Gateway Timeout", "server_error"), ("HTTP 408", "timeout"), ("request error: operation timed out", "timeout"),
        ("request error: connection refused", "connection"), ("HTTP 400 (terminal): bad", "client_error"), ("HTTP 400 (terminal): connection reset", "connection"), ("retries exhausted after 429 attempt(s): HTTP 500", "server_error"), ("timed out", "timeout"), ("odd", "other"), (None, "other"),
    ],
)
def test_failure(spark, text, label):
    assert one(spark, X.classify_failure(F.lit(text).cast("string"))) == label


@pytest.mark.parametrize(("text", "ms"), [("1s", 1000.0), ("6m0s", 360000.0), ("500ms", 500.0), ("2", 2000.0), ("2m59.56s", 179560.0), ("", None), ("soon", None), ("0", 0.0), ("0s", None), ("6m5", 360000.0), ("1h", 3600000.0), ("-1", None)])
def test_reset(spark, text, ms):
    found = one(spark, X.reset_ms(F.lit(text)))
    assert found is None and ms is None or found == pytest.approx(ms)


@pytest.mark.parametrize(
    ("headers", "ms"),
    [
        ({"retry-after": "3"}, 3000.0), ({"retry-after": "3.5"}, None), ({"retry-after": "999999"}, 120000.0), ({"x-ratelimit-remaining-tokens": "5", "x-ratelimit-reset-tokens": "5s"}, None),
        ({"x-ratelimit-remaining-tokens": "0", "x-ratelimit-reset-tokens": "5s"}, 5000.0), ({"retry-after": "1", "x-ratelimit-remaining-requests": "0", "x-ratelimit-reset-requests": "2s"}, 2000.0),
    ],
)
def test_cooldown(spark, headers, ms):
    column = F.create_map(*[F.lit(x) for pair in headers.items() for x in pair])
    assert one(spark, X.cooldown_ms(column)) == ms


@pytest.mark.parametrize(("peak", "ttl"), [(0, 300_000), (250_000, 500_000), (1_000_000, 1_800_000)])
def test_lease_ttl(spark, peak, ttl):
    assert one(spark, X.lease_ttl(F.lit(peak))) == ttl


@pytest.mark.parametrize(
    ("hint", "body", "load"),
    [
        ("vllm", 'vllm:num_requests_waiting{a="b"} 7 171234', 7), ("vllm", "vllm:num_requests_running 3", None), ("vllm", "vllm:num_requests_waiting x", None), ("vllm", "vllm:num_requests_waiting -1\nvllm:num_requests_waiting 4", 4),
        ("llama_cpp", '[{"is_processing":true},{"is_processing":true},{}]', 2), ("llama_cpp", '[{"state":0}]', 0), ("llama_cpp", '[{"state":2}]', 1), ("llama_cpp", "{}", None),
        ("sglang", '{"internal_states":[{"num_waiting_reqs":3},{"waiting_queue_len":5}]}', 8), ("sglang", '{"waiting_queue_len":4}', 4), ("sglang", "{}", None), ("router", "[]", None),
    ],
)
def test_load(spark, hint, body, load):
    assert one(spark, J.server_load(F.lit(hint), F.lit(body))) == load


@pytest.mark.parametrize("text", ["", "{} x", "{'a':1}", '{"a":1,}', '{"a":NaN}', '{"a":1e400}', '{"a":01}', '"\\ud800"', None])
def test_strict_json_refuses(text):
    assert strict_error(text) is not None


@pytest.mark.parametrize("text", ["{}", "null", "1", '"x"', "[1]", '{"a": 1.50}', '"\\ud83d\\ude00"'])
def test_strict_json_takes(text):
    assert strict_error(text) is None


def test_usage(spark):
    usage = '{"prompt_tokens":100,"completion_tokens":50,"total_tokens":7,"prompt_tokens_details":{"cached_tokens":80},"completion_tokens_details":{"reasoning_tokens":30}}'
    assert tuple(one(spark, J.usage_openai(J.parsed(F.lit(usage))))) == (100, 50, 7, 80, 30)
    assert tuple(one(spark, J.usage_messages(J.parsed(F.lit('{"input_tokens":320,"output_tokens":48,"cache_read_input_tokens":100}'))))) == (420, 48, 468, 100, 0)
    assert tuple(one(spark, J.usage_of(F.lit("chat"), J.parsed(F.lit("{}"))))) == (0, 0, 0, 0, 0)


def test_fnv(spark):
    assert fnv1a(b"a") % 256 == 140
    found = spark.createDataFrame([("a",), ("",), ("é" * 50,), (None,)], "k string").select("k", J.fnv_bucket(F.col("k"), 256).alias("b")).collect()
    assert [r["b"] for r in found] == [None if r["k"] is None else fnv1a(r["k"].encode()) % 256 for r in found]
