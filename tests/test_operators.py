"""Goldens and invariants of ledger, dispatch, stores, sources and streams."""

from __future__ import annotations

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from batchlens.operators import batches, completeness, costs, dispatch, ledger, results, workers
from batchlens.sources import importer, jsonl
from batchlens.streaming import flows

EVENTS = "custom_id string, seq long, kind string, attempt long, at_ms long, leased_until long, leased_by string, error string"


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "custom_id string")


def test_completeness_goldens(spark):
    got = completeness.report(ids(spark, "abccd"), ids(spark, "azb")).first().asDict()
    assert got == {"input_ids": 4, "emitted_ids": 3, "matched": 2, "missing": 2, "extra": 1, "duplicate_input": 1, "rejected_input": 0, "complete": False}
    got = completeness.report(ids(spark, ["a", "has space", "b", None]), ids(spark, "ab")).first()
    assert (got["input_ids"], got["rejected_input"], got["complete"]) == (2, 2, True)
    assert completeness.report(ids(spark, []), ids(spark, [])).first()["complete"]
    assert [r[0] for r in completeness.missing_sample(ids(spark, "dcba"), ids(spark, "a")).collect()] == ["b", "c", "d"]


def test_cost_golden(spark):
    sums = spark.createDataFrame([(1, 1_000_000, 1_000_000, 800_000, 0, 2_000_000)], "items long, prompt_tokens long, completion_tokens long, cached_tokens long, reasoning_tokens long, total_tokens long")
    got = costs.report(sums, 1.0, 0.5, 1.5).first()
    assert (got["own_usd_per_mtok"], got["tokens_per_usd"], got["online_cost_usd"], got["savings_usd"], got["savings_pct"]) == (0.5, 2_000_000, 2.0, 1.0, 50.0)
    assert costs.report(sums, None, 1.0, 0.0, 0.1).first()["online_cost_usd"] == pytest.approx(0.28)
    assert costs.report(sums.limit(0), 1.0).count() == 0


def test_ledger_golden(spark):
    rows = [("x", 1, "enqueue", 0, 0, None, None, None), ("x", 2, "lease", None, 10, 100, "w", None), ("x", 3, "reap", None, 100, None, None, None), ("x", 4, "reap", None, 101, None, None, None), ("x", 5, "lease", None, 110, 200, "v", None), ("x", 6, "ack", 1, 120, None, None, None), ("x", 7, "ack", 2, 130, None, None, None), ("x", 8, "dead", 2, 140, None, None, "late"), ("y", 1, "ack", 1, 5, None, None, None)]
    got = ledger.fold(spark.createDataFrame(rows, EVENTS)).collect()
    assert [(r["custom_id"], r["status"], r["attempts"], r["error"]) for r in got] == [("x", "done", 2, None)]


def test_audit_boundary(spark):
    rows = [("a", 1, "leased", 1, 100, "w", None), ("b", 2, "leased", 1, 101, None, None), ("c", 3, "leased", 1, None, "w", None), ("d", 4, "pending", 0, None, None, None), ("e", 5, "leased", 1, 99, "w", None)]
    states = spark.createDataFrame(rows, "custom_id string, ordinal long, status string, attempts long, leased_until long, leased_by string, error string")
    audit = ledger.resume_audit(states, 100).first()
    assert (audit["live_leases"], audit["orphaned_leases"], audit["reclaimable"], audit["interrupted"]) == (1, 3, 4, True)
    assert [r["custom_id"] for r in ledger.pick(states, 5, 100).collect()] == ["d", "e"]
    assert [r["custom_id"] for r in ledger.pick(states, 5, 100, "expired_first").collect()] == ["e", "d"]
    assert [tuple(r) for r in ledger.live_holders(states, 100).collect()] == [("(unknown)", 1)]


def slow_assign(loads, caps, base, n_items, aware):
    """The rule as a plain loop."""
    n = len(loads)
    if not (aware and any(x is not None for x in loads)):
        if n_items > sum(caps):
            return [(base + i) % n for i in range(n_items)]
        free, out, at = list(caps), [], base
        while len(out) < n_items:
            w = at % n
            while not free[w]:
                w = (w + 1) % n
            free[w] -= 1
            out.append(w)
            at = w + 1
        return out
    order = sorted(range(n), key=lambda w: (4294967295 if loads[w] is None else loads[w], (w - base) % n))
    out = [w for w in order for _ in range(caps[w])][:n_items]
    while len(out) < n_items:
        out.append(order[len(out) % n])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_dispatch_equals_loop(spark, seed):
    draw = random.Random(seed)
    n = draw.randint(1, 6)
    loads, caps = [draw.choice([None, 0, 3, 5]) for _ in range(n)], [draw.randint(0, 3) for _ in range(n)]
    base, items, aware = draw.randint(0, 9), draw.randint(1, 12), draw.random() < 0.6
    fleet = spark.createDataFrame([(w, loads[w], caps[w]) for w in range(n)], "worker long, load long, cap long")
    got = [r["worker"] for r in dispatch.assign(fleet, items, base, aware).orderBy("item").collect()]
    assert got == slow_assign(loads, caps, base, items, aware)


def test_aimd_golden(spark):
    outcomes = [("w", i, ok) for i, ok in enumerate([False, False, *[True] * 8])]
    assert dispatch.aimd(spark.createDataFrame(outcomes, "worker string, seq int, ok boolean"), 8).first()["limit"] == 3


def result(custom_id, kind, seq):
    done = kind == "done"
    return (custom_id, kind, 200 if done else None, None, '{"a":1}' if done else None, None if done else "worker_error", None if done else "HTTP 500", 3, 1, 4, 0, 0, "w", 5, 1, 9, seq)


RESULT = "custom_id string, kind string, status_code int, request_id string, body string, error_code string, error_message string, prompt_tokens long, completion_tokens long, total_tokens long, cached_tokens long, reasoning_tokens long, worker_id string, latency_ms long, attempt long, completed_at long, seq long"


def test_store_keeps_the_first_terminal_row(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    first = spark.createDataFrame([result("a", "dead", 1), result("a", "done", 2), result("b", "done", 3)], RESULT)
    assert results.append(spark, first, store, ["seq"]) == 2
    assert results.append(spark, first, store, ["seq"]) == 0
    assert results.append(spark, spark.createDataFrame([result("a", "done", 4), result("c", "done", 5)], RESULT), store, ["seq"]) == 1
    rows = spark.read.parquet(f"{store}/results")
    assert sorted((r["custom_id"], r["kind"]) for r in rows.collect()) == [("a", "dead"), ("b", "done"), ("c", "done")]
    assert results.open_run(spark, store) == "job"
    assert results.manifest(spark, f"{store}/_manifest").count() == 3
    assert results.manifest(spark, f"{store}/absent").count() == 0


def test_export_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rows = spark.createDataFrame([result(str(i), "done", i) for i in range(5)], RESULT).coalesce(1)
    results.export(rows, f"file://{tmp_path}/out", 2)
    found = pq.ParquetFile(glob.glob(f"{tmp_path}/out/*.parquet")[0])
    assert found.num_row_groups == 3
    assert found.schema_arrow.names == ["custom_id", "status_code", "body_json", "error_code", "error_message", "prompt_tokens", "completion_tokens", "total_tokens", "worker_id", "latency_ms", "attempt", "completed_at"]


def test_reshape(spark):
    rows = spark.createDataFrame([result("a", "done", 1), result("b", "dead", 2)], RESULT)
    got = {r["custom_id"]: r for r in results.reshaped(rows).collect()}
    assert got["a"]["response"]["status_code"] == 200 and got["a"]["error"] is None and got["b"]["response"] is None and got["b"]["error"]["message"] == "HTTP 500"


def lines_file(tmp_path, lines):
    path = tmp_path / "in.jsonl"
    path.write_bytes(b"".join(x + b"\n" for x in lines))
    return str(path)


def test_ingest_goldens(spark, tmp_path):
    path = lines_file(tmp_path, [b'{"custom_id":"a","body":{"x":1.50}}\r', b"{broken", b'{"custom_id":"b b","body":{}}', b"  ", b'{"recordId":"c","body":{}}', b'{"custom_id":"a","body":{}}', b'{"custom_id":"d","recordId":"d","body":{}}'])
    items, rejects, stats = jsonl.ingest(spark, jsonl.numbered_lines(spark, path))
    assert [tuple(r) for r in items.orderBy("custom_id").collect()] == [("a", "POST", "", '{"x":1.50}', 1), ("c", "POST", "", "{}", 5)]
    assert [r["line_no"] for r in rejects.orderBy("line_no").collect()] == [2, 3, 7]
    assert tuple(stats.first()) == (6, 3, 3)
    assert not jsonl.write_rejects(rejects.limit(0), f"file://{tmp_path}/none") and jsonl.write_rejects(rejects, f"file://{tmp_path}/rejects")


def test_spans_keep_numbers(spark, tmp_path):
    path = lines_file(tmp_path, [b"x" * (i % 7) for i in range(200)])
    jsonl.register(spark)
    read = spark.read.format("request_lines").option("path", path).option("span", 50).load()
    assert read.rdd.getNumPartitions() > 5
    assert [(r["line_no"], len(r["value"])) for r in read.orderBy("line_no").collect()] == [(i + 1, i % 7) for i in range(200)]


def test_stream_reads_on(spark, tmp_path):
    path = lines_file(tmp_path, [b'{"custom_id":"%d","body":{}}' % i for i in range(8)])

    def run():
        query = flows.read_requests(spark, path).select("custom_id", "line_no").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    with open(path, "ab") as file:
        file.write(b"".join(b'{"custom_id":"%d","body":{}}\n' % i for i in range(8, 20)))
    run()
    got = sorted((int(r["custom_id"]), r["line_no"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(i, i + 1) for i in range(20)]


def test_ledger_stream_equals_fold(spark, tmp_path):
    rows = [("x", 1, "enqueue", 0, 0, None, None, None), ("y", 2, "enqueue", 0, 0, None, None, None), ("x", 3, "lease", None, 1, 50, "w", None), ("x", 4, "ack", 1, 2, None, None, None), ("y", 5, "lease", None, 3, 9, "w", None), ("y", 6, "lease", None, 20, 90, "v", None)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = flows.ledger_states(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["custom_id"]: (r["status"], r["attempts"], r["leased_by"]) for r in spark.table("states").collect()}
    want = {r["custom_id"]: (r["status"], r["attempts"], r["leased_by"]) for r in ledger.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == want == {"x": ("done", 1, None), "y": ("leased", 2, "v")}


def test_ledger_stream_reaps_expired_leases(spark, tmp_path):
    batches = [
        [("x", 1, "enqueue", 0, 1, None, None, None), ("x", 2, "lease", None, 1, 50, "w", None), ("y", 3, "enqueue", 0, 1, None, None, None), ("y", 4, "lease", None, 1, 900_000, "w", None)],
        [("z", 5, "enqueue", 0, 5_000, None, None, None)],
        [("x", 6, "ack", 1, 6_000, None, None, None), ("z", 5, "enqueue", 0, 5_000, None, None, None), ("y", 7, "ack", 1, 6_000, None, None, None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = flows.ledger_states(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), late="1 second")
        out = []
        query = stream.writeStream.outputMode("update").foreachBatch(lambda batch, _: out.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = {r["custom_id"]: (r["status"], r["attempts"], r["leased_by"]) for r in out}
        # The lease of x ends when z's event comes; its late ack changes nothing, that of y, still held, does.
        want = [{"x": ("leased", 1, "w"), "y": ("leased", 1, "w")}, {"x": ("pending", 1, None), "z": ("pending", 0, None)}, {"x": ("pending", 1, None), "y": ("done", 1, None), "z": ("pending", 0, None)}]
        assert got == want[i]


def test_finalized_store_takes_no_more(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    results.append(spark, spark.createDataFrame([result("a", "done", 1), result("b", "dead", 2)], RESULT), store, ["seq"])
    path = results.finalize(spark, store, ["seq"])
    rows = sorted((r["custom_id"], r["status_code"] is None) for r in spark.read.parquet(path).collect())
    assert rows == [("a", False), ("b", True)] and results.finalize(spark, store, ["seq"]) == path
    with pytest.raises(ValueError, match="finalized"):
        results.append(spark, spark.createDataFrame([result("c", "done", 3)], RESULT), store, ["seq"])


def test_reshaped_lines_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    shape = "custom_id string, status_code int, request_id string, body string, error_code string, error_message string"
    table = lambda *names: spark.createDataFrame([(n, 200, None, "{}", None, None) for n in names], shape)
    assert results.reshape_once(spark, table(), path) is None and not results.written(spark, path)
    assert results.reshape_once(spark, table("a", "b"), path) == path
    assert results.reshape_once(spark, table("c"), path) == path
    assert sorted(json.loads(r["value"])["custom_id"] for r in spark.read.text(path).collect()) == ["a", "b"]


def test_import_goldens(spark, tmp_path):
    path = lines_file(tmp_path, [b'{"custom_id":"a","method":"PUT","url":"","body":{"messages":[]}}', b'{"custom_id":"b","params":{"messages":[]}}', b'{"recordId":"c","modelInput":{"input":"x"}}', b'{"custom_id":"d"}', b'{"custom_id":"a","body":{}}', b'{"custom_id":null,"recordId":"e","body":{}}'])
    good, rejects, stats = importer.import_batch(jsonl.numbered_lines(spark, path))
    assert [(r["custom_id"], r["method"], r["url"]) for r in good.orderBy("ordinal").collect()] == [("a", "PUT", ""), ("b", "POST", "/v1/chat/completions"), ("c", "POST", "/v1/embeddings")]
    assert tuple(stats.first()) == (6, 3, 2, 1)
    importer.write_import(spark, path, f"file://{tmp_path}/imported")
    assert {json.loads(r["value"])["custom_id"] for r in spark.read.text(f"{tmp_path}/imported").collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        importer.write_import(spark, path, path)


def test_batches(spark):
    made = batches.create(None, spark.createDataFrame([("f1",)], "id string"), spark.createDataFrame([("b1", "f1", "/v1/x", None), ("b2", "gone", "/v1/x", None)], "id string, input_file_id string, endpoint string, completion_window string"), 5)
    assert [r["id"] for r in made.collect()] == ["b1"]
    states = spark.createDataFrame([("b1", "done"), ("b1", "dead_letter")], "batch_id string, status string")
    done = batches.finished(made, states, 9).first()
    assert (done["status"], done["completed_at"], done["error_file_id"]) == ("completed", 9, "file-err-b1")
    assert batches.finished(batches.cancelled(made, "b1", 7), states, 9).first()["status"] == "cancelled"
    envelope = json.loads(batches.list_envelope(batches.batch_objects(made, states)).first()["json"])
    assert envelope["object"] == "list" and envelope["data"][0]["output_file_id"] is None and envelope["data"][0]["request_counts"] == {"total": 2, "completed": 1, "failed": 1}


class Engine(BaseHTTPRequestHandler):
    seen: dict[str, int] = {}

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Engine.seen[body["id"]] = Engine.seen.get(body["id"], 0) + 1
        status = 400 if body["id"] == "bad" else 500 if body["id"] == "flaky" and Engine.seen["flaky"] < 3 else 200
        text = json.dumps({"choices": [{"message": {"content": body["id"]}}]}).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(text)))
        self.end_headers()
        self.wfile.write(text)

    def log_message(self, *_):
        pass


def test_http_worker(spark):
    server = HTTPServer(("127.0.0.1", 0), Engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    items = spark.createDataFrame([(i, "POST", "", json.dumps({"id": i}), 1) for i in ("good", "bad", "flaky")], "custom_id string, method string, url string, body string, attempts long").coalesce(1)
    got = {r["custom_id"]: r for r in workers.call(items, workers.Endpoint(f"http://127.0.0.1:{server.server_port}/", base_ms=1, concurrency=2)).collect()}
    server.shutdown()
    assert (got["good"]["kind"], got["flaky"]["kind"], got["flaky"]["tries"], got["bad"]["kind"], got["bad"]["tries"]) == ("done", "done", 3, "dead", 1)
    assert got["bad"]["error_message"].startswith("HTTP 400 (terminal)")


def test_prefix_order(spark):
    lines = [json.dumps({"custom_id": str(i), "body": {"model": "m", "messages": [{"role": "system", "content": f"s{i % 3}"}]}}) for i in range(9)] + ["{broken"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, value string")
    got = [(r["bucket"], r["line_no"]) for r in jsonl.ordered_by_prefix(rows, 16).collect()]
    assert got == sorted(got) and got[-1] == (16, 9)


def test_reports(spark):
    states = spark.createDataFrame([("done", 1, None), ("done", 2, None), ("dead_letter", 1, "odd")], "status string, attempts long, error string")
    report = ledger.status_report(states)
    row = report.first()
    assert (row["done"], row["dead"], row["retried"], row["attempt_histogram"], row["failure_reasons"]) == (2, 1, 1, {1: 2, 2: 1}, {"other": 1})
    assert 'batchlens_items{state="done"} 2' in ledger.metrics_text(report).first()["text"]
    assert json.loads(ledger.json_report(ledger.status_report(states.limit(0))).first()["json"])["success_rate"] is None


def test_result_readers(spark):
    from batchlens.sources import result_files as R

    good = '{"custom_id":"a","response":{"status_code":200,"body":{"x":1.50}},"usage":{"prompt_tokens":3,"completion_tokens":1},"worker_id":"w","latency_ms":5,"attempt":1,"completed_at":9}'
    lines = spark.createDataFrame([(good,), ('{"custom_id":5,"usage":"bad"}',), ('{"no":1}',), ('{"custom_id":"b","usa',)], "value string")
    assert [r["custom_id"] for r in R.ids(lines).collect()] == ["a"]
    assert costs.totals(R.lenient(lines)).first()["items"] == 2
    row = R.strict(lines).collect()
    assert len(row) == 1 and (row[0]["body"], row[0]["prompt_tokens"], row[0]["kind"]) == ('{"x":1.50}', 3, "done")
    assert R.result_lines(spark, "file:///nowhere/at/all", missing_ok=True).count() == 0
    assert R.is_object_url("s3://b/x") and not R.is_object_url("/tmp/x")


def test_run_and_resume(spark, tmp_path):
    from batchlens.operators import runs

    lines = spark.createDataFrame([(i, json.dumps({"custom_id": f"id-{i}", "body": {"prompt": "x"}})) for i in range(40)], "line_no long, value string")
    store = f"file://{tmp_path}/run"
    first = runs.run_batch(spark, lines.filter("line_no < 25"), store, workers.replay, 2).first()
    again = runs.run_batch(spark, lines, store, workers.replay, 2).first()
    assert first["complete"] and again["complete"] and again["input_ids"] == again["emitted_ids"] == 40
    rows = spark.read.parquet(f"{store}/results")
    assert rows.count() == rows.select("custom_id").distinct().count() == 40


def test_stale_posts_are_not_acknowledged(spark, tmp_path):
    from batchlens.operators import runs

    states = spark.createDataFrame([("a", "leased", 2), ("b", "leased", 1)], "custom_id string, status string, attempts long")
    posts = spark.createDataFrame([("a", 1, True), ("b", 1, True)], "custom_id string, generation long, ok boolean").withColumns({"status_code": F.lit(200), "body": F.lit("{}"), "error": F.lit(None).cast("string"), "prompt_tokens": F.lit(1), "completion_tokens": F.lit(1), "total_tokens": F.lit(2), "latency_ms": F.lit(3), "worker_id": F.lit("w")})
    got = {r["custom_id"]: r["acked"] for r in runs.apply_posts(spark, posts, states, f"file://{tmp_path}/posts", 5).collect()}
    assert got == {"a": False, "b": True}


class Shapes(BaseHTTPRequestHandler):
    """Answers as the request's id says, some of them odd."""

    seen: dict[str, int] = {}
    bodies = {"list": [1], "word": {"choices": "no"}, "none": {"choices": [None]}, "blank": {"choices": [{"message": {"content": " "}}]}, "fine": {"choices": [{"message": {"content": "[1]"}}]}}

    def do_POST(self):
        name = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["id"]
        Shapes.seen[name] = Shapes.seen.get(name, 0) + 1
        if name == "slow":
            time.sleep(1.5)
        text = json.dumps(Shapes.bodies.get(name, Shapes.bodies["fine"])).encode()
        wait = name == "wait" and Shapes.seen["wait"] == 1
        self.send_response(429 if wait else 200)
        if wait:
            self.send_header("Retry-After", "1")
        self.send_header("Content-Length", str(len(text) + (50 if name == "short" and Shapes.seen["short"] < 2 else 0)))
        self.end_headers()
        self.wfile.write(text)
        self.close_connection = True

    def log_message(self, *_):
        pass


@pytest.fixture
def shapes():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Shapes)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Shapes.seen.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def called(spark, url, names, **options):
    items = spark.createDataFrame([(n, "POST", "", json.dumps({"id": n}), 1) for n in names], "custom_id string, method string, url string, body string, attempts long").coalesce(1)
    return workers.call(items, workers.Endpoint(url, base_ms=1, **options)).collect()


def test_http_worker_takes_odd_bodies(spark, shapes):
    got = {r["custom_id"]: r for r in called(spark, shapes, ["list", "word", "none", "blank", "fine", "short"], check="json", tries=2)}
    assert {n for n, r in got.items() if r["kind"] == "done"} == {"fine", "short"} and got["short"]["tries"] == 2
    assert got["blank"]["error_message"].endswith("the text is blank") and got["list"]["error_message"].endswith("no choice in the response")


def test_http_worker_does_not_wait_for_the_slowest(spark, shapes):
    order = [r["custom_id"] for r in called(spark, shapes, ["slow", *[f"q{i}" for i in range(30)]], concurrency=3)]
    assert len(order) == 31 and order.index("slow") > 20


def test_http_worker_shares_a_pause(spark, shapes):
    began = time.monotonic()
    got = called(spark, shapes, ["wait", "a", "b", "c"], concurrency=1)
    assert time.monotonic() - began >= 1 and all(r["kind"] == "done" for r in got) and Shapes.seen["wait"] == 2


def test_limit_with_calls_in_flight():
    limit = workers.Limit(8)
    assert [limit.start() for _ in range(9)] == [True] * 8 + [False]
    limit.record(False)
    for _ in range(4):
        limit.end()
    assert limit.now == 4 and not limit.start()  # four are still held
    limit.end()
    assert limit.start() and not limit.start()
    for _ in range(8):
        limit.record(True)
    assert limit.now == 5


def test_problems_equal_the_column_rules(spark):
    from batchlens.functions import json_text as J

    bodies = ["[1]", '{"choices":"no"}', '{"choices":[]}', '{"choices":[{"text":"x"}]}', '{"choices":[{"message":{"content":"{}"}}]}', '{"choices":[{"message":{"content":"{"}}]}', '{"data":[{"embedding":[]}]}', '{"data":[{"embedding":[1]}]}', '{"content":[{"text":" "}]}', "5", "null"]
    rows = [(c, k, b) for c in ("any", "non_empty", "json") for k in ("chat", "completions", "embeddings", "messages") for b in bodies]
    got = spark.createDataFrame(rows, "c string, k string, b string").select("c", "k", "b", J.response_problem(F.col("c"), F.col("k"), J.parsed(F.col("b"))).alias("p")).collect()
    assert [r["p"] for r in got] == [workers.problem(c, k, json.loads(b)) for c, k, b in rows]


def test_import_escapes_what_it_writes(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(json.dumps({"custom_id": "a", "method": 'P"', "url": '/v1/chat/completions?q="1"\\z', "body": {"n": 1.50}}) + "\n")
    assert importer.write_import(spark, f"file://{tmp_path}/in.jsonl", f"file://{tmp_path}/out").first()["written"] == 1
    line = json.loads(spark.read.text(f"file://{tmp_path}/out").first()["value"])
    assert line == {"custom_id": "a", "method": 'P"', "url": '/v1/chat/completions?q="1"\\z', "body": {"n": 1.5}}


def test_lines_are_numbered_over_splits_and_read_on(spark, tmp_path):
    path = tmp_path / "many.jsonl"
    rows = [f"line {i} " + "x" * (i % 90) for i in range(3000)]
    rows[7] = rows[2999] = ""
    path.write_text("\n".join(rows) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        lines = jsonl.numbered_lines(spark, f"file://{path}")
        assert lines.rdd.getNumPartitions() > 3
        assert [(r["line_no"], r["value"]) for r in lines.orderBy("line_no").collect()] == list(enumerate(rows, 1))
        read = spark.createDataFrame(jsonl.marks(spark, f"file://{path}").collect(), "file string, byte_end long, line_end long")
        assert jsonl.lines_after(spark, f"file://{path}", read).count() == 0
        with path.open("a") as more:
            more.write("one\r\ntwo")
        assert [(r["line_no"], r["value"]) for r in jsonl.lines_after(spark, f"file://{path}", read).orderBy("line_no").collect()] == [(3001, "one"), (3002, "two")]
        path.write_text("short\n")
        assert [(r["line_no"], r["value"]) for r in jsonl.lines_after(spark, f"file://{path}", read).collect()] == [(1, "short")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("line", ['{"a":1}', ' {"a" : [1, {"b":2}] , "c":"x"} ', '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', "{}", "[1]", "7", "", "{", '{"a":1,}', '{"a" 1}', '{"a":1} x', '{"a":NaN}', '{"a":1e999}', '{"a":"\\ud800"}', "{a:1}", '{"a":1,,"b":2}', '{,"a":1}', None])
def test_members_agree_with_the_strict_parser(line):
    from batchlens.functions import json_text as J

    error, found, twice = J.object_members(line)
    assert (error is None) == (J.strict_error(line) is None)
    if error is None:
        value = json.loads(line)
        assert (found is not None) == isinstance(value, dict) and (found is None or {k: v for k, (v, _) in found.items()} == value)
        assert all(json.loads(raw) == v for v, raw in (found or {}).values()) and twice == (line in ('{"a":1,"a":2}', '{"a":{"b":1,"b":2}}'))
