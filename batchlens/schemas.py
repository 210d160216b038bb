"""Typed tables of the engine and their fixed vocabularies."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Names on the wire.
STATES = ("pending", "leased", "done", "dead_letter")
TERMINAL = ("done", "dead_letter")
TRANSITIONS = (("pending", "leased"), ("leased", "done"), ("leased", "pending"), ("leased", "dead_letter"))
KINDS = {"chat": "/v1/chat/completions", "completions": "/v1/completions", "embeddings": "/v1/embeddings", "messages": "/v1/messages"}
HINTS = ("vllm", "sglang", "llama_cpp", "router", "open_ai_api", "anthropic_api")
FAILURES = ("validation", "rate_limited", "timeout", "connection", "client_error", "server_error", "other")
CHECKS = ("any", "non_empty", "json")
BATCH_STATUSES = ("in_progress", "completed", "cancelled", "failed")
EVENTS = ("enqueue", "lease", "ack", "dead", "reap")


def _struct(spec: str) -> StructType:
    kinds = {"s": StringType(), "l": LongType(), "i": IntegerType(), "d": DoubleType(), "b": BooleanType()}
    fields = []
    for item in spec.split():
        name, kind = item.rstrip("!").split(":")
        fields.append(StructField(name, kinds[kind], not item.endswith("!")))
    return StructType(fields)


ITEM = _struct("custom_id:s! method:s! url:s! body:s!")
REJECT = _struct("line_no:l! error:s! input:s!")
USAGE = _struct("prompt_tokens:l! completion_tokens:l! total_tokens:l! cached_tokens:l! reasoning_tokens:l!")
RESULT = _struct("custom_id:s! kind:s! status_code:i request_id:s body:s error_code:s error_message:s prompt_tokens:l! completion_tokens:l! total_tokens:l! cached_tokens:l! reasoning_tokens:l! worker_id:s! latency_ms:l! attempt:l! completed_at:l!")
EXPORT = _struct("custom_id:s! status_code:i body_json:s error_code:s error_message:s prompt_tokens:l! completion_tokens:l! total_tokens:l! worker_id:s! latency_ms:l! attempt:l! completed_at:l!")
WORKER = _struct("worker:l! base_url:s endpoint_kind:s concurrency_limit:l engine_hint:s health_path:s ready:b rate_limit:d load:l")
EVENT = _struct("custom_id:s! seq:l! kind:s! attempt:l at_ms:l! leased_until:l leased_by:s error:s")
STATE = _struct("custom_id:s! status:s attempts:l leased_until:l leased_by:s error:s")
FILE = _struct("id:s! bytes:l! created_at:l! filename:s! purpose:s!")
BATCH = _struct("id:s! endpoint:s! input_file_id:s! completion_window:s! status:s! output_file_id:s error_file_id:s created_at:l! in_progress_at:l completed_at:l cancelled_at:l")
WIRE_RESULT = _struct("custom_id:s! generation:l! ok:b! status_code:i body:s error:s prompt_tokens:l completion_tokens:l total_tokens:l latency_ms:l worker_id:s")
