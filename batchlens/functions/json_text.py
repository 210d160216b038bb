"""Strict JSON, hashing and extraction from JSON bodies."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("a number is out of range")
    return value


def strict_error(text: str | None) -> str | None:
    """Why a text is not strict JSON, or None. Lone surrogates, NaN and numbers out of range are refused."""
    if text is None:
        return "no text"
    try:
        json.loads(text, parse_constant=_refuse, parse_float=_finite)
        if "\\u" in text:
            json.dumps(json.loads(text), ensure_ascii=False).encode()
    except (ValueError, UnicodeEncodeError, RecursionError) as error:
        return str(error)[:200] or "not JSON"
    return None


def _strict(text: pd.Series) -> pd.Series:
    return text.map(strict_error).astype(object)


def strict_json_error(text: Column) -> Column:
    """Null where text is strict JSON, else the reason."""
    return F.pandas_udf(_strict, "string")(text)


_SPACE = re.compile(r"[ \t\n\r]*")


def raw_member(text: str | None, names: tuple[str, ...]) -> str | None:
    """The text, as written, of the first of `names` that a JSON object has; None if it has none or is no object."""
    if text is None:
        return None
    found, decoder = {}, json.JSONDecoder()
    try:
        at = _SPACE.match(text, 0).end()
        if text[at] != "{":
            return None
        at = _SPACE.match(text, at + 1).end()
        while text[at] != "}":
            key, at = json.decoder.scanstring(text, at + 1)
            at = _SPACE.match(text, _SPACE.match(text, at).end() + 1).end()
            _, end = decoder.raw_decode(text, at)
            found.setdefault(key, text[at:end])
            at = _SPACE.match(text, end).end()
            if text[at] == ",":
                at = _SPACE.match(text, at + 1).end()
    except (ValueError, IndexError, RecursionError):
        return None
    return next((found[name] for name in names if name in found), None)


def raw_json(text: Column, *names: str) -> Column:
    """The JSON text of a member as written: numbers and key order are kept."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: raw_member(t, names)).astype(object)

    return F.pandas_udf(run, "string")(text)


def _pairs(twice: list):
    """Builds objects and notes in `twice` whether a key came more than once in any."""

    def build(pairs: list) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            twice.append(True)
        return found

    return build


def object_members(text: str | None) -> tuple[str | None, dict | None, bool]:
    """Of a text: why it is not strict JSON (or None), its members as (value, text as written) if it is an object, and whether keys repeat. The last of equal keys counts."""
    if text is None:
        return "no text", None, False
    found, twice = {}, []
    decoder = json.JSONDecoder(parse_constant=_refuse, parse_float=_finite, object_pairs_hook=_pairs(twice))
    try:
        at = _SPACE.match(text, 0).end()
        if text[at] != "{":
            return strict_error(text), None, False
        at = _SPACE.match(text, at + 1).end()
        while text[at] != "}":
            key, at = json.decoder.scanstring(text, at + 1) if text[at] == '"' else (None, len(text))
            at = _SPACE.match(text, at).end()
            if text[at] != ":":
                return strict_error(text), None, False
            at = _SPACE.match(text, at + 1).end()
            value, end = decoder.raw_decode(text, at)
            if key in found:
                twice.append(True)
            found[key] = value, text[at:end]
            at = _SPACE.match(text, end).end()
            if text[at] == ",":
                at = _SPACE.match(text, at + 1).end()
                if text[at] != '"':
                    return strict_error(text), None, False
            elif text[at] != "}":
                return strict_error(text), None, False
        if _SPACE.match(text, at + 1).end() < len(text):
            return strict_error(text), None, False
    except (ValueError, IndexError, RecursionError):
        return strict_error(text) or "not JSON", None, False
    # Lone surrogates can only come from escapes.
    return (strict_error(text) if "\\u" in text else None), found, bool(twice)


MEMBER = "struct<kind: string, text: string, raw: string>"
_KINDS = {str: "string", dict: "object", list: "array", bool: "boolean", type(None): "null"}


def line_members(text: Column, *names: str, raw: tuple[str, ...] = ()) -> Column:
    """What a JSON line holds, parsed once: error (why it is not strict JSON), object, distinct (keys, at any depth), for each name its kind (null where absent), its text if it is a string and, for names in `raw`, its JSON text as written; keys lists the keys of the first of `raw` that is there, if it is an object."""

    def run(lines: pd.Series) -> pd.DataFrame:
        rows = []
        for line in lines:
            error, found, twice = object_members(line)
            row = [error, found is not None, not twice]
            for name in names:
                value, written = (found or {}).get(name, (None, None))
                row.append({"kind": None if written is None else _KINDS.get(type(value), "number"), "text": value if isinstance(value, str) else None, "raw": written if name in raw else None})
            body = next((found[n][0] for n in raw if n in found), None) if found else None
            row.append(list(body) if isinstance(body, dict) else None)
            rows.append(row)
        return pd.DataFrame(rows, columns=["error", "object", "distinct", *names, "keys"])

    schema = ", ".join(["error string", "object boolean", "distinct boolean", *[f"`{n}` {MEMBER}" for n in names], "keys array<string>"])
    # Not deterministic as to the planner, so that neither filters nor later columns make it run again.
    return F.pandas_udf(run, schema).asNondeterministic()(text)


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv_bucket(key: Column, buckets: int) -> Column:
    """FNV-1a (64 bits) of a key's UTF-8 bytes modulo the number of buckets; null for null."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        out = np.full(len(keys), -1, np.int64)
        blobs = [None if k is None else k.encode() for k in keys]
        size = np.array([-1 if b is None else len(b) for b in blobs], np.int64)
        # All keys of a batch go on together, byte by byte.
        h = np.full(len(keys), 0xCBF29CE484222325, np.uint64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(b or b"" for b in blobs) + b"\0", np.uint8)
        start = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))[:-1][order]
        h = h[order]
        for i in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size[order], -(i + 1), "right"))
            h[:n] = (h[:n] ^ data[start[:n] + i].astype(np.uint64)) * np.uint64(0x100000001B3)
        out[order] = (h % np.uint64(buckets)).astype(np.int64)
        return pd.Series(out).where(pd.Series(size >= 0)).astype("Int32")

    return run(key)


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def at(value: Column, path: str) -> Column:
    """What a parsed value has at a path, JSON null included; SQL null where the path is absent."""
    return F.try_variant_get(value, path, "variant")


def is_kind(value: Column, kind: str) -> Column:
    """Whether a parsed value is a STRING, BIGINT, BOOLEAN, ARRAY or OBJECT."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def text_at(value: Column, path: str) -> Column:
    """A string at a path; null for anything else."""
    found = at(value, path)
    return F.when(is_kind(found, "STRING"), F.try_variant_get(found, "$", "string"))


def unsigned_at(value: Column, path: str) -> Column:
    """A whole number of at least 0 at a path; null for anything else, 5.0 and "5" included."""
    found = at(value, path)
    number = F.when(is_kind(found, "BIGINT"), F.try_variant_get(found, "$", "bigint"))
    return F.when(number >= 0, number)


def array_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def usage_openai(usage: Column) -> Column:
    """Token usage of chat, completion and embedding endpoints; absent and odd counts are 0."""
    get = lambda path: F.coalesce(unsigned_at(usage, path), F.lit(0).cast("long"))
    return F.struct(
        get("$.prompt_tokens").alias("prompt_tokens"), get("$.completion_tokens").alias("completion_tokens"), get("$.total_tokens").alias("total_tokens"),
        get("$.prompt_tokens_details.cached_tokens").alias("cached_tokens"), get("$.completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
    )


def usage_messages(usage: Column) -> Column:
    """Token usage of message endpoints: the prompt is fresh, newly cached and re-read input together."""
    get = lambda path: F.coalesce(unsigned_at(usage, path), F.lit(0).cast("long"))
    read, out = get("$.cache_read_input_tokens"), get("$.output_tokens")
    prompt = get("$.input_tokens") + get("$.cache_creation_input_tokens") + read
    return F.struct(prompt.alias("prompt_tokens"), out.alias("completion_tokens"), (prompt + out).alias("total_tokens"), read.alias("cached_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"))


def usage_of(kind: Column, usage: Column) -> Column:
    return F.when(kind == "messages", usage_messages(usage)).otherwise(usage_openai(usage))


def primary_text(kind: Column, body: Column) -> Column:
    """The text a response carries: message content, choice content or choice text; null if it has none."""
    return F.when(kind == "messages", text_at(body, "$.content[0].text")).when(kind == "chat", text_at(body, "$.choices[0].message.content")).when(kind == "completions", text_at(body, "$.choices[0].text"))


def response_problem(check: Column, kind: Column, body: Column) -> Column:
    """Why a response fails a check (any, non_empty, json), or null if it passes."""
    text = primary_text(kind, body)
    vector = F.when(is_kind(at(body, "$.data[0].embedding"), "ARRAY"), F.size(array_at(body, "$.data[0].embedding")))
    embedding = F.when(vector.isNull(), "no embedding in the response").when(vector == 0, "the embedding is empty")
    missing = F.when((kind == "messages") & text.isNull(), "no text block in the response").when((kind != "messages") & at(body, "$.choices[0]").isNull(), "no choice in the response").when(text.isNull(), "the choice holds no text")
    empty = F.when(text.rlike(r"(?U)\A\s*\z"), "the text is blank")
    # The text is parsed strictly only where the check asks for it.
    broken = F.when(strict_json_error(F.when(check == "json", text)).isNotNull(), "the text is no JSON")
    plain = F.coalesce(missing, empty)
    return F.when(check == "any", F.lit(None).cast("string")).when(kind == "embeddings", embedding).when(check == "json", F.coalesce(plain, broken)).otherwise(plain)


def vllm_waiting(text: Column) -> Column:
    """The waiting gauge in a metrics text: the value after the first sample of exactly that name; null if absent or malformed."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.rlike(r"\Avllm:num_requests_waiting(\{\S*)?( |\z)"))
    values = F.transform(F.transform(lines, lambda x: F.struct(F.try_element_at(F.split(x, " "), F.lit(2)).try_cast("double").alias("v"))), lambda x: x["v"])
    # A value that is no number ends the search; a negative or infinite one is passed over.
    usable = F.filter(values, lambda v: v.isNull() | ((v >= 0) & (v < float("inf"))))
    return F.round(F.try_element_at(usable, F.lit(1))).cast("long")


def llamacpp_busy(body: Column) -> Column:
    """Slots at work in a list of slots; null if it is no list."""
    slots = F.when(is_kind(body, "ARRAY"), array_at(body, "$"))

    def busy(slot: Column) -> Column:
        flag = at(slot, "$.is_processing")
        return F.when(is_kind(flag, "BOOLEAN"), F.try_variant_get(flag, "$", "boolean")).otherwise(F.coalesce(unsigned_at(slot, "$.state"), F.lit(0)) != 0)

    return F.when(slots.isNotNull(), F.size(F.filter(slots, busy))).cast("long")


def sglang_waiting(body: Column) -> Column:
    """Requests waiting over all ranks, or the server's own count; null if neither is there."""
    states = F.when(is_kind(at(body, "$.internal_states"), "ARRAY"), array_at(body, "$.internal_states"))
    counts = F.filter(F.transform(states, lambda s: F.coalesce(unsigned_at(s, "$.num_waiting_reqs"), unsigned_at(s, "$.waiting_queue_len"))), lambda n: n.isNotNull())
    total = F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n))
    found = F.coalesce(total, unsigned_at(body, "$.waiting_queue_len"), unsigned_at(body, "$.num_waiting_reqs"))
    return F.when(found.isNotNull(), F.least(found, F.lit(4294967295)))


def server_load(hint: Column, text: Column) -> Column:
    """A server's queue depth from its metrics body, by engine; null where the engine has none."""
    body = parsed(text)
    return F.when(hint == "vllm", vllm_waiting(text)).when(hint == "llama_cpp", llamacpp_busy(body)).when(hint == "sglang", sglang_waiting(body))


def bucket_key(line: Column) -> Column:
    """Model and shared prompt prefix of a request line; null where it is no JSON with a body."""
    v = parsed(line)
    messages = at(v, "$.body.messages")
    listed = F.when(is_kind(messages, "ARRAY"), array_at(v, "$.body.messages"))
    system = F.try_element_at(F.filter(listed, lambda m: F.coalesce(text_at(m, "$.role") == "system", F.lit(False))), F.lit(1))
    said = text_at(F.coalesce(system, F.try_element_at(listed, F.lit(1))), "$.content")
    prefix = F.when(listed.isNotNull(), said).otherwise(F.coalesce(text_at(v, "$.body.input"), text_at(v, "$.body.prompt")))
    key = F.concat(F.coalesce(text_at(v, "$.body.model"), F.lit("")), F.lit("\0"), F.coalesce(F.substring(prefix, 1, 256), F.lit("")))
    return F.when(at(v, "$.body").isNotNull(), key)


def interruption(cloud: Column, status: Column, body: Column) -> Column:
    """A notice (kind, deadline) that a cloud's metadata answer gives, or null. A missing AWS answer means a rebalance hint at most."""
    v, good = parsed(body), status.between(200, 299)
    none = F.lit(None).cast("string")
    notice = lambda kind, deadline: F.struct(F.lit(kind).alias("kind"), deadline.alias("deadline"))
    preempt = F.try_element_at(F.filter(array_at(v, "$.Events"), lambda e: F.coalesce(text_at(e, "$.EventType") == "Preempt", F.lit(False))), F.lit(1))
    return (
        F.when((cloud == "aws") & good & v.isNotNull(), notice("terminate", text_at(v, "$.time")))
        .when((cloud == "aws_rebalance") & good & v.isNotNull(), notice("rebalance", text_at(v, "$.noticeTime")))
        .when((cloud == "gcp") & good & body.rlike(r"(?i)\A\s*true\s*\z"), notice("terminate", none))
        .when((cloud == "azure") & good & preempt.isNotNull(), notice("terminate", text_at(preempt, "$.NotBefore")))
    )
