"""Column expressions of the request life cycle: ids, endpoints, failures, retries, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchlens.schemas import KINDS, TERMINAL, TRANSITIONS


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def valid_custom_id(custom_id: Column) -> Column:
    """1 to 64 ASCII letters, digits, hyphens and underscores."""
    return F.coalesce(custom_id.rlike(r"\A[a-zA-Z0-9_-]{1,64}\z"), F.lit(False))


def is_blank(text: Column) -> Column:
    """Nothing but Unicode white space."""
    return text.rlike(r"(?U)\A\s*\z")


def endpoint_kind(url: Column) -> Column:
    """The kind of endpoint a path names, or null."""
    return F.when(url.contains("/embeddings"), "embeddings").when(url.contains("/chat/completions"), "chat").when(url.contains("/completions"), "completions").when(url.contains("/messages"), "messages")


def default_path(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, path in KINDS.items():
        out = F.when(kind == name, path).otherwise(out)
    return out


def request_url(base: Column, url: Column, kind: Column) -> Column:
    """The base without trailing slashes and the item's path, or its kind's where it has none."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.coalesce(F.nullif(url, F.lit("")), default_path(kind)))


def query_parameter(url: Column, name: str) -> Column:
    """A raw query parameter of a URL, or null."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def job_name(path: Column) -> Column:
    """A job id from a checkpoint path: its stem with anything unusual replaced, or a fixed one."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(stem, "[^A-Za-z0-9_-]", "_"), F.lit("")), F.lit("job"))


def retryable(status: Column) -> Column:
    return status.isin(429, 408) | status.between(500, 599)


def classify_failure(error: Column) -> Column:
    """A failure's label from its text; the order of the rules decides. Null is other."""
    e = F.lower(F.coalesce(error, F.lit("")))
    late = _any(e, ("timed out", "timeout"))
    transport = _any(e, ("request error", "connect", "refused", "reset", "dns"))
    return (
        F.when(e.contains("validation failed"), "validation")
        .when(_any(e, ("http 429", "too many requests")), "rate_limited")
        .when(e.contains("http 408"), "timeout")
        .when(e.contains("http 5"), "server_error")
        .when(transport & late, "timeout")
        .when(transport, "connection")
        .when(_any(e, ("(terminal)", "http 4")), "client_error")
        .when(late, "timeout")
        .otherwise("other")
    )


def is_success(response: Column, error: Column) -> Column:
    return response.isNotNull() & error.isNull()


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def can_transition(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for a, b in TRANSITIONS:
        out = out | ((before == a) & (after == b))
    return out


def exhausted(attempts: Column, most: int = 5) -> Column:
    return attempts >= most


def backoff_ceiling(attempt: Column, base_ms: int = 500, cap_ms: int = 30_000) -> Column:
    """The longest pause before a retry, in ms; the pause itself is a random share of it."""
    return F.least(F.lit(float(cap_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)))).cast("long")


def lease_ttl(peak_ms: Column, base_ms: int = 300_000, most_ms: int = 1_800_000) -> Column:
    """Twice the longest latency seen, between the base and the greater of base and most."""
    return F.least(F.greatest(peak_ms * 2, F.lit(base_ms)), F.lit(max(base_ms, most_ms))).cast("long")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * 100)


def first_characters(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def reset_ms(text: Column) -> Column:
    """A reset duration in ms: seconds as a number, or segments in h, m, s and ms; null if it is neither or comes to nothing.

    Digits without a unit at the end of segments are ignored, and a bare 0 is 0 while segments of 0 are null.
    """
    trimmed = F.trim(text)
    bare = F.when(trimmed.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), trimmed.try_cast("double"))
    shaped = trimmed.rlike(r"\A((\d+\.?\d*|\.\d+)(h|ms|m|s)(?![a-zA-Z]))+[\d.]*\z")
    numbers = F.regexp_extract_all(trimmed, F.lit(r"(\d+\.?\d*|\.\d+)(h|ms|m|s)"), 1)
    units = F.regexp_extract_all(trimmed, F.lit(r"(\d+\.?\d*|\.\d+)(h|ms|m|s)"), 2)
    scale = lambda u: F.when(u == "h", 3_600_000.0).when(u == "m", 60_000.0).when(u == "s", 1_000.0).otherwise(1.0)
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.try_cast("double") * scale(u)), F.lit(0.0), lambda a, x: a + x)
    return F.when(bare.isNotNull(), F.when(bare >= 0, bare * 1000)).when(shaped & (total > 0), total)


def cooldown_ms(headers: Column, most_ms: int = 120_000) -> Column:
    """The longest pause that a response's headers (a map with lower-case names) ask for, in ms, at most `most_ms`; null if none does."""
    after = F.when(F.trim(headers["retry-after"]).rlike(r"\A\+?\d+\z"), F.trim(headers["retry-after"]).try_cast("double") * 1000)
    found = [after]
    for what in ("requests", "tokens"):
        left = F.trim(headers[f"x-ratelimit-remaining-{what}"]).try_cast("double")
        found.append(F.when(left <= 0, reset_ms(headers[f"x-ratelimit-reset-{what}"])))
    longest = F.greatest(*found)
    return F.when(longest.isNotNull(), F.least(longest, F.lit(float(most_ms))))
