"""Token totals and what they cost against online prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ("prompt_tokens", "completion_tokens", "cached_tokens", "reasoning_tokens")


def totals(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """items, token sums and total_tokens (prompt and completion) over all rows of results, repeated ids included."""
    rows = results.groupBy(*by) if by else results
    out = rows.agg(F.count(F.lit(1)).alias("items"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS])
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def _price(value: float | None) -> Column:
    return F.lit(value).cast("double")


def gpu_cost(total: float | None = None, rate: float | None = None, hours: float | None = None, gpus: float | None = None) -> float | None:
    """An explicit total, else rate times hours times GPUs (1 if not given), else None."""
    if total is not None:
        return total
    return rate * hours * (1 if gpus is None else gpus) if rate is not None and hours is not None else None


def report(sums: DataFrame, gpu_usd: float | None = None, input_price: float | None = None, output_price: float | None = None, cached_price: float | None = None) -> DataFrame:
    """totals with own_cost_usd, own_usd_per_mtok, tokens_per_usd, online_cost_usd, savings_usd and savings_pct.

    Prices are per million tokens. The output price defaults to the input price, as does that of cached input. What a
    missing price or a division by nothing would need is null.
    """
    own, price = _price(gpu_usd), _price(input_price)
    cached = F.least("cached_tokens", "prompt_tokens")
    mtok = lambda c: c / F.lit(1_000_000.0)
    online = mtok(F.col("prompt_tokens") - cached) * price + mtok(cached) * F.coalesce(_price(cached_price), price) + mtok(F.col("completion_tokens")) * F.coalesce(_price(output_price), price)
    out = sums.withColumn("own_cost_usd", own)
    out = out.withColumn("own_usd_per_mtok", F.when(F.col("total_tokens") > 0, F.col("own_cost_usd") / F.nullif(mtok(F.col("total_tokens")), F.lit(0.0))))
    out = out.withColumn("tokens_per_usd", F.when(F.col("own_cost_usd") > 0, F.col("total_tokens") / F.col("own_cost_usd")))
    out = out.withColumn("online_cost_usd", online).withColumn("savings_usd", F.col("online_cost_usd") - F.col("own_cost_usd"))
    return out.withColumn("savings_pct", F.when(F.col("online_cost_usd") > 0, F.col("savings_usd") / F.col("online_cost_usd") * 100))
