"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from batchlens.llm import edits, flac, jaccard, licences, lines, mixing, packing, quality, toxicity, warc
from batchlens.llm.common import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_QUERIES = {
    "op1_edit_fingerprint": edits.op1,
    "op2_warc": warc.op2,
    "op3_licence_scan": licences.op3,
    "op4_toxicity": toxicity.op4,
    "op5_quality": quality.op5,
    "op6_flac": flac.op6,
    "op7_mixing": mixing.op7,
    "op8_packing": packing.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_line_dedup": lines.op10,
}

_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op3_licence_scan": licences.OP3_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op10_line_dedup": lines.OP10_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
