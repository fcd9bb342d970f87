"""Queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, mixing, packing, passages, quality, secrets, tiff, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": urlfilter.op1_url_filters,
    "op2_substring_dedup": passages.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_packing": packing.op7_packing,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_tiff": tiff.op10_tiff,
}

ORACLES: dict[str, str] = {
    "op1_url_filters": urlfilter.OP1_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op8_quality_rules": quality.OP8_SQL,
}
