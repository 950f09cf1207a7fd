"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import chat, decontaminate, mixing, near_dup, pii, quality_model, quality_rules, token_counts, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.query,
        "op2_decontaminate": decontaminate.query,
        "op3_quality_model": quality_model.query,
        "op4_url_filter": url_filter.query,
        "op5_pii": pii.query,
        "op6_near_dup": near_dup.query,
        "op7_mixing": mixing.query,
        "op8_chat": chat.query,
        "op9_warc": warc.query,
        "op10_quality_rules": quality_rules.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": url_filter.SQL,
        "op7_mixing": mixing.SQL,
        "op8_chat": chat.SQL,
        "op9_warc": warc.SQL,
        "op10_quality_rules": quality_rules.SQL,
    }
