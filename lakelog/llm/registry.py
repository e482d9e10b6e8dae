"""Queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakelog.llm import decontaminate, html_extract, jaccard_join, line_dedup, packing, quality, sanitize, token_output, toxicity, warc

_MODULES = {
    "op1_decontamination": decontaminate,
    "op2_line_dedup": line_dedup,
    "op3_token_output": token_output,
    "op4_toxicity": toxicity,
    "op5_html_extraction": html_extract,
    "op6_warc_fixity": warc,
    "op7_packing": packing,
    "op8_jaccard_join": jaccard_join,
    "op9_quality_rules": quality,
    "op10_sanitize": sanitize,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
