"""Queries of this subpackage, and those that SQL can express in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import alignment, base, chat, decontam, licenses, masked, mixing, ordinal, perplexity, secrets, simhash, tokenbin, toxicity, variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1,
        "op2_quality_rules": perplexity.op2,
        "op3_chat": chat.op3,
        "op4_masked_likelihood": masked.op4,
        "op5_token_binary": tokenbin.op5,
        "op6_mixing": mixing.op6,
        "op7_simhash": simhash.op7,
        "op8_licenses": licenses.op8,
        "op9_quality_classifier": ordinal.op9,
        "op10_decontamination": decontam.op10,
        "op11_alignment": alignment.op11,
        "op12_variants": variants.op12,
        "op13_toxicity": toxicity.op13,
    } | base.FOUND


def oracle_sql() -> dict[str, str]:
    return {"op8_licenses": licenses.ORACLE_SQL, "op12_variants": variants.ORACLE_SQL} | base.SQL
