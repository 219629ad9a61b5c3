"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, langid, mixing, quality, secrets, simhash, tokens, toxicity, urls, vptree

#: query name: module of its query(), whose ORACLE (if any) is DuckDB SQL for its rows
MODULES = {
    "op1_toxicity": toxicity,
    "op2_quality": quality,
    "op3_langid": langid,
    "op4_mixing": mixing,
    "op5_urls": urls,
    "op6_vptree": vptree,
    "op7_tokens": tokens,
    "op8_simhash": simhash,
    "op9_secrets": secrets,
    "op10_decontamination": decontamination,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in MODULES.items() if getattr(m, "ORACLE", None)}
