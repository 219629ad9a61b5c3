"""Registering queries with the SQL that means the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sequences(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    """string_id, seq: the letters A, C, G, T of the table's texts, as DNA."""
    seq = F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "")
    return read(spark, sf_dir, table).select(F.col(key).alias("string_id"), seq.alias("seq"))


_SEQ = "regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g')"
SEQS = f"seqs AS (SELECT doc_id AS string_id, {_SEQ} AS seq FROM documents)"
BENCH = f"bench AS (SELECT item_id AS string_id, {_SEQ} AS seq FROM benchmark)"


def grams_sql(name: str, source: str, q: int, interval: int) -> str:
    return f"{name} AS (SELECT string_id, pos::INT AS pos, substring(seq, (pos + 1)::INT, {q}) AS gram FROM (SELECT string_id, seq, unnest(range(0, length(seq) - {q} + 1, {interval})) AS pos FROM {source} WHERE length(seq) >= {q}))"
