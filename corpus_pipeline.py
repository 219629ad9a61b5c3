"""From raw documents to packed token files: five stages, each an operator of helixframe.llm.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a
DataFrame; run() writes each result as Parquet to the shared folder and reads it again as the
next stage's docs, so a lost executor costs no more than the stage at work. All stages but
the last return the columns of documents.

Nulls, empty texts, ties, repeated rows, empty tables and extra columns are treated as the
operators' docstrings say; extra columns end at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontamination, mixing, quality, shingles, tokens
from helixframe.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.7) go."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the one with the least doc_id."""
    return shingles.dedup(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut out of the texts."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each row is what it takes of a document; a document taken twice has two rows."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, written to plane files and read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.encode(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token ids", encode),
]

#: SQL can express neither the trained classifier nor the fingerprints; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
