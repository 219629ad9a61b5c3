"""Queries on odd and on larger tables, beside their SQL."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import compare

from helixframe.plans import registry
from helixframe.sources import readers, writers

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def equal_to_sql(spark, folder, name):
    q, sql = registry.queries()[name], registry.oracle_sql()[name]
    assert compare.differences(spark, compare.database(folder), str(folder), name, q, sql) == ""


def test_difference_statistics_halves(spark, tmp_path):
    """Halves become even integers, as in SQL; reads without a place count too."""
    rows = []
    for k, (a, b, part) in enumerate([(2.5, 2.0, 5), (4.5, 5.5, 5), (8.5, 8.0, 700), (7.5, 8.5, None), (16.5, 16.0, 5), (0.5, 0.0, 9), (300.25, 2.0, 9)]):
        rows += [(k, part, 3, 1, a, a, 0.05, 0.0, "R", "O"), (k, 9, 12, 2, b, b, 0.06, 0.0, "N", "O")]
    spark.createDataFrame([*rows, (99, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", "O")], LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    equal_to_sql(spark, tmp_path, "difference_statistics")


def no_memory_tables(spark):
    return not [r for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith(("grams_", "best_"))]


def test_streamed_grams_driver(spark, tmp_path):
    """The driver holds no table of grams; no file, or none with a gram, gives no rows."""
    spark.createDataFrame([(k, "acgt" * (4 + k) + "x", "en", "web", 9) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    equal_to_sql(spark, tmp_path, "streamed_grams")
    assert no_memory_tables(spark)
    none = tmp_path / "none"
    spark.createDataFrame([(1, "acgt")], "doc_id long, text string").write.parquet(str(none / "documents.parquet"))
    assert registry.queries()["streamed_grams"](spark, str(none)).collect() == []


def test_streamed_best_driver(spark, tmp_path):
    """The driver holds no table of reads; reads of several batches have one best score."""
    rows = [(k % 700, k % 37, 1, 1, float(k % 50), 1.0, 0.0, 0.0, "R", "O") for k in range(3000)]
    spark.createDataFrame(rows, LINES).repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    equal_to_sql(spark, tmp_path, "streamed_best")
    assert no_memory_tables(spark)


def test_bam_parts(spark, tmp_path):
    """Executors write a BAM file's parts and parse its pieces: many tasks, any symbols, no records at all."""
    names = "name, flag, ref, pos, mapq, cigar, mate_ref, mate_pos, tlen, seq, quals".split(", ")
    rows = [(f"r{k}", k % 3 * 16, "c1" if k % 2 else "*", k, k % 99, "3M2I" if k % 5 else "*", "*", 0, -k, "ACGTN=MRx"[: k % 10] or "*", "*" if k % 4 == 0 or k % 10 == 0 else "!~I5?+#AB"[: k % 10]) for k in range(30000)]
    df = spark.createDataFrame(rows, "name string, flag int, ref string, pos long, mapq int, cigar string, mate_ref string, mate_pos long, tlen long, seq string, quals string")
    refs = spark.createDataFrame([("c1", 99999)], "name string, len int")
    for part, want in ((df.repartition(3), rows), (df.limit(0), [])):
        path = str(tmp_path / f"{len(want)}.bam")
        writers.write_bam(part, refs, path)
        back = readers.bam_records(spark, path)
        assert sorted(map(tuple, back.select(names).collect())) == sorted((*r[:9], r[9].replace("x", "N"), r[10]) for r in want)
    assert back.rdd.getNumPartitions() > 1 and not os.path.exists(f"{path}.parts")
    with pytest.raises(ValueError, match="cut off"):
        list(readers.parse_bam(writers.header_bytes(["@HD"], [("c1", 9)]) + b"\x50\0\0\0abc"))


def test_overlap_of_copies(spark, tmp_path):
    """Many copies are compared as one: same rows as SQL, and no pair for each two copies."""
    import random

    rng = random.Random(3)
    a, b, c = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (300, 200, 90))
    texts = [a] * 5 + [b, a[:150] + c, c[:60] + b, c, "ACGT" * 20, "ACGT" * 20, "ACGT" * 21, "acg", "", None, a[7:], b.lower()]
    spark.createDataFrame([((k * 7) % 31, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    equal_to_sql(spark, tmp_path, "qgram_overlap")
    many = tmp_path / "many"
    spark.createDataFrame([(k, a) for k in range(30000)], "doc_id long, text string").write.parquet(str(many / "documents.parquet"))
    got = registry.queries()["qgram_overlap"](spark, str(many))
    assert got.count() == 30000 and got.filter("string_id = 0").count() == 29999
