"""Secret scans with an incremental blob ledger.

Every historical version of a path (here: a row) has a content address, the SHA-256 of its
text. The ledger lists which rule versions each blob was scanned with, and what they found.
A scan takes one copy of each blob whose pairs of blob and rule version aren't all in the
ledger, applies only the missing rules to the whole text, and appends to the ledger; findings
are joined back to all paths. Texts are moved once, by content address, and copies of a blob
are dropped before they reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, new_path, stored, table

LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"

_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, so the same as dropping shorter runs
_PEM = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)")


def _assign(text: str) -> Iterator[tuple[int, int]]:
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield m.span()


def _access(text: str) -> Iterator[tuple[int, int]]:
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield m.span()


def _pem(text: str) -> Iterator[tuple[int, int]]:
    """From each BEGIN line to the END line after it, whatever the length; the BEGIN line alone if another BEGIN or no END follows."""
    begin = None
    for m in _PEM.finditer(text) if "-----BEGIN" in text else ():
        if begin is not None:
            yield begin.start(), (m if m[1] == "END" else begin).end()
        begin = m if m[1] == "BEGIN" else None
    if begin is not None:
        yield begin.span()


def _finds(pattern: re.Pattern, *needs: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    def found(text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in pattern.finditer(text)) if not needs or any(x in text for x in needs) else iter(())

    return found


#: name@version: scanner, in the order of kinds. A changed rule takes a new version.
RULES: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "assign@1": _assign, "access@1": _access, "hex@1": _finds(_HEX),
    "pem@2": _pem, "prefixed@1": _finds(_PREFIXED, "gh", "xox", "eyJ"),
}
BASE = ("assign", "access", "hex")


def scan_text(text: str, rules: list[str]) -> list[dict]:
    """All spans (code points, end exclusive) that the named rules find in a text."""
    return [{"rule": r, "start": a, "end": b} for r in rules for a, b in RULES[r](text)]


class Ledger:
    """The ledger as a folder of Parquet files: scans only ever append to it."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def rows(self) -> DataFrame:
        """blob, rules, spans: a row for each scan of a blob."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(LEDGER).parquet(self.path) if there else self.spark.createDataFrame([], LEDGER)

    def append(self, new: DataFrame) -> None:
        new.write.mode("append").parquet(self.path)


def update(docs: DataFrame, ledger: Ledger, rules: list[str] | None = None) -> DataFrame:
    """Each row's doc_id and blob; what was missing is appended to the ledger.

    docs: doc_id, text. Of the ledger's history only the blobs and rule names are read, and
    only those of blobs that occur here go on; blobs of no current row stay in the ledger.
    """
    rules = list(RULES) if rules is None else rules
    text = F.coalesce("text", F.lit(""))
    versions = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    paths = stored(versions.select("doc_id", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("pick"), (F.count("*") > 1).alias("many"))
    every = F.array(*[F.lit(r) for r in rules]).cast("array<string>")
    history = ledger.rows().select("blob", "rules")
    if history.isEmpty():
        todo = blobs.withColumn("rules", every)
    else:
        seen = history.join(blobs.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))  # a row for each scan of a blob
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("rules") > 0)
    todo = todo.select(F.col("blob").alias("b"), "pick", "many", "rules")
    # one copy of each blob; the light side is built into hash tables, so texts aren't sorted
    rows = versions.join(todo.hint("shuffle_hash"), (versions.blob == todo.b) & versions.doc_id.eqNullSafe(todo["pick"])).select("blob", "many", "rules", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        done: set[bytes] = set()  # of this task's blobs that occur more than once: a path may hold one version twice
        for b in batches:
            fresh = []
            for k, (blob, many) in enumerate(zip(b.column("blob").to_pylist(), b.column("many").to_pylist(), strict=True)):
                if blob not in done:
                    fresh.append(k)
                    if many:
                        done.add(blob)
            b = b.take(pa.array(fresh, pa.int64()))
            spans = [scan_text(t.as_py(), r.as_py()) for t, r in zip(b.column("text"), b.column("rules"), strict=True)]
            yield pa.record_batch([b.column("blob"), b.column("rules"), pa.array(spans, span)], ["blob", "rules", "spans"])

    ledger.append(rows.mapInArrow(run, LEDGER).dropDuplicates(["blob"]))  # rows of a blob may still come from two tasks
    return paths


HOT = 1000  #: blobs with more than a HOT-th of all paths are spread; there are fewer than HOT of them
SALTS = 64


def findings(paths: DataFrame, ledger: Ledger, rules: list[str] | None = None) -> DataFrame:
    """The ledger's findings of the given rule versions, for every path."""
    rules = list(RULES) if rules is None else rules
    kinds = [r.split("@")[0] for r in rules]
    wanted = F.filter("spans", lambda x: x["rule"].isin(rules))
    per = cut(paths.groupBy("blob").count())
    found = ledger.rows().select("blob", wanted.alias("spans")).join(per.select("blob"), "blob", "left_semi")
    merged = found.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a ledger row for each scan of a blob
    rank = F.array(*[F.lit(k) for k in kinds])
    kind = lambda x: F.substring_index(x["rule"], "@", 1)
    merged = merged.withColumn("spans", F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.array_position(rank, kind(x)).alias("rank"), x["end"].alias("end"), kind(x).alias("kind")))))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    merged = merged.select(
        "blob", *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(said(F.filter("spans", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
    # one blob may be that of a third of all paths: its findings are given to every salt, its paths to one each
    hot = F.broadcast(per.filter(F.col("count") > max(SALTS, paths.count() // HOT)).select("blob", F.lit(True).alias("hot")))
    paths = paths.join(hot, "blob", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    merged = merged.join(hot, "blob", "left").withColumn("salt", F.explode(salts)).drop("hot")
    return paths.join(merged, ["blob", "salt"]).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    A null text is empty and has no span. Rows that repeat are returned as often as they
    occur and scanned once; an empty table gives an empty result; columns beyond doc_id and
    text are ignored. Without a ledger a new one is written beside the checkpoints.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ledger = ledger or Ledger(docs.sparkSession)
    return findings(update(docs, ledger), ledger)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
