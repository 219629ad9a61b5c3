"""Maximal exact matches of patterns in references.

``maximal_matches`` is a join of seeds, for references of any size. The variants that count
occurrences below a seed's length, split or take thresholds use a suffix array on Arrow
batches; its reference is sent to the executors, so its size is checked (LIMIT).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import joins, seeds

LIMIT = 1 << 24  #: symbols of a reference that may be sent


class SuffixArray:
    def __init__(self, text: str):
        if len(text) > LIMIT:
            raise ValueError(f"a reference of {len(text)} symbols is too long to be sent; search it in shards")
        import numpy as np

        n = len(text)
        rank = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        order, step = np.argsort(rank, kind="stable"), 1
        while n > 1:
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (max(n, int(rank.max())) + 2) + nxt
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(key[order][1:] != key[order][:-1])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= n:
                break
        self.text, self.order = text, order.tolist()

    def range(self, s: str) -> tuple[int, int]:
        """Half-open rank range of the suffixes that begin with s."""
        key = lambda i: self.text[i : i + len(s)]
        lo = bisect_left(self.order, s, key=key)
        hi = bisect_left(self.order, True, lo=lo, key=lambda i: self.text[i : i + len(s)] > s)
        return lo, hi

    def count(self, s: str) -> int:
        lo, hi = self.range(s)
        return hi - lo


def maximal_matches(patterns: DataFrame, references: DataFrame, min_span: int, most: int | None = None) -> DataFrame:
    """pattern_id, begin, end, n: the stretches of min_span symbols or more that occur in a reference and that no longer one holds.

    patterns: pattern_id, pattern. references: ref_id, seq. Seeds of min_span symbols meet by
    equality; seeds in a row on one diagonal make a match, the longest match from each place
    counts, and n is the number of reference places that have it (stretches with more than
    ``most`` are left out). Symbols other than A, C, G, T match nothing.
    """
    grams = lambda df, key, seq: seeds.without_ambiguity(seeds.qgrams(df.select(F.col(key).alias("string_id"), F.col(seq).alias("seq")), min_span))
    ref = grams(references, "ref_id", "seq").select("gram", F.col("string_id").alias("ref_id"), F.col("pos").alias("ref_pos"))
    hits = grams(patterns, "pattern_id", "pattern").join(joins.small_side(ref), "gram").select(F.col("string_id").alias("pattern_id"), "pos", "ref_id", (F.col("ref_pos") - F.col("pos")).alias("diag"))
    row = F.row_number().over(Window.partitionBy("pattern_id", "ref_id", "diag").orderBy("pos"))
    end = F.max("pos").over(Window.partitionBy("pattern_id", "ref_id", "diag", "island")) + min_span
    each = hits.withColumn("island", F.col("pos") - row).withColumn("end", end)
    by_end = each.groupBy("pattern_id", "pos", "end").agg(F.count("*").alias("n"))
    longest = by_end.groupBy("pattern_id", F.col("pos").alias("begin")).agg(F.max(F.struct("end", "n")).alias("m")).select("pattern_id", "begin", "m.end", "m.n")
    before = Window.partitionBy("pattern_id").orderBy("begin")
    last, at = F.lag("end").over(before), F.lag("begin").over(before)
    held = (at == F.col("begin") - 1) & (last >= F.col("end"))
    found = longest.withColumn("held", F.coalesce(held, F.lit(False))).filter("not held").drop("held")
    return found.filter(F.col("n") <= most) if most else found


def mems(index: SuffixArray, pattern: str, least: int = 1, min_span: int = 1, most: int | None = None, split_span: int | None = None, split_width: int = 0) -> list[tuple[int, int, int]]:
    """(begin, end, occurrences) of the maximal stretches that occur at least ``least`` times.

    Stretches shorter than min_span or more frequent than ``most`` are left out. A stretch of
    split_span or more with up to split_width occurrences is replaced by the stretches through
    its middle that occur more often.
    """
    out, end, reach = [], 0, 0
    for x in range(len(pattern)):
        end = max(end, x)
        while end < len(pattern) and pattern[end] in "ACGT" and index.count(pattern[x : end + 1]) >= least:
            end += 1
        if end > max(reach, x):
            out.append((x, end, index.count(pattern[x:end])))
            reach = end
    if split_span is not None:
        split = []
        for a, b, n in out:
            if b - a >= split_span and n <= split_width:
                mid = (a + b) // 2
                split += [m for m in mems(index, pattern, n + 1) if m[0] <= mid < m[1]]
            else:
                split.append((a, b, n))
        out = sorted(set(split))
    return [m for m in out if m[1] - m[0] >= min_span and (most is None or m[2] <= most)]


def threshold_mems(index: SuffixArray, pattern: str, x: int) -> list[tuple[int, int, int]]:
    """The maximal stretches over place x for every number of occurrences."""
    found, least = set(), 1
    while True:
        over = [m for m in mems(index, pattern, least) if m[0] <= x < m[1]]
        if not over:
            return sorted(found)
        found |= set(over)
        least = min(m[2] for m in over) + 1


def find_mems(patterns: DataFrame, reference: str, **options) -> DataFrame:
    """pattern_id, begin, end, n for patterns (pattern_id, pattern)."""
    sent = patterns.sparkSession.sparkContext.broadcast(SuffixArray(reference))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *m) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in mems(sent.value, s or "", **options)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["pattern_id", "begin", "end", "n"])

    return patterns.select("pattern_id", "pattern").mapInArrow(run, "pattern_id long, begin int, end int, n long")


def threshold_matches(patterns: DataFrame, reference: str) -> DataFrame:
    """pattern_id, at, begin, end, n: threshold_mems() of patterns (pattern_id, pattern, at)."""
    sent = patterns.sparkSession.sparkContext.broadcast(SuffixArray(reference))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, x, *m) for i, s, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for m in threshold_mems(sent.value, s or "", x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["pattern_id", "at", "begin", "end", "n"])

    return patterns.select("pattern_id", "pattern", "at").mapInArrow(run, "pattern_id long, at int, begin int, end int, n long")


def locate_mems(found: DataFrame, patterns: DataFrame, reference: str) -> DataFrame:
    """pattern_id, begin, end, pos: the reference places of each stretch."""
    sent = patterns.sparkSession.sparkContext.broadcast(SuffixArray(reference))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, a, e, s in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                lo, hi = sent.value.range(s[a:e])
                rows += [(i, a, e, sent.value.order[k]) for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["pattern_id", "begin", "end", "pos"])

    return found.join(patterns, "pattern_id").select("pattern_id", "begin", "end", "pattern").mapInArrow(run, "pattern_id long, begin int, end int, pos long")
