"""Seeds and q-grams of sets of sequences.

A set of strings is a DataFrame (string_id, seq); coordinates are half-open and 0-based.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.functions import codecs


def uniform_begins(length: Column, size: int, interval: int) -> Column:
    """Starts 0, interval, 2 interval, .. of stretches that fit; empty if none does."""
    n = length - size
    return F.when(n >= 0, F.sequence(F.lit(0), n.cast("int"), F.lit(interval))).otherwise(F.array().cast("array<int>"))


def seeds(strings: DataFrame, size: int, interval: int = 1) -> DataFrame:
    """string_id, begin, end of uniform seeds."""
    return strings.select("string_id", F.explode(uniform_begins(F.length("seq"), size, interval)).alias("begin")).withColumn("end", F.col("begin") + size)


def custom_seeds(strings: DataFrame, ranges: Callable[[Column], Column]) -> DataFrame:
    """Seeds by a function of the length that gives an array of structs (begin, end)."""
    return strings.select("string_id", F.explode(ranges(F.length("seq"))).alias("r")).select("string_id", "r.begin", "r.end")


def mapper_stride(length: Column, m: float = 1.15) -> Column:
    """The seed stride of a read: int(1 + m sqrt(length)); m is 0.75 for local alignment."""
    return (1 + m * F.sqrt(length)).cast("int")


def mapper_seeds(reads: DataFrame, size: int, m: float = 1.15, retry: int = 0, max_reseed: int = 2) -> DataFrame:
    """string_id, begin, end of a read mapper's seeds; each retry starts at a later offset."""
    stride = mapper_stride(F.length("seq"), m)
    offset = F.floor(retry * stride / (max_reseed + 1)).cast("int")
    last = (F.length("seq") - size).cast("int")
    begins = F.when(last >= offset, F.sequence(offset, last, stride)).otherwise(F.array().cast("array<int>"))
    return reads.select("string_id", F.explode(begins).alias("begin")).withColumn("end", F.col("begin") + size)


def extract(strings: DataFrame, coords: DataFrame) -> DataFrame:
    """coords with the stretch each names (a sparse string-set over its base strings)."""
    return coords.join(strings, "string_id").select(*coords.columns, codecs.infix(F.col("seq"), F.col("begin"), F.col("end")).alias("infix"))


STRETCH = 64  #: symbols by which long sequences are cut before grams are taken


def stretches(strings: DataFrame, size: int, more: int = 0) -> DataFrame:
    """string_id, begin, stretch: each sequence cut every ``size`` symbols, each cut with ``more`` (size at most) that follow.

    Time is linear in a sequence's length.
    """
    if more > size:
        raise ValueError("a stretch can't reach beyond the next one")
    parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    reach = lambda p: F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(p, i + 1), 1, more), F.lit(""))))
    # the parts as a lambda's argument: else the sequence would be cut again for every part
    rows = strings.select("string_id", F.posexplode(F.element_at(F.transform(F.array(parts), reach if more else lambda p: p), 1)).alias("at", "stretch"))
    return rows.select("string_id", (F.col("at") * size).alias("begin"), "stretch")


def qgrams(strings: DataFrame, q: int, interval: int = 1) -> DataFrame:
    """string_id, pos, gram: no join, as each sequence gives its own grams.

    Grams are taken from stretches, as a place in a string is found by walking from its start.
    """
    size = -(-max(STRETCH, q) // interval) * interval  # a multiple, so that places stay multiples
    rows = stretches(strings, size, q - 1)
    begins = F.filter(uniform_begins(F.length("stretch"), q, interval), lambda x: x < size)
    return rows.select("string_id", "begin", "stretch", F.explode(begins).alias("at")).select(
        "string_id", (F.col("begin") + F.col("at")).alias("pos"), F.expr(f"substring(stretch, at + 1, {q})").alias("gram")
    )


def packed_qgrams(strings: DataFrame, q: int, interval: int = 1) -> DataFrame:
    """string_id, pos, gram as qgrams() gives them, of sequences of A, C, G, T only; a gram is a long of two bits a symbol (q up to 31).

    Long sequences are taken piece by piece.
    """
    if not 0 < q < 32:
        raise ValueError("a long holds 1 to 31 symbols")
    kind = strings.schema["string_id"].dataType.simpleString()
    piece = -(-(1 << 18) // interval) * interval  # a multiple, so that places stay multiples
    code = np.zeros(256, np.int64)
    code[list(b"ACGT")] = range(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, grams, n = [], [], [], 0

            def out():
                at = b.column(0).take(pa.array(np.concatenate(rows)))  # noqa: B023
                return pa.record_batch([at, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(grams))], ["string_id", "pos", "gram"])  # noqa: B023

            for k, seq in enumerate(b.column(1)):
                codes = np.frombuffer(seq.as_py().encode(), np.uint8)
                for begin in range(0, len(codes) - q + 1, piece):
                    c = code[codes[begin : begin + piece + q - 1]]
                    count = len(c) - q + 1
                    pos = np.arange(0, count, interval)
                    gram = np.zeros(len(pos), np.int64)
                    for i in range(q):
                        gram = gram << 2 | c[i : i + count : interval]
                    rows, places, grams, n = [*rows, np.full(len(pos), k)], [*places, pos + begin], [*grams, gram], n + len(pos)
                    if n >= 1 << 16:
                        yield out()
                        rows, places, grams, n = [], [], [], 0
            if n:
                yield out()

    return strings.select("string_id", "seq").filter("seq is not null").mapInArrow(run, f"string_id {kind}, pos int, gram long")


def without_ambiguity(grams: DataFrame) -> DataFrame:
    return grams.filter(~F.col("gram").rlike("[^ACGT]"))
