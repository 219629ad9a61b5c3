"""A Bloom filter built by partial aggregation and tested in the JVM.

k places of a key come from two hashes, h1 + i h2, masked to a power-of-two size. The filter
is a table of 64-bit words, so it is as large as its number of words says and can be joined
or sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def places(key: Column, bits: int, k: int) -> Column:
    """The k places (0 .. bits-1) of a key; bits is a power of two."""
    if bits & (bits - 1):
        raise ValueError("the size must be a power of two")
    h1, h2 = F.xxhash64(key).bitwiseAND(F.lit(bits - 1)), F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(bits - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h1 + i * h2).bitwiseAND(F.lit(bits - 1)))


def build(keys: DataFrame, key: str, bits: int, k: int) -> DataFrame:
    """word, mask: the set words of the filter."""
    p = keys.select(F.explode(places(F.col(key), bits, k)).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    return p.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("mask"))


def contains(rows: DataFrame, key: str, filter_: DataFrame, bits: int, k: int) -> DataFrame:
    """rows whose key may be in the filter: all its places are set."""
    if bits <= 1 << 12:  # 64 words at most: a literal, and no join
        words = {r.word: r.mask for r in filter_.collect()}
        array = F.array(*[F.lit(words.get(w, 0)).cast("long") for w in range(max(1, bits // 64))])
        test = lambda p: F.call_function("shiftright", F.element_at(array, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
        return rows.filter(F.forall(places(F.col(key), bits, k), test))
    distinct = rows.select(key).distinct()
    p = distinct.select(key, F.explode(places(F.col(key), bits, k)).alias("p")).withColumn("word", F.floor(F.col("p") / 64))
    hit = p.join(filter_, "word", "left").groupBy(key).agg(F.bool_and(F.coalesce(F.expr("shiftright(mask, cast(p % 64 as int)) & 1 = 1"), F.lit(False))).alias("ok"))
    return rows.join(hit.filter("ok").select(key), key, "left_semi")
