"""Joins beyond equality: intervals, bounds, as-of, windows, matches with mismatches, Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import seeds


SMALL = 1 << 18  #: rows that may be sent to all executors


def small_side(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df marked to be sent to all executors if it has few rows, counted first; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exact_match(patterns: DataFrame, strings: DataFrame, size: int) -> DataFrame:
    """patterns (with a column pattern of ``size`` symbols) with string_id and pos of each occurrence."""
    grams = seeds.qgrams(strings, size).withColumnRenamed("gram", "pattern")
    return grams.join(small_side(patterns), "pattern").select(*patterns.columns, "string_id", "pos")


def hamming(a, b):
    """The number of places at which two strings of one length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def hamming_match(patterns: DataFrame, strings: DataFrame, size: int, seed: int, most: int) -> DataFrame:
    """Occurrences with at most ``most`` mismatches, none of them in the last ``seed`` symbols.

    The exact seed is an equi-join key; only pairs that share it are compared.
    """
    key = F.substring("pattern", size - seed + 1, seed)
    grams = seeds.qgrams(strings, size).withColumn("key", F.substring("gram", size - seed + 1, seed))
    pairs = grams.join(small_side(patterns).withColumn("key", key), "key").select("key", *patterns.columns, "string_id", "pos", "gram")
    return pairs.withColumn("mismatches", hamming(F.col("pattern"), F.col("gram"))).filter(F.col("mismatches") <= most)


def interval_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, cell: int) -> DataFrame:
    """Points with the half-open spans they lie in.

    Spans are listed under each cell of the axis that they touch, so that the join is an
    equi-join; ``cell`` should be about a span's length.
    """
    cells = F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))
    spans = spans.filter(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(cells))
    points = points.withColumn("_cell", F.floor(F.col(at) / cell))
    return points.join(spans, "_cell").filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_cell")


def bounds(values: DataFrame, base: DataFrame, key: str, group: int = 1 << 16) -> DataFrame:
    """values with the number of base rows below (lower) and up to (upper) each; base's keys are distinct integers.

    Counts of stretches of the axis are summed up first, then each stretch is scanned by
    itself.
    """
    both = values.select(key, F.lit(0).alias("_n"), F.lit(1).alias("_asked")).unionByName(base.select(key, F.lit(1).alias("_n"), F.lit(0).alias("_asked")))
    both = both.withColumn("_g", F.floor(F.col(key) / group))
    sums = both.groupBy("_g").agg(F.sum("_n").alias("_s"))
    sums = sums.select("_g", F.coalesce(F.sum("_s").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_g").orderBy(key)
    upper = F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, 0))
    same = F.max("_n").over(Window.partitionBy("_g", key))
    out = both.withColumn("_u", upper).withColumn("_same", same).filter("_asked = 1").join(sums, "_g")
    return out.select(key, (F.col("_base") + F.col("_u") - F.col("_same")).alias("lower"), (F.col("_base") + F.col("_u")).alias("upper"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """left with the ``value`` of the last right row at or before it, by key (null if none).

    One pass over the union of both sides in order; of equally late right rows, the one with
    the largest value counts.
    """
    cols = left.columns
    r = right.groupBy(*by, at).agg(F.max(value).alias(value)).withColumn("_side", F.lit(0))
    both = left.withColumn(value, F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_side = 1").select(*cols, value)


def window_join(left: DataFrame, right: DataFrame, by: str, lo: str, hi: str, at: str) -> DataFrame:
    """Pairs of one key whose right place lies in the left row's half-open window."""
    return left.join(right, by).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)))


def bloom_semi_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is among keys. Spark adds a Bloom filter to the scan of rows where it pays (spark.sql.optimizer.runtime.bloomFilter.enabled)."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")
