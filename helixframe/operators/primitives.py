"""Reductions, scans, run lengths, ranks and samples as DataFrame programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def runlength_encode(rows: DataFrame, by: list[str], order: list[str], value: str, first: str) -> DataFrame:
    """by, value, first, n: runs of equal values within each group, with the ``first`` column of their first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", change).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, value, "_run").agg(F.min_by(first, F.struct(*order)).alias("first"), F.count("*").alias("n")).drop("_run")


def symbol_frequencies(strings: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """symbol, n, before: counts, and the counts of all smaller symbols. Counts within a sequence need no shuffle."""
    per = F.array(*[F.struct(F.lit(c).alias("symbol"), (F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))).cast("long").alias("n")) for c in sorted(alphabet)])
    n = strings.select(F.inline(per)).groupBy("symbol").agg(F.sum("n").alias("n")).filter("n > 0")
    return n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("symbol").rowsBetween(*_BEFORE)), F.lit(0)))  # a row for each symbol


def best(rows: DataFrame, by: list[str], score: Column, keep: list[str]) -> DataFrame:
    """The row of the largest score of each group: an aggregate, so rows are reduced before they move."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*keep), score).alias("_b")).select(*by, "_b.*")


def best_two(rows: DataFrame, by: str, distance: int) -> DataFrame:
    """by, pos1, score1, pos2, score2: the best (score, then pos), and the best further than ``distance`` from it."""
    order = F.struct("score", "pos")
    first = rows.groupBy(by).agg(F.max_by(F.struct("pos", "score"), order).alias("_b")).select(by, F.col("_b.pos").alias("pos1"), F.col("_b.score").alias("score1"))
    far = rows.join(first, by).filter(F.abs(F.col("pos") - F.col("pos1")) > distance)
    second = far.groupBy(by).agg(F.max_by(F.struct("pos", "score"), order).alias("_b")).select(by, F.col("_b.pos").alias("pos2"), F.col("_b.score").alias("score2"))
    return first.join(second, by, "left")


def scans(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(*_BEFORE)
    return rows.withColumn("inclusive", F.sum(value).over(upto)).withColumn("exclusive", F.coalesce(F.sum(value).over(before), F.lit(0))).withColumn("running_max", F.max(value).over(upto))


def global_scan(rows: DataFrame, key: str, value: str, name: str, group: int = 1 << 16) -> DataFrame:
    """The running sum of value in the order of an integer key with distinct values.

    Keys are cut into stretches of ``group``; sums of stretches are few, and each stretch is
    scanned by itself.
    """
    rows = rows.withColumn("_g", F.floor(F.col(key) / group))
    sums = rows.groupBy("_g").agg(F.sum(value).alias("_n"))
    base = sums.select("_g", F.coalesce(F.sum("_n").over(Window.orderBy("_g").rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"))
    inner = F.sum(value).over(Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inner", inner).join(base, "_g").withColumn(name, F.col("_base") + F.col("_inner")).drop("_g", "_inner", "_base")


def rank_dictionary(strings: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """string_id, i, rank_A ..: how often each symbol occurs up to place i (1-based)."""
    c = strings.filter("seq != ''").select("string_id", F.posexplode(F.split("seq", "")).alias("i", "s")).withColumn("i", F.col("i") + 1)
    w = Window.partitionBy("string_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("string_id", "i", *[F.sum(F.when(F.col("s") == x, 1).otherwise(0)).over(w).alias(f"rank_{x}") for x in alphabet])


def weighted_samples(rows: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """k, key: for k in 0..n-1 the first row, by key, whose running weight exceeds k/n of all."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    cum = global_scan(rows.select(key, weight), key, weight, "_cum")
    # the places that a row covers: those from its running weight before it to that after it
    lo, hi = F.ceil((F.col("_cum") - F.col(weight)) * n / total), F.ceil(F.col("_cum") * n / total) - 1
    places = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return cum.select(key, F.explode(places).alias("k")).withColumn("k", F.col("k").cast("int"))


def both_ends(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The n smallest and n largest rows of each group, with their places from either end."""
    w = Window.partitionBy(*by)
    lo, hi = F.row_number().over(w.orderBy(*order)), F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("lo", lo).withColumn("hi", hi).filter((F.col("lo") <= n) | (F.col("hi") <= n))


def least_per_key(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def sequence_stats(strings: DataFrame) -> DataFrame:
    n = F.length("seq")
    return strings.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"), F.count("*").alias("n"))
