"""Statistics and comparison of sets of alignments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixframe.functions import numbers


def counts(rows: DataFrame, cases: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that meet each condition, in one pass."""
    return rows.agg(*[F.count_if(c).alias(name) for name, c in cases.items()])


def boolean_stats(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return counts(rows, {"l": a, "r": b, "l_not_r": a & ~b, "r_not_l": b & ~a, "both": a & b})


def compare(left: DataFrame, right: DataFrame, read_len: int) -> DataFrame:
    """Both sides of each read (columns l_*, r_*), whether they are distant (other reference, or further apart than a read) or discordant (other strand)."""
    l, r = (x.select("read_id", *[F.col(c).alias(f"{p}_{c}") for c in x.columns if c != "read_id"]) for x, p in ((left, "l"), (right, "r")))  # noqa: E741
    distant = (F.col("l_ref") != F.col("r_ref")) | (F.abs(F.col("l_pos") - F.col("r_pos")) > read_len)
    return l.join(r, "read_id", "full").withColumn("distant", distant).withColumn("discordant", F.col("l_rc") != F.col("r_rc"))


def difference_histograms(pairs: DataFrame, metrics: dict[str, Column], bin: Callable | None = None) -> DataFrame:
    """metric, bin, n, n_distant, n_discordant over all metrics in one pass."""
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("d")) for k, v in metrics.items()])
    long = pairs.select("distant", "discordant", F.inline(rows))
    return long.groupBy("metric", (bin or numbers.log_bin)(F.col("d")).alias("bin")).agg(F.count("*").alias("n"), F.count_if("distant").alias("n_distant"), F.count_if("discordant").alias("n_discordant"))


def histogram(rows: DataFrame, x: str, half: int) -> DataFrame:
    """bin, n, below, above, others: a histogram of 2 x half bins, clamped, with cumulative counts from either side."""
    bins = rows.groupBy(F.greatest(F.least(F.col(x) + half, F.lit(2 * half - 1)), F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # 2 x half rows
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = every.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return bins.select("bin", "n", F.sum("n").over(upto).alias("below"), F.sum("n").over(down).alias("above"), (F.sum("n").over(every) - F.col("n")).alias("others"))


def histogram_2d(rows: DataFrame, size: int) -> DataFrame:
    clamp = lambda c: F.greatest(F.least(F.col(c), F.lit(size - 1)), F.lit(0)).cast("int").alias(c)
    return rows.groupBy(clamp("x"), clamp("y")).agg(F.count("*").alias("n"))


# Fixed values of the comparison's filters: a filter names a kind of pair, a metric and the least difference.
KINDS = {"all": "true", "distant": "distant", "discordant": "discordant", "diff_ref": "l_ref != r_ref"}


def filtered(pairs: DataFrame, kind: str, difference: Column, least: int) -> DataFrame:
    """The compared reads of a kind whose difference is at least so large."""
    return pairs.filter(F.expr(KINDS[kind])).filter(difference >= least)


def length_histograms(reads: DataFrame) -> DataFrame:
    return reads.groupBy(numbers.length_bin(F.length("seq")).alias("length_bin")).agg(F.count("*").alias("n"))


def edit_correlation(pairs: DataFrame, size: int = 64) -> DataFrame:
    """x, y, n: both sides' edit distances against each other, clamped."""
    return histogram_2d(pairs.filter("l_ed is not null and r_ed is not null").select(F.col("l_ed").alias("x"), F.col("r_ed").alias("y")), size)


def report_html(title: str, tables: dict[str, DataFrame], most: int = 1000) -> str:
    """A page with the tables given (summaries: up to ``most`` rows of each are shown, and the page says so where there are more)."""
    import html

    out = [f"<html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
        out.append(f"<h2>{html.escape(name)}</h2><table>" + cells("th", df.columns) + "".join(cells("td", r) for r in rows[:most]) + "</table>")
        if len(rows) > most:
            out.append(f"<p>The first {most} rows.</p>")
    return "\n".join([*out, "</body></html>"])


#: metric: (whether higher values are better, whether its own histogram has logarithmic bins). Fixed values.
METRICS = {
    "score": (True, True), "mapq": (True, True), "mapped": (True, True), "pos": (True, True),
    "ed": (False, False), "subs": (False, False), "ins": (False, False), "dels": (False, False), "mms": (False, False),
}


def difference_statistics(pairs: DataFrame, metrics: dict[str, tuple[bool, bool]] | None = None) -> DataFrame:
    """metric, side, kind, x, bin, n, n_distant, n_discordant: all histograms of two compared sets, in one pass.

    pairs: as compare() gives them, both sides present, with l_ and r_ of every metric and of
    mapq, and length_bin. kind: value, value_by_length and value_by_mapq (of every row of a
    side); diff, diff_by_length, diff_by_mapq (its own), diff_by_other_mapq and diff_by_value
    (of the rows where the side is not worse, by how much). x is the second bin, or null.

    Equal combinations of bins are counted first, a row a metric; the histograms are sums over these.
    """
    log, no = numbers.log_bin, F.lit(None).cast("int")
    each = []
    for name, (higher, by_log) in (METRICS if metrics is None else metrics).items():
        l, r = F.col(f"l_{name}").cast("long"), F.col(f"r_{name}").cast("long")  # noqa: E741
        d = l - r if higher else r - l  # by how much the left side is better
        row = [F.lit(name).alias("metric"), F.lit(higher).alias("higher"), F.lit(by_log).alias("by_log")]
        each.append(F.struct(*row, *[(log(v) if by_log else v).cast("long").alias(c) for c, v in (("l_own", l), ("r_own", r), ("l_better", d))]))
    mapq = [log(F.col(f"{s}_mapq").cast("long")).alias(f"{s}_mapq") for s in "lr"]
    rows = pairs.select("distant", "discordant", "length_bin", *mapq, F.inline(F.array(*each)))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("r_better", -F.col("l_better"))  # bins are alike on both sides of 0
    binned = lambda c: F.when(F.col("by_log"), F.col(c)).otherwise(log(F.col(c)))
    rows = rows.select("*", *[binned(f"{s}_{c}").alias(f"{s}_{c}_log") for s in "lr" for c in ("own", "better")])
    out = []
    for side, other in (("l", "r"), ("r", "l")):
        own, better = F.col(f"{side}_own"), F.col(f"{side}_better")
        own_log, better_log, its_log = F.col(f"{side}_own_log"), F.col(f"{side}_better_log"), F.col(f"{other}_own_log")
        worth = F.when(F.col("higher"), its_log).otherwise(own_log)  # the value that differences are set against
        kind = lambda kind, x, bin, ok: F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), x.cast("int").alias("x"), bin.cast("int").alias("bin"), ok.alias("ok"))  # noqa: E731, B023
        every, good = F.lit(True), better >= 0
        out += [
            kind("value", no, own, every), kind("value_by_length", F.col("length_bin"), own_log, every), kind("value_by_mapq", F.col(f"{side}_mapq"), own_log, every),
            kind("diff", no, better, good), kind("diff_by_length", F.col("length_bin"), better_log, good), kind("diff_by_mapq", F.col(f"{side}_mapq"), better_log, good),
            kind("diff_by_other_mapq", F.col(f"{other}_mapq"), better_log, good), kind("diff_by_value", worth, better_log, good),
        ]
    rows = rows.select("metric", "n", "distant", "discordant", F.inline(F.array(*out))).filter("ok")
    n = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return rows.groupBy("metric", "side", "kind", "x", "bin").agg(F.sum("n").alias("n"), n("distant").alias("n_distant"), n("discordant").alias("n_discordant"))


def stage_statistics(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """stage, rows, keys, most: of each stage of a pipeline its rows, its distinct keys, and the most rows of a key."""
    out = None
    for name, df in stages.items():
        per = df.groupBy(key).agg(F.count("*").alias("n"))
        one = per.agg(F.lit(name).alias("stage"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        one = one.select("stage", "rows", "keys", "most")
        out = one if out is None else out.union(one)
    return out
