"""Suffix order, Burrows-Wheeler transform and full-text search as DataFrame programs.

strings: (string_id, seq). Ranks over all suffixes are running sums in two steps (heads of
suffixes, then within each), so no task sees all suffixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from helixframe.functions import codecs

HEAD = 6  #: symbols by which suffixes are dealt out


def suffixes(strings: DataFrame) -> DataFrame:
    """string_id, pos, suffix, bwt of every suffix, the empty one included; bwt is the symbol before it, $ at a string's start."""
    rows = strings.select("string_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq"))).alias("pos"))
    before = F.when(F.col("pos") == 0, "$").otherwise(F.expr("substring(seq, pos, 1)"))
    return rows.select("string_id", "pos", codecs.suffix(F.col("seq"), F.col("pos")).alias("suffix"), before.alias("bwt"))


def suffix_array(strings: DataFrame) -> DataFrame:
    """rank, string_id, pos, suffix, bwt: suffixes in order, ties by (string_id, pos). For sets of bounded strings."""
    rows = suffixes(strings).withColumn("_head", F.substring("suffix", 1, HEAD))
    heads = rows.groupBy("_head").agg(F.count("*").alias("_n"))
    heads = heads.select("_head", F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_head").orderBy("suffix", "string_id", "pos"))
    return rows.withColumn("_r", inner).join(heads, "_head").select((F.col("_base") + F.col("_r") - 1).alias("rank"), "string_id", "pos", "suffix", "bwt")


def prefix_doubling(symbols: DataFrame, rounds: int | None = None) -> DataFrame:
    """pos, rank of the suffixes of one long string given as rows (pos, symbol), pos from 0.

    Each round joins the ranks of 2^k-long prefixes with those that start 2^k later; it ends
    when all ranks differ. Lineage is cut by a reliable checkpoint each round.
    """
    order = symbols.groupBy("symbol").agg(F.count("*").alias("n"))
    order = order.select("symbol", (F.sum("n").over(Window.orderBy("symbol")) - F.col("n")).alias("rank"))
    ranks = symbols.join(order, "symbol").select("pos", "rank")
    total, step = ranks.count(), 1
    _shared(ranks.sparkSession)
    while True:
        nxt = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = ranks.join(nxt, "pos", "left").withColumn("next", F.coalesce("next", F.lit(-1)))
        inner = F.rank().over(Window.partitionBy("rank").orderBy("next")) - 1
        ranks = pairs.select("pos", (F.col("rank") + inner).alias("rank")).checkpoint()
        step *= 2
        if step >= total or ranks.select("rank").distinct().count() == total or (rounds is not None and step >= 2**rounds):
            return ranks


def _shared(spark) -> None:
    """A checkpoint folder: the session's; a new one only for a local session without."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            path = tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(path)


def primary(sa: DataFrame) -> DataFrame:
    """string_id, primary: the rank of each string's own whole suffix."""
    return sa.filter("pos = 0").select("string_id", F.col("rank").alias("primary"))


def sampled(sa: DataFrame, every: int, by: str = "pos") -> DataFrame:
    """rank, string_id, pos of the suffixes whose pos (or rank) is a multiple of ``every``."""
    return sa.filter(F.col(by) % every == 0).select("rank", "string_id", "pos")


def counts(sa: DataFrame) -> DataFrame:
    """symbol, n, before: occurrences in the BWT, and of all smaller symbols."""
    n = sa.groupBy(F.col("bwt").alias("symbol")).agg(F.count("*").alias("n"))
    return n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def occurrences(sa: DataFrame, every: int = 64) -> DataFrame:
    """symbol, block, occ: how often each symbol occurs in the BWT before each block of ``every`` rows."""
    per = sa.groupBy(F.col("bwt").alias("symbol"), F.floor(F.col("rank") / every).alias("block")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("symbol", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("occ"))


def lf_mapping(sa: DataFrame) -> DataFrame:
    """rank, lf: the rank of the suffix one symbol longer (no row for whole strings)."""
    a = sa.filter("bwt != '$'").select("string_id", (F.col("pos") - 1).alias("pos"), "rank")
    return a.join(sa.select("string_id", "pos", F.col("rank").alias("lf")), ["string_id", "pos"]).select("rank", "lf")


def match(sa: DataFrame, patterns: DataFrame, size: int) -> DataFrame:
    """pattern, first, last: the inclusive rank range of suffixes that begin with each pattern of ``size`` symbols."""
    keyed = sa.filter(F.length("suffix") >= size).groupBy(F.substring("suffix", 1, size).alias("pattern")).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    return patterns.select("pattern").distinct().join(keyed, "pattern")


def locate(sa: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    """pattern, string_id, pos of all occurrences."""
    return ranges.select("pattern").join(sa.filter(F.length("suffix") >= size).withColumn("pattern", F.substring("suffix", 1, size)), "pattern").select("pattern", "string_id", "pos")


def trie(strings: DataFrame, depth: int) -> DataFrame:
    """depth, prefix, leaves, children: the nodes of the trie of the distinct strings down to a depth.

    All levels come from one expansion of each string into its prefixes, not from a loop.
    """
    s = strings.select("seq").distinct()
    levels = F.sequence(F.lit(0), F.least(F.length("seq"), F.lit(depth)))
    nodes = s.select("seq", F.explode(levels).alias("depth")).withColumn("prefix", F.expr("left(seq, depth)"))
    child = F.expr("if(length(seq) > depth, substring(seq, depth + 1, 1), null)")
    return nodes.groupBy("depth", "prefix").agg(F.count("*").alias("leaves"), F.count_distinct(child).alias("children"))


def with_random_bases(seq, seed: int = 0):
    """Ambiguous symbols replaced by A, C, G or T as a hash of the place says."""
    symbols = F.split(seq, "")
    return F.array_join(F.transform(symbols, lambda c, i: F.when(c.isin("A", "C", "G", "T"), c).otherwise(F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(4)) + 1).cast("int"), F.lit(1)))), "")


def ambiguity_runs(strings: DataFrame) -> DataFrame:
    """string_id, symbol, begin, end of the runs of symbols other than A, C, G, T."""
    c = strings.filter("seq != ''").select("string_id", F.posexplode(F.split("seq", "")).alias("pos", "symbol")).filter(~F.col("symbol").isin("A", "C", "G", "T"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("string_id", "symbol").orderBy("pos"))
    return c.withColumn("run", run).groupBy("string_id", "symbol", "run").agg(F.min("pos").alias("begin"), (F.max("pos") + 1).alias("end")).drop("run")


def match_any(sa: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, first, last: inclusive rank ranges of patterns of any lengths (few distinct ones, which are counted first).

    Patterns that are empty or have other symbols than the text's match nothing.
    """
    lengths = [r.n for r in patterns.select(F.length("pattern").alias("n")).distinct().filter("n > 0").collect()]  # one row a length
    if not lengths:
        return sa.select(F.lit("").alias("pattern"), F.col("rank").alias("first"), F.col("rank").alias("last")).limit(0)
    heads = sa.select("rank", "suffix", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).filter(F.length("suffix") >= F.col("n"))
    keyed = heads.select("rank", F.expr("left(suffix, n)").alias("pattern")).join(patterns.select("pattern").distinct(), "pattern", "left_semi")
    return keyed.groupBy("pattern").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))


def match_reverse(reversed_sa: DataFrame, patterns: DataFrame) -> DataFrame:
    """As match_any(), for patterns searched from their last symbol in the order of the reversed strings (reversed_strings())."""
    turned = patterns.select(F.col("pattern").alias("given"), F.reverse("pattern").alias("pattern")).distinct()
    return match_any(reversed_sa, turned).join(turned, "pattern").select(F.col("given").alias("pattern"), "first", "last")


def reversed_strings(strings: DataFrame) -> DataFrame:
    return strings.withColumn("seq", F.reverse("seq"))


def save_index(sa: DataFrame, path: str, sample: int = 16) -> None:
    """An index as Parquet tables: the BWT by rank, sampled places, and counts of symbols."""
    sa.select("rank", "string_id", "bwt", (F.col("pos") == 0).alias("whole")).write.parquet(f"{path}/bwt")
    sampled(sa, sample).write.parquet(f"{path}/sa")
    counts(sa).write.parquet(f"{path}/counts")


def load_index(spark, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("bwt", "sa", "counts")}


def dictionary_trie(strings: DataFrame, depth: int) -> DataFrame:
    """depth, prefix, begin, end, is_leaf, children: the nodes of the trie over the sorted distinct strings, as ranges of them.

    A leaf is a node of one string. Ranks in the dictionary are running sums over prefixes, in
    two steps.
    """
    from .qgram import running_sum

    s = strings.select("seq").distinct()
    ranked = running_sum(s.withColumn("one", F.lit(1).cast("long")), "seq", "one", "rank")
    nodes = ranked.select("seq", "rank", F.explode(F.sequence(F.lit(0), F.least(F.length("seq"), F.lit(depth)))).alias("depth")).withColumn("prefix", F.expr("left(seq, depth)"))
    child = F.expr("if(length(seq) > depth, substring(seq, depth + 1, 1), null)")
    return nodes.groupBy("depth", "prefix").agg(F.min("rank").alias("begin"), (F.max("rank") + 1).alias("end"), (F.count("*") == 1).alias("is_leaf"), F.count_distinct(child).alias("children"))
