"""Mixing sources to target weights, with DataFrame operations only.

1. The words of each source are packed end to end into blocks of ``block`` words.
2. Each output shard of ``shard`` slots draws its counts of the sources' blocks from a
   multinomial over the sources' numbers of slots. Sources that the draws leave short get
   the rest in a closing shard; slots beyond a source's number are not filled. So shards vary
   as a multinomial does, and totals meet the targets.
3. A source's k-th slot takes the block at place k of a pseudorandom permutation of its
   blocks (a swap-or-not shuffle: a bijection for any number of blocks), a new permutation
   for each pass. Two passes are the most, so nothing is taken more than twice.
4. Slots and documents meet by block number, an equi-join without hot keys.

Packing orders the documents of a source by (hash bucket, doc_id, hash of the row), so the
mix is a function of the rows, whatever their order; places come from sums over cells of
buckets, over buckets and, within each, over its few rows, so that a source with a third of
all rows is never in one task. The number of buckets follows the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, partitions, stored, sums_before, table

WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"  #: a word with the white space before it


@dataclass(frozen=True)
class Mix:
    ratio: float = 1.5
    weights: tuple[float, ...] = (3, 1, 2)
    most: int = 2
    block: int = 32
    shard: int = 1 << 14
    rounds: int = 8
    bucket_rows: int = 512
    seed: int = 20


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, a row number, a hash of the row (equal rows are alike in all that follows) and the size in words, stored."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    like = F.xxhash64(*docs.columns)
    return stored(docs.select(*keep, size.alias("size"), like.alias("like"), F.monotonically_increasing_id().alias("row")), "mixing")


def targets(rows: DataFrame, p: Mix) -> DataFrame:
    """source, s (its number), source_size, target, blocks, slots.

    Sources are in code-point order, null last. Targets share ratio x all sizes by weight;
    a source stops at ``most`` times its size, and the excess is shared by weight among the
    others: the level at which all targets sum up is found over the sources in the order of
    cap / weight.
    """
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))  # the sources: a row for each
    s = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    t = total.withColumn("s", s).withColumn("weight", weights[F.col("s") % len(p.weights)])
    t = t.withColumn("cap", F.col("source_size") * float(p.most)).withColumn("all", F.sum("source_size").over(every) * p.ratio)
    by_level = every.orderBy(F.col("cap") / F.col("weight"), "s")
    capped = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("all") - capped) / open_weight)
    level = F.min_by(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))).over(every)
    t = t.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / p.block)
    slots = F.when(blocks > 0, F.round(F.col("target") / F.col("source_size") * blocks)).otherwise(0).cast("long")
    return cut(t.select("source", "s", "source_size", "target", blocks.alias("blocks"), slots.alias("slots")))


def _uniform(n: Column, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), n)


def slots(sources: DataFrame, p: Mix) -> DataFrame:
    """s, shard, k, block: the source's k-th slot lies in that output shard and takes that block."""
    spark = sources.sparkSession
    n = sources.agg(F.sum("slots")).first()[0] or 0
    # a slot's source is the one in whose stretch of 0..n a uniform number falls; stretches meet it by equal cells
    cell = 1 << 16
    ends = sources.filter("slots > 0").withColumn("hi", F.sum("slots").over(Window.partitionBy(F.lit(0)).orderBy("s"))).withColumn("lo", F.col("hi") - F.col("slots"))
    cells = ends.select("s", "lo", "hi", F.explode(F.sequence((F.col("lo") / cell).cast("long"), ((F.col("hi") - 1) / cell).cast("long"))).alias("cell"))
    drawn = spark.range(n).select(F.expr(f"id div {p.shard}").alias("shard"), _uniform(F.lit(max(n, 1)), F.lit(p.seed), "id").alias("u")).withColumn("cell", F.expr(f"u div {cell}"))
    counts = drawn.join(cells, "cell").filter("u >= lo and u < hi").groupBy("shard", "s").agg(F.count("*").alias("n"))
    # places within each source, shard by shard; then what is missing
    counts = sums_before(counts, "n", "s", "shard").withColumnRenamed("before", "first").join(sources.select("s", "blocks", "slots"), "s")
    filled = cut(counts.withColumn("n", F.least("n", F.greatest(F.col("slots") - F.col("first"), F.lit(0)))).filter("n > 0").select("s", "blocks", "shard", "first", "n"))
    have = filled.groupBy("s").agg(F.sum("n").alias("have"))
    closing = sources.join(have, "s", "left").select("s", "blocks", F.lit(n // p.shard + 1).cast("long").alias("shard"), F.coalesce("have", F.lit(0)).alias("first"), (F.col("slots") - F.coalesce("have", F.lit(0))).alias("n")).filter("n > 0")
    # few rows that become many slots: spread before they do
    spread = filled.unionByName(closing).repartition(partitions(spark), "s", "first")
    k = spread.select("s", "shard", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
    x = k.select("s", "shard", "blocks", "k", F.expr("k div blocks").alias("pass"), F.expr("k % blocks").alias("x"))

    def swap_or_not(x: Column, r: Column) -> Column:
        """One round: x and key - x are a pair, which is swapped or not."""
        y = F.pmod(_uniform(F.col("blocks"), F.lit(p.seed), F.col("s"), F.col("pass"), r) - x, F.col("blocks"))
        swap = F.xxhash64(F.lit(p.seed), F.col("s"), F.col("pass"), r, F.greatest(x, y)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, y).otherwise(x)

    # all rounds in one expression: as columns one after another they would swell the plan
    block = F.aggregate(F.sequence(F.lit(0), F.lit(p.rounds - 1)), F.col("x"), swap_or_not)
    return x.select("s", "shard", "k", F.coalesce(block, F.lit(-1).cast("long")).alias("block"))


def drawn(sources: DataFrame, p: Mix) -> DataFrame:
    """s, block, taken: how often each block is taken (blocks never taken are left out)."""
    return slots(sources, p).groupBy("s", "block").agg(F.count("*").alias("taken"))


def packed(rows: DataFrame, sources: DataFrame, p: Mix) -> DataFrame:
    """rows with s and start, the place of their first word in the source's sequence of words."""
    buckets = int(rows.count() // p.bucket_rows + 1)
    rows = rows.join(sources.select(F.col("source").alias("its"), "s"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "like", F.lit(p.seed)), F.lit(buckets)))
    sums = sums_before(rows.groupBy("s", "bucket").agg(F.sum("size").alias("n")), "n", "s", "bucket").select("s", "bucket", F.col("before").alias("base"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("size").over(earlier.partitionBy("s", "bucket").orderBy("doc_id", "like", "row")), F.lit(0))
    return rows.withColumn("inner", inner).join(sums, ["s", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner", "bucket")


def overlaps(rows: DataFrame, taken: DataFrame, p: Mix, *keep: str) -> DataFrame:
    """row, a, n, taken: the words a .. a+n of a row lie in a block that is taken so often."""
    lo, end, b = F.col("start"), F.col("start") + F.col("size"), F.col("block")
    parts = rows.filter("size > 0").select("row", "s", "start", "size", F.explode(F.sequence(F.expr(f"start div {p.block}"), F.expr(f"(start + size - 1) div {p.block}"))).alias("block"))
    a = F.greatest(lo, b * p.block)
    return parts.join(taken.hint("merge"), ["s", "block"]).select("row", *keep, (a - lo).alias("a"), (F.least(end, (b + 1) * p.block) - a).alias("n"), "taken")


def mix(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs.

    A null text has size 0; a row of size 0 is taken 0 times. A null source is a source of
    its own. Rows that repeat count each for itself; an empty table gives an empty result;
    columns beyond doc_id, text and source are ignored. The same rows give the same mix in
    any order; rows that are equal in these columns may swap what they take.
    """
    rows = sized(docs.select(F.col("doc_id").cast("long"), "source", "text"), "doc_id", "source")
    sources = targets(rows, p)
    got = overlaps(packed(rows, sources, p), drawn(sources, p), p).groupBy("row").agg(F.sum(F.col("n") * F.col("taken")).alias("taken"))
    own = sources.select(F.col("source").alias("its"), "source_size", "target")
    whole = rows.join(own, F.col("source").eqNullSafe(F.col("its"))).join(got, "row", "left")
    return whole.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """The mix as documents (all columns): each row's words that the mix takes, and again those it takes twice.

    A row of docs gives a row for each time that any of its words is taken (0 to ``most``);
    their order and white space stay, with a line break before what doesn't follow its
    predecessor in the document; n_chars is the new length. Null and empty texts are never
    taken; rows that repeat count each for itself; an empty table gives an empty result;
    columns beyond the five of documents are dropped.
    """
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = sized(docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars"), *cols)
    light = rows.select("row", "doc_id", "like", "source", "size")
    sources = targets(light, p)
    parts = overlaps(packed(light, sources, p), drawn(sources, p), p)
    spans = parts.select("row", F.explode(F.sequence(F.lit(1), F.col("taken").cast("int"))).alias("time"), F.struct("a", "n").alias("span"))
    spans = spans.groupBy("row", "time").agg(F.array_sort(F.collect_list("span")).alias("spans"))  # at most a row's own blocks
    words = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))

    def cut_out(w: Column) -> Column:
        """The taken words of all words w of a text."""

        def piece(x: Column, i: Column) -> Column:
            last = F.get("spans", i - 1)
            gap = F.when(last["a"] + last["n"] != x["a"], "\n").otherwise("")
            return F.concat(gap, F.array_join(F.slice(w, (x["a"] + 1).cast("int"), x["n"].cast("int")), ""))

        return F.array_join(F.transform("spans", piece), "")

    # the words as a lambda's argument: else the optimizer would split the text again for every span
    text = F.element_at(F.transform(F.array(words), cut_out), 1)
    whole = rows.join(spans.hint("merge"), "row").withColumn("text", text)  # both sides grow with the documents: neither is ever sent whole
    return whole.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def shards(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """The mix as output shards: shard, slot, source and text of every block taken.

    A shard's slots are its blocks in a pseudorandom order; a block's text is its ``block``
    words (a source's last block may have fewer) with the white space before them, and a line
    break where a document ends. Rows are treated as in mix().
    """
    rows = sized(docs.select(F.col("doc_id").cast("long"), "source", "text"), "doc_id", "source", "text")
    light = rows.select("row", "doc_id", "like", "source", "size")
    sources = targets(light, p)
    taken = slots(sources, p)
    where = packed(light, sources, p)
    parts = overlaps(where, taken.select("s", "block").distinct().withColumn("taken", F.lit(1)), p, "s", "block", "start")
    spans = parts.groupBy("row").agg(F.collect_list(F.struct("s", "block", "start", "a", "n")).alias("spans"))  # a row's own blocks
    words = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    pieces = rows.join(spans.hint("merge"), "row").select(F.explode(F.element_at(F.transform(F.array(words), lambda w: F.transform("spans", lambda x: F.struct(
        x["s"].alias("s"), x["block"].alias("block"), (x["start"] + x["a"]).alias("at"),
        F.array_join(F.slice(w, (x["a"] + 1).cast("int"), x["n"].cast("int")), "").alias("t"),
    ))), 1)).alias("x")).select("x.*")
    blocks = pieces.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("ts"))  # ``block`` words at most
    blocks = blocks.select("s", "block", F.array_join("ts.t", "\n").alias("text"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(p.seed), "shard", "s", "k"), "s", "k")  # shard slots at most, and the closing shard
    placed = taken.withColumn("slot", F.row_number().over(order) - 1)
    return placed.join(blocks.hint("merge"), ["s", "block"]).join(sources.select("s", "source"), "s").select("shard", "slot", "source", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
