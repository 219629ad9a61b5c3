"""Queries of scalar functions, filters and seeds."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from helixframe.functions import codecs, numbers
from helixframe.operators import seeds

from .harness import SEQS, grams_sql, query, read, sequences


@query(f"WITH {SEQS} SELECT string_id, translate(seq, 'ACGT', '0123') AS digits, seq AS back FROM seqs")
def symbol_codec(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("digits", codecs.to_digits(F.col("seq")))
    return s.select("string_id", "digits", codecs.from_digits(F.col("digits")).alias("back"))


@query(f"""WITH {SEQS} SELECT string_id, reverse(seq) AS reversed, translate(seq, 'ACGT', 'TGCA') AS complement,
reverse(translate(seq, 'ACGT', 'TGCA')) AS reverse_complement FROM seqs""")
def strands(spark, sf_dir):
    c = F.col("seq")
    return sequences(spark, sf_dir).select("string_id", F.reverse(c).alias("reversed"), codecs.complement(c).alias("complement"), codecs.reverse_complement(c).alias("reverse_complement"))


@query(f"""WITH {SEQS} SELECT string_id, substring(seq, 5, 12) AS infix, substring(seq, 1, 8) AS prefix,
CASE WHEN length(seq) > 3 THEN substring(seq, 4) ELSE '' END AS suffix, length(seq)::INT AS len FROM seqs""")
def infixes(spark, sf_dir):
    c = F.col("seq")
    return sequences(spark, sf_dir).select("string_id", codecs.infix(c, F.lit(4), F.lit(16)).alias("infix"), codecs.prefix(c, 8).alias("prefix"), codecs.suffix(c, 3).alias("suffix"), F.length(c).alias("len"))


@query(f"""WITH {SEQS}, {grams_sql("g", "seqs", 20, 10)} SELECT string_id, pos,
list_sum([((strpos('ACGT', substring(gram, (j + 1)::INT, 1)) - 1)::BIGINT << (2 * j)::INT) for j in range(20)])::BIGINT AS code FROM g""")
def qgram_codes(spark, sf_dir):
    return seeds.qgrams(sequences(spark, sf_dir), 20, 10).select("string_id", "pos", codecs.qgram_code(F.col("gram")).alias("code"))


@query(f"WITH {SEQS} SELECT string_id, length(seq) - length(replace(seq, 'T', '')) AS n, least(length(seq) - length(replace(seq, 'T', '')), 50) AS capped FROM seqs")
def symbol_counts(spark, sf_dir):
    c = F.col("seq")
    return sequences(spark, sf_dir).select("string_id", codecs.occurrences(c, "T").cast("long").alias("n"), codecs.occurrences(c, "T", 50).cast("long").alias("capped"))


@query("""SELECT o_orderkey, bit_count(o_orderkey)::INT AS ones, CASE WHEN o_orderkey = 0 THEN 0 ELSE bit_count(xor(o_orderkey, o_orderkey - 1)) END::INT AS lowest,
(64 - CASE WHEN o_orderkey = 0 THEN 0 ELSE length(bin(o_orderkey)) END)::INT AS leading,
[i for i in range(63) if ((o_orderkey >> i::INT) & 1) = 1][2]::INT AS second FROM orders""")
def bit_counts(spark, sf_dir):
    x = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(x, numbers.popcount(x).alias("ones"), numbers.lowest_bit(x).alias("lowest"), numbers.leading_zeros(x).alias("leading"), numbers.nth_bit(x, 2).alias("second"))


@query("""SELECT l_orderkey, l_linenumber, ceil(l_partkey / 7)::BIGINT AS up, floor(l_partkey / 7)::BIGINT AS down, ceil(l_partkey / 16)::BIGINT * 16 AS round_up,
floor(l_partkey / 16)::BIGINT * 16 AS round_down,
((l_partkey - 500) - (((l_partkey - 500) % 16) + 16) % 16) + CASE WHEN 2 * ((((l_partkey - 500) % 16) + 16) % 16) > 16 THEN 16 ELSE 0 END AS snapped,
floor(log2(l_partkey + 1))::INT AS log2, greatest(least(floor(l_discount * 8), 7), 0)::INT AS quantized,
CASE WHEN l_partkey > 500 THEN 1 WHEN l_partkey < 500 THEN -1 ELSE 0 END AS side, (((l_partkey * 1664525 + 1013904223) % 4294967296))::BIGINT AS next FROM lineitem""")
def integer_math(spark, sf_dir):
    x = F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.divide_up(x, 7).alias("up"), numbers.divide_down(x, 7).alias("down"), numbers.round_up(x, 16).alias("round_up"),
        numbers.round_down(x, 16).alias("round_down"), numbers.snap(x - 500, 16).alias("snapped"), numbers.log2_floor(x + 1).alias("log2"),
        numbers.quantize(F.col("l_discount"), 8).alias("quantized"), numbers.sign(x - 500).alias("side"), numbers.lcg(x).alias("next"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 2.0 + 1.0 AS affine, abs(l_quantity * 2.0 + 1.0) * 0.5 AS composed, 7 AS constant,
least(l_quantity, l_tax, l_discount) AS least3, greatest(l_quantity, l_tax, l_discount) AS most3 FROM lineitem""")
def functors(spark, sf_dir):
    f = lambda x: numbers.linear(x, 2.0, 1.0)
    x = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", f(x).alias("affine"), numbers.compose(lambda v: v * 0.5, F.abs, f)(x).alias("composed"), F.lit(7).alias("constant"),
        F.least("l_quantity", "l_tax", "l_discount").alias("least3"), F.greatest("l_quantity", "l_tax", "l_discount").alias("most3"),
    )


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def copy_if(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 25").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_returnflag, bool_or(l_quantity > 49) AS any_large, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY l_returnflag")
def any_all(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.bool_or(F.col("l_quantity") > 49).alias("any_large"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"))


@query("""SELECT l_orderkey, bool_and(coalesce(before <= l_partkey, true)) AS is_sorted FROM
(SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem) GROUP BY l_orderkey""")
def segments_sorted(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return read(spark, sf_dir, "lineitem").withColumn("before", F.lag("l_partkey").over(w)).groupBy("l_orderkey").agg(F.bool_and(F.coalesce(F.col("before") <= F.col("l_partkey"), F.lit(True))).alias("is_sorted"))


@query(f"""WITH {SEQS} SELECT string_id, begin::INT AS begin, (begin + 20)::INT AS "end" FROM
(SELECT string_id, unnest(range(0, length(seq) - 19, 10)) AS begin FROM seqs WHERE length(seq) >= 20)""")
def uniform_seeds(spark, sf_dir):
    return seeds.seeds(sequences(spark, sf_dir), 20, 10)


@query(f"""WITH {SEQS}, r AS (SELECT string_id, length(seq)::INT AS n, (1 + 1.15 * sqrt(length(seq))) AS f FROM seqs),
s AS (SELECT string_id, n, floor(f)::INT AS stride, floor(floor(f) / 3)::INT AS off FROM r)
SELECT string_id, begin::INT AS begin, (begin + 22)::INT AS "end" FROM (SELECT string_id, unnest(range(off, n - 21, stride)) AS begin FROM s WHERE n - 22 >= off)""")
def mapper_seeding(spark, sf_dir):
    return seeds.mapper_seeds(sequences(spark, sf_dir), 22, 1.15, retry=1, max_reseed=2)


@query("""WITH s AS (SELECT doc_id AS string_id, regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', '', 'g') AS seq FROM documents)
SELECT string_id, pos::INT AS pos, gram FROM (SELECT string_id, pos, substring(seq, (pos + 1)::INT, 8) AS gram FROM
(SELECT string_id, seq, unnest(range(0, length(seq) - 7, 4)) AS pos FROM s WHERE length(seq) >= 8)) WHERE NOT regexp_matches(gram, '[^ACGT]')""")
def seeds_without_n(spark, sf_dir):
    seq = F.regexp_replace(F.translate("text", "acgtn", "ACGTN"), "[^ACGTN]", "")
    s = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("string_id"), seq.alias("seq"))
    return seeds.without_ambiguity(seeds.qgrams(s, 8, 4))


@query(f"""WITH {SEQS}, {grams_sql("g", "seqs", 24, 24)} SELECT string_id, pos AS begin, (pos + 24)::INT AS "end", gram AS infix FROM g""")
def sparse_string_set(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return seeds.extract(s, seeds.seeds(s, 24, 24))
