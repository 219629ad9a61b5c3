"""Queries of suffix order, full-text search, alignment and mapping."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from helixframe.functions import bloom, kernels, mapq as mq
from helixframe.operators import alignment, fulltext, mapper, seeds, suffix

from .file_queries import workspace
from .harness import BENCH, SEQS, grams_sql, query, read, sequences

_SA = f"""{BENCH}, e AS (SELECT string_id, pos::INT AS pos, substring(seq, (pos + 1)::INT) AS suffix, CASE WHEN pos = 0 THEN '$' ELSE substring(seq, pos::INT, 1) END AS bwt
FROM (SELECT string_id, seq, unnest(range(0, length(seq) + 1)) AS pos FROM bench)),
sa AS (SELECT row_number() OVER (ORDER BY suffix, string_id, pos) - 1 AS rank, string_id, pos, suffix, bwt FROM e)"""


def _bench(spark, sf_dir):
    return sequences(spark, sf_dir, "benchmark", "item_id")


def _sa(spark, sf_dir):
    return suffix.suffix_array(_bench(spark, sf_dir))


@query(f"WITH {_SA} SELECT rank, string_id, pos, bwt FROM sa")
def suffix_array(spark, sf_dir):
    return _sa(spark, sf_dir).select("rank", "string_id", "pos", "bwt")


@query(f"WITH {_SA} SELECT string_id, rank AS \"primary\" FROM sa WHERE pos = 0")
def bwt_primary(spark, sf_dir):
    return suffix.primary(_sa(spark, sf_dir))


@query(f"WITH {_SA} SELECT rank, string_id, pos FROM sa WHERE pos % 16 = 0")
def sampled_suffix_array(spark, sf_dir):
    return suffix.sampled(_sa(spark, sf_dir), 16)


@query(f"WITH {_SA} SELECT bwt AS symbol, count(*) AS n, (sum(count(*)) OVER (ORDER BY bwt) - count(*))::BIGINT AS before FROM sa GROUP BY bwt")
def bwt_counts(spark, sf_dir):
    return suffix.counts(_sa(spark, sf_dir))


@query(f"WITH {_SA}, p AS (SELECT bwt AS symbol, rank // 64 AS block, count(*) AS n FROM sa GROUP BY ALL) SELECT symbol, block, (sum(n) OVER (PARTITION BY symbol ORDER BY block) - n)::BIGINT AS occ FROM p")
def occurrence_table(spark, sf_dir):
    return suffix.occurrences(_sa(spark, sf_dir))


@query(f"WITH {_SA} SELECT a.rank, b.rank AS lf FROM sa a JOIN sa b ON a.string_id = b.string_id AND b.pos = a.pos - 1")
def lf_mapping(spark, sf_dir):
    return suffix.lf_mapping(_sa(spark, sf_dir))


@query(f"WITH {_SA}, p AS (SELECT DISTINCT substring(suffix, 1, 8) AS pattern FROM sa WHERE length(suffix) >= 8) SELECT pattern, min(rank) AS first, max(rank) AS last FROM sa JOIN p ON length(suffix) >= 8 AND substring(suffix, 1, 8) = pattern GROUP BY pattern")
def backward_search(spark, sf_dir):
    patterns = seeds.qgrams(_bench(spark, sf_dir), 8).select(F.col("gram").alias("pattern"))
    return suffix.match(_sa(spark, sf_dir), patterns, 8)


@query(f"WITH {_SA}, p AS (SELECT DISTINCT substring(suffix, 1, 8) AS pattern FROM sa WHERE length(suffix) >= 8) SELECT pattern, string_id, pos FROM sa JOIN p ON length(suffix) >= 8 AND substring(suffix, 1, 8) = pattern")
def locate(spark, sf_dir):
    sa = _sa(spark, sf_dir)
    patterns = seeds.qgrams(_bench(spark, sf_dir), 8).select(F.col("gram").alias("pattern"))
    return suffix.locate(sa, suffix.match(sa, patterns, 8), 8)


_ANY = "p AS (SELECT DISTINCT \"left\"(suffix, n::INT) AS pattern FROM sa, range(3, 12) r(n) WHERE length(suffix) >= n AND pos % n = 0)"


@query(f"WITH {_SA}, {_ANY} SELECT pattern, min(rank) AS first, max(rank) AS last FROM sa JOIN p ON starts_with(suffix, pattern) GROUP BY pattern")
def backward_search_any(spark, sf_dir):
    """Patterns of lengths 3 to 11."""
    sa = _sa(spark, sf_dir)
    patterns = sa.select("suffix", "pos", F.explode(F.sequence(F.lit(3), F.lit(11))).alias("n")).filter("length(suffix) >= n and pos % n = 0").select(F.expr("left(suffix, n)").alias("pattern"))
    return suffix.match_any(sa, patterns)


@query(f"WITH {_SA.replace('seq, unnest', 'reverse(seq) AS seq, unnest')}, p AS (SELECT DISTINCT reverse(substring(suffix, 1, 8)) AS pattern FROM sa WHERE length(suffix) >= 8) SELECT pattern, min(rank) AS first, max(rank) AS last FROM sa JOIN p ON starts_with(suffix, reverse(pattern)) GROUP BY pattern")
def reverse_search(spark, sf_dir):
    """Ranges of 8-mers in the order of the reversed strings."""
    back = suffix.suffix_array(suffix.reversed_strings(_bench(spark, sf_dir)))
    return suffix.match_reverse(back, seeds.qgrams(_bench(spark, sf_dir), 8).select(F.col("gram").alias("pattern")))


@query(f"WITH {_SA} SELECT 'bwt' AS part, bwt AS symbol, rank AS a, string_id AS b FROM sa UNION ALL SELECT 'sa', NULL, rank, pos FROM sa WHERE pos % 16 = 0 UNION ALL SELECT 'counts', bwt, count(*), (sum(count(*)) OVER (ORDER BY bwt) - count(*))::BIGINT FROM sa GROUP BY bwt")
def index_files(spark, sf_dir):
    """An index written as tables and loaded again."""
    path = workspace(spark, "index")
    suffix.save_index(_sa(spark, sf_dir), path)
    got = suffix.load_index(spark, path)
    long = lambda *cols: [F.col(c).cast("long") for c in cols]
    bwt = got["bwt"].select(F.lit("bwt").alias("part"), F.col("bwt").alias("symbol"), *long("rank", "string_id")).toDF("part", "symbol", "a", "b")
    sa = got["sa"].select(F.lit("sa"), F.lit(None).cast("string"), *long("rank", "pos"))
    return bwt.union(sa).union(got["counts"].select(F.lit("counts"), "symbol", *long("n", "before")))


@query(f"""WITH {BENCH}, s AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS rank FROM (SELECT DISTINCT seq FROM bench)), n AS (SELECT seq, rank, unnest(range(0, least(length(seq), 6) + 1))::INT AS depth FROM s)
SELECT depth, "left"(seq, depth) AS prefix, min(rank) AS begin, max(rank) + 1 AS "end", count(*) = 1 AS is_leaf, count(DISTINCT CASE WHEN length(seq) > depth THEN substring(seq, depth + 1, 1) END) AS children FROM n GROUP BY ALL""")
def dictionary_trie(spark, sf_dir):
    return suffix.dictionary_trie(_bench(spark, sf_dir), 6)


@query(f"""WITH {BENCH}, s AS (SELECT DISTINCT seq FROM bench), n AS (SELECT seq, unnest(range(0, least(length(seq), 4) + 1))::INT AS depth FROM s)
SELECT depth, "left"(seq, depth) AS prefix, count(*) AS leaves, count(DISTINCT CASE WHEN length(seq) > depth THEN substring(seq, depth + 1, 1) END) AS children FROM n GROUP BY ALL""")
def suffix_trie(spark, sf_dir):
    return suffix.trie(_bench(spark, sf_dir), 4)


@query("""WITH c AS (SELECT item_id AS string_id, pos::INT AS pos, substring(upper(translate(text, 'éèêàçñíóúáöäüßÉÈÊÀÇÑÍÓÚÁÖÄÜ', '')), (pos + 1)::INT, 1) AS symbol FROM
(SELECT item_id, text, unnest(range(0, length(translate(text, 'éèêàçñíóúáöäüßÉÈÊÀÇÑÍÓÚÁÖÄÜ', '')))) AS pos FROM benchmark)),
o AS (SELECT *, pos - row_number() OVER (PARTITION BY string_id, symbol ORDER BY pos) AS run FROM c WHERE symbol NOT IN ('A', 'C', 'G', 'T'))
SELECT string_id, symbol, min(pos)::INT AS begin, (max(pos) + 1)::INT AS "end" FROM o GROUP BY string_id, symbol, run""")
def ambiguity_runs(spark, sf_dir):
    seq = F.upper(F.translate("text", "éèêàçñíóúáöäüßÉÈÊÀÇÑÍÓÚÁÖÄÜ", ""))
    return suffix.ambiguity_runs(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("string_id"), seq.alias("seq")))


@query(f"""WITH {BENCH}, s AS (SELECT string_agg(seq, '' ORDER BY string_id) AS seq FROM bench WHERE seq <> '')
SELECT pos::BIGINT AS pos, row_number() OVER (ORDER BY substring(seq, (pos + 1)::INT)) - 1 AS rank FROM (SELECT seq, unnest(range(0, length(seq))) AS pos FROM s)""")
def prefix_doubling(spark, sf_dir):
    """Suffix order of all benchmark sequences as one string (ranks of places)."""
    s = _bench(spark, sf_dir).withColumn("n", F.length("seq")).withColumn("at", F.coalesce(F.sum("n").over(Window.orderBy("string_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = s.filter("n > 0").select("at", F.posexplode(F.split("seq", "")).alias("k", "symbol"))
    return suffix.prefix_doubling(rows.select((F.col("at") + F.col("k")).alias("pos"), "symbol"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500)")
def bloom_filter(spark, sf_dir):
    """Orders that a Bloom filter of customers lets through, then verified."""
    keys = read(spark, sf_dir, "customer").filter("c_acctbal > 9500").select(F.col("c_custkey").alias("o_custkey"))
    bits, k = 1 << 16, 3
    some = bloom.contains(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", bloom.build(keys, "o_custkey", bits, k), bits, k)
    return some.join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT a.conv_id, a.turn, -levenshtein(regexp_replace(a.text, '[^ -~]', '', 'g'), regexp_replace(b.text, '[^ -~]', '', 'g')) AS score FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def global_edit_distance(spark, sf_dir):
    c, plain = read(spark, sf_dir, "conversations"), F.regexp_replace("text", "[^ -~]", "")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), plain.alias("other"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", alignment.global_distance(plain, F.col("other")).cast("long").alias("score"))


def _pairs(spark, sf_dir):
    """Consecutive benchmark sequences."""
    s = _bench(spark, sf_dir)
    nxt = s.select((F.col("string_id") - 1).alias("pattern_id"), F.col("string_id").alias("text_id"), F.col("seq").alias("text"))
    return s.select(F.col("string_id").alias("pattern_id"), F.col("seq").alias("pattern")).join(nxt, "pattern_id")


_CONSECUTIVE = f"{BENCH}, p AS (SELECT a.string_id AS pattern_id, b.string_id AS text_id, a.seq AS pattern, b.seq AS text FROM bench a JOIN bench b ON b.string_id = a.string_id + 1)"


@query(f"WITH {_CONSECUTIVE} SELECT pattern_id, text_id, -levenshtein(pattern, text)::INT AS score FROM p")
def align_global(spark, sf_dir):
    return alignment.align(_pairs(spark, sf_dir), kernels.EDIT, "global").select("pattern_id", "text_id", "score")


#: rows (i: text place) of score matrices, one a step; w: the cells of a row, without those that end with an insertion
_ROWS = """WITH RECURSIVE {consecutive}, p1 AS (SELECT pattern_id, text_id, pattern, text FROM p WHERE pattern <> '' AND text <> ''),
c AS (SELECT pattern_id, unnest(range(1, length(pattern) + 1)) AS j, pattern, text FROM p1),
m AS (SELECT pattern_id, 0 AS i, j, {first} AS h, -1000000 AS f FROM c
UNION ALL SELECT pattern_id, i, j, {score} AS h, f FROM (SELECT *, max(t + j * {ext}) OVER (PARTITION BY pattern_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {open} - (j - 1) * {ext} AS e
FROM (SELECT pattern_id, i, j, f, {cell} AS t FROM (SELECT m.pattern_id, m.i + 1 AS i, m.j, {down} AS f,
coalesce(lag(m.h) OVER (PARTITION BY m.pattern_id ORDER BY m.j), 0) + CASE WHEN substring(c.pattern, c.j::INT, 1) = substring(c.text, m.i + 1, 1) THEN {match} ELSE {mismatch} END AS d
FROM m JOIN c ON c.pattern_id = m.pattern_id AND c.j = m.j WHERE m.i < length(c.text)))))"""


def _rows(first: str, cell: str, score: str, down: str, open_: int, ext: int, match: int, mismatch: int) -> str:
    return _ROWS.format(consecutive=_CONSECUTIVE, first=first, cell=cell, score=score, down=down, open=open_, ext=ext, match=match, mismatch=mismatch)


@query(_rows("0", "greatest(d, f, 0)", "greatest(t, coalesce(e, -1), -j, 0)", "m.h - 1", 1, 1, 2, -1) + """
SELECT pattern_id, text_id, coalesce(max(h), 0)::INT AS score FROM p LEFT JOIN m USING (pattern_id) GROUP BY ALL""")
def align_smith_waterman(spark, sf_dir):
    """Best local scores: match 2, mismatch and gaps -1."""
    return alignment.align(_pairs(spark, sf_dir), kernels.smith_waterman(2, -1, -1, -1), "local").select("pattern_id", "text_id", "score")


@query(_rows("-8 - (j - 1) * 3", "greatest(d, f)", "greatest(t, coalesce(e, -1000000), -8 - (j - 1) * 3)", "greatest(m.h - 8, m.f - 3)", 8, 3, 0, -5) + """
SELECT pattern_id, text_id, CASE WHEN pattern = '' THEN 0 WHEN text = '' THEN -8 - (length(pattern) - 1) * 3 ELSE max(h) END::INT AS score FROM p LEFT JOIN (SELECT m.* FROM m JOIN p1 ON p1.pattern_id = m.pattern_id AND m.j = length(p1.pattern)) USING (pattern_id) GROUP BY pattern_id, text_id, pattern, text""")
def align_gotoh(spark, sf_dir):
    """Best scores of whole patterns within texts, with affine gaps."""
    return alignment.align(_pairs(spark, sf_dir), kernels.gotoh(0, -5, -8, -3), "semi").select("pattern_id", "text_id", "score")


@query()
def align_traces(spark, sf_dir):
    """Local alignments with CIGAR, MD and number of edits."""
    return alignment.align(_pairs(spark, sf_dir), kernels.smith_waterman(2, -1, -1, -1), "local", trace=True)


@query()
def align_banded(spark, sf_dir):
    return alignment.align(_pairs(spark, sf_dir), kernels.EDIT, "semi", band=31)


def _mapping(spark, sf_dir):
    reads = _bench(spark, sf_dir).select(F.col("string_id").alias("read_id"), "seq")
    return reads, sequences(spark, sf_dir).select(F.col("string_id").alias("ref_id"), "seq")


@query()
def all_mapper(spark, sf_dir):
    """Each read's best banded score over all diagonals and both strands."""
    reads, ref = _mapping(spark, sf_dir)
    return mapper.best_scores(mapper.scored(mapper.windows(mapper.candidates(reads, ref), reads, ref)))


@query()
def read_mapper(spark, sf_dir):
    reads, ref = _mapping(spark, sf_dir)
    return mapper.map_reads(reads, ref)


_STRANDS = f"{BENCH}, strands AS (SELECT string_id, false AS rc, seq FROM bench UNION ALL SELECT string_id, true, reverse(translate(seq, 'ACGT', 'TGCA')) FROM bench)"


@query(f"""WITH {SEQS}, {_STRANDS}, q AS (SELECT string_id AS read_id, rc, pos::INT AS "begin", substring(seq, (pos + 1)::INT, 22) AS seed FROM (SELECT string_id, rc, seq, unnest(range(0, length(seq) - 21, 11)) AS pos FROM strands WHERE length(seq) >= 22)),
{grams_sql("r", "seqs", 22, 1)}, halves AS (SELECT *, 0 AS half, "left"(gram, 11) AS key FROM r UNION ALL SELECT *, 1, "right"(gram, 11) FROM r)
SELECT DISTINCT read_id, rc, "begin", string_id AS ref_id, pos, hamming(seed, gram)::INT AS mismatches FROM q JOIN halves h ON (half = 0 AND "left"(seed, 11) = key OR half = 1 AND "right"(seed, 11) = key) WHERE hamming(seed, gram) <= 1""")
def approximate_seeds(spark, sf_dir):
    reads, ref = _mapping(spark, sf_dir)
    return mapper.approximate_seeds(reads, ref, 22, 11)


@query(f"""WITH {SEQS}, {BENCH}, {grams_sql("a", "seqs", 12, 1)}, {grams_sql("r", "bench", 12, 1)},
h AS (SELECT a.string_id, a.pos, r.string_id AS ref_id, r.pos - a.pos AS diag FROM a JOIN r USING (gram)),
i AS (SELECT *, max(pos) OVER (PARTITION BY string_id, ref_id, diag, island) + 12 AS "end" FROM (SELECT *, pos - row_number() OVER (PARTITION BY string_id, ref_id, diag ORDER BY pos) AS island FROM h)),
l AS (SELECT string_id, pos, "end", count(*) AS n, row_number() OVER (PARTITION BY string_id, pos ORDER BY "end" DESC) AS k FROM i GROUP BY string_id, pos, "end")
SELECT x.string_id AS pattern_id, x.pos AS "begin", x."end"::INT AS "end", x.n FROM l x LEFT JOIN l y ON y.string_id = x.string_id AND y.pos = x.pos - 1 AND y.k = 1 WHERE x.k = 1 AND (y.pos IS NULL OR y."end" < x."end")""")
def maximal_matches(spark, sf_dir):
    """Stretches of each document's sequence that occur in the benchmark's sequences, 12 symbols or more, and that no longer one holds."""
    patterns = sequences(spark, sf_dir).select(F.col("string_id").alias("pattern_id"), F.col("seq").alias("pattern"))
    return fulltext.maximal_matches(patterns, _bench(spark, sf_dir).select(F.col("string_id").alias("ref_id"), "seq"), 12)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey <= l_suppkey THEN 1 ELSE -1 END * (greatest(l_partkey + 50, l_suppkey + l_linenumber * 10) - least(l_partkey, l_suppkey))::BIGINT AS tlen FROM lineitem")
def template_lengths(spark, sf_dir):
    pos, mate = F.col("l_partkey"), F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mapper.template_length(pos, pos + 50, mate, mate + F.col("l_linenumber") * 10).cast("long").alias("tlen"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity::INT || 'M' || l_linenumber || 'I3M' || (l_discount * 100 + 1)::INT || 'D5M' AS cigar FROM lineitem)
SELECT l_orderkey, l_linenumber, (l_quantity::INT + 8 + (l_discount * 100 + 1)::INT)::INT AS on_reference, (l_quantity::INT + 8 + l_linenumber)::INT AS on_read, 2 AS opened, (l_linenumber - 1 + (l_discount * 100)::INT)::INT AS extended FROM lineitem""")
def cigar_lengths(spark, sf_dir):
    """Lengths on reference and read, gap openings and extensions, of CIGAR strings."""
    cigar = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"), F.col("l_linenumber").cast("string"), F.lit("I3M"), F.round(F.col("l_discount") * 100 + 1).cast("int").cast("string"), F.lit("D5M"))
    opened, extended = alignment.gap_counts(F.col("cigar"))
    rows = read(spark, sf_dir, "lineitem").withColumn("cigar", cigar)
    return rows.select("l_orderkey", "l_linenumber", alignment.reference_length(F.col("cigar")).alias("on_reference"), alignment.read_length(F.col("cigar")).alias("on_read"), opened.alias("opened"), extended.alias("extended"))


_TINY = 1000  # symbols of distance that mates may lie apart


@query("""WITH a AS (SELECT l_orderkey AS read_id, l_suppkey % 7 AS ref_id, l_partkey AS pos, l_returnflag = 'R' AS rc, -l_quantity::INT AS score, l_linenumber FROM lineitem)
SELECT x.read_id, x.ref_id, x.pos, y.pos AS o_pos, x.rc, (greatest(x.pos, y.pos) + 50 - least(x.pos, y.pos))::BIGINT AS fragment, x.score + y.score AS pair_score FROM a x JOIN a y ON y.read_id = x.read_id AND y.ref_id = x.ref_id AND x.l_linenumber = 1 AND y.l_linenumber = 2
WHERE x.rc <> y.rc AND CASE WHEN NOT x.rc THEN y.pos >= x.pos AND y.pos + 50 <= x.pos + 1000 ELSE y.pos >= greatest(x.pos + 50 - 1000, 0) AND y.pos <= x.pos END
AND greatest(x.pos, y.pos) + 50 - least(x.pos, y.pos) BETWEEN 60 AND 1000""")
def mate_pairs(spark, sf_dir):
    """Pairs of mates' alignments that face each other within a distance."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), (F.col("l_suppkey") % 7).alias("ref_id"), F.col("l_partkey").alias("pos"), (F.col("l_partkey") + 50).alias("end"), (F.col("l_returnflag") == "R").alias("rc"),
        (-F.col("l_quantity")).cast("int").alias("score"), "l_linenumber",
    )
    found = mapper.pairs(rows.filter("l_linenumber = 1").drop("l_linenumber"), rows.filter("l_linenumber = 2").drop("l_linenumber"), 60, _TINY)
    return found.select("read_id", "ref_id", "pos", "o_pos", "rc", F.col("fragment").cast("long").alias("fragment"), "pair_score")


def _steps(value: str, tiers: list, result) -> str:
    """The CASE expression of (least share, result) tiers."""
    whens = [f"WHEN {value} > 0 THEN {result(x)}" if least == 0 else f"WHEN {value} >= span * {least}::FLOAT THEN {result(x)}" for least, x in tiers if least is not None]
    last = [result(x) for least, x in tiers if least is None]
    return f"(CASE {' '.join(whens)} ELSE {last[0]} END)" if whens else last[0]


def _v2(one: list, two: list) -> str:
    return f"CASE WHEN best < low THEN 0 WHEN second IS NULL THEN {_steps('over', one, str)} ELSE {_steps('gap', two, lambda x: _steps('over', x, str))} END"


_RANGE = "*, (top - low)::FLOAT AS span, (best - low)::FLOAT AS over, abs(abs(best) - abs(second))::FLOAT AS gap"
_BIN = "least(trunc({}::FLOAT * (10::FLOAT / span) + 0.5::FLOAT)::INT, 10)"
_SCORES = """s AS (SELECT l_orderkey, l_linenumber, (100 + l_linenumber * 10)::INT AS n, -l_quantity::INT AS best,
CASE WHEN l_returnflag <> 'N' THEN (-l_quantity - floor(l_discount * 100))::INT END AS second FROM lineitem)"""


@query(f"""WITH {_SCORES}, e AS MATERIALIZED (SELECT {_RANGE} FROM (SELECT *, 0 AS top, trunc(-0.6::FLOAT + -0.6::FLOAT * n::FLOAT)::INT AS low FROM s)),
bins AS MATERIALIZED (SELECT *, {_BIN.format('(-best)')} AS lost, {_BIN.format('(best - second)')} AS apart FROM e),
ends AS MATERIALIZED (SELECT l_orderkey, l_linenumber, n, best AS b, second AS s2, ({_v2(mq.ONE_GLOBAL, mq.TWO_GLOBAL)})::INT AS v2, (CASE WHEN best < low THEN 0 WHEN second IS NULL AND best >= 0 THEN {mq.V3_ONE_PERFECT}
WHEN second IS NULL THEN list_extract({mq.V3_ONE}, lost + 1) WHEN best >= 0 THEN list_extract({mq.V3_TWO_PERFECT}, lost + 1) ELSE list_extract({[x for row in mq.V3_TWO for x in row]}, apart * 11 + lost + 1) END)::INT AS v3 FROM bins),
l AS MATERIALIZED (SELECT {_RANGE} FROM (SELECT *, n * 2 AS top, n * 2 + b AS best, n * 2 + s2 AS second, trunc(10::FLOAT * ln(n)::FLOAT)::INT AS low FROM ends))
SELECT l_orderkey, l_linenumber, v2, v3, ({_v2(mq.ONE_LOCAL, mq.TWO_LOCAL)})::INT AS local FROM l""")
def mapping_quality(spark, sf_dir):
    """Both calculators end to end, and the first in local mode."""
    r = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (100 + F.col("l_linenumber") * 10).alias("n"), (-F.col("l_quantity")).cast("int").alias("best"),
        F.when(F.col("l_returnflag") != "N", (-F.col("l_quantity") - F.floor(F.col("l_discount") * 100)).cast("int")).alias("second"),
    )
    args = F.col("best"), F.col("second"), F.col("n")
    return r.select("l_orderkey", "l_linenumber", mq.mapq(mq.END_TO_END, *args).alias("v2"), mq.mapq_v3(mq.END_TO_END, *args).alias("v3"), mq.mapq(mq.LOCAL, F.col("n") * 2 + F.col("best"), F.col("n") * 2 + F.col("second"), F.col("n")).alias("local"))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity < 5 THEN 4 ELSE 0 END + CASE WHEN l_quantity >= 5 AND l_returnflag = 'R' THEN 16 ELSE 0 END + 1 + CASE WHEN l_linenumber % 2 = 0 THEN 64 ELSE 128 END
+ CASE WHEN l_quantity >= 10 AND l_linestatus = 'O' THEN 32 ELSE 0 END + CASE WHEN l_quantity < 10 THEN 8 ELSE 0 END + CASE WHEN l_tax < 0.05 THEN 2 ELSE 0 END)::INT AS flags FROM lineitem""")
def sam_flags(spark, sf_dir):
    q = F.col("l_quantity")
    flags = mapper.sam_flags(q >= 5, F.col("l_returnflag") == "R", F.col("l_linenumber") % 2, q >= 10, F.col("l_linestatus") == "O", F.col("l_tax") < 0.05)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flags.alias("flags"))
