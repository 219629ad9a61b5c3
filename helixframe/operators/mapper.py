"""Read mapping: seeds, diagonals, banded scores, best and second best, tracebacks, qualities.

reads: read_id, seq (and qualities are optional). reference: ref_id, seq. Every step is a
DataFrame program; only the dynamic programming runs in Python, on Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixframe.functions import codecs, kernels, mapq as mq

from . import alignment, joins, primitives, qgram, seeds


@dataclass(frozen=True)
class Mapper:
    q: int = 20
    read_interval: int = 10
    ref_interval: int = 1
    snap: int = 16
    band: int = 31
    min_score: int = -20
    scheme: kernels.Scheme = kernels.EDIT
    mode: str = "semi"
    scoring: mq.Scoring = mq.END_TO_END


def both_strands(reads: DataFrame) -> DataFrame:
    """read_id, rc, seq: each read and its reverse complement."""
    strands = F.array(F.struct(F.lit(False).alias("rc"), F.col("seq").alias("s")), F.struct(F.lit(True).alias("rc"), codecs.reverse_complement(F.col("seq")).alias("s")))
    return reads.select("read_id", F.inline(strands)).withColumnRenamed("s", "seq")


def candidates(reads: DataFrame, reference: DataFrame, p: Mapper = Mapper()) -> DataFrame:
    """read_id, rc, ref_id, diag, n_hits: diagonals with seed hits."""
    strands = both_strands(reads).withColumn("string_id", F.struct("read_id", "rc"))
    queries = seeds.without_ambiguity(seeds.qgrams(strands.select("string_id", "seq"), p.q, p.read_interval))
    index = seeds.without_ambiguity(seeds.qgrams(reference.select(F.col("ref_id").alias("string_id"), "seq"), p.q, p.ref_interval))
    d = qgram.diagonals(qgram.hits(index, joins.small_side(queries)), p.snap)
    return d.select("query_id.read_id", "query_id.rc", F.col("string_id").alias("ref_id"), "diag", "n_hits")


CELL = 1024  #: symbols of a piece of the reference


def windows(found: DataFrame, reads: DataFrame, reference: DataFrame, p: Mapper = Mapper()) -> DataFrame:
    """Candidates with pattern (the read on its strand), begin and text (the reference window of each).

    Windows meet the reference by pieces of it, so that no row carries a whole sequence.
    """
    begin = F.greatest(F.col("diag") - p.band // 2, F.lit(0)).cast("int")
    rows = found.join(both_strands(reads).withColumnRenamed("seq", "pattern"), ["read_id", "rc"]).withColumn("begin", begin)
    end = (F.col("begin") + F.length("pattern") + p.band - 1) / CELL  # the window's last symbol, if the reference reaches so far
    touched = rows.select("*", F.explode(F.sequence(F.floor(F.col("begin") / CELL), F.floor(end))).alias("cell"))
    pieces = seeds.stretches(reference.select(F.col("ref_id").alias("string_id"), "seq"), CELL).select(F.col("string_id").alias("ref_id"), F.floor(F.col("begin") / CELL).alias("cell"), "stretch")
    met = touched.join(pieces, ["ref_id", "cell"])
    joined = met.groupBy("read_id", "rc", "ref_id", "diag", "n_hits", "pattern", "begin").agg(F.array_sort(F.collect_list(F.struct("cell", "stretch"))).alias("_p"))  # the pieces of one window
    inside = F.col("begin") - F.element_at("_p", 1)["cell"] * CELL
    text = F.substring(F.array_join("_p.stretch", ""), (inside + 1).cast("int"), F.length("pattern") + p.band)
    return joined.withColumn("text", text).drop("_p")


def scored(rows: DataFrame, p: Mapper = Mapper(), trace: bool = False) -> DataFrame:
    keep = ("read_id", "rc", "ref_id", "diag", "n_hits", "begin", *(["pattern", "text"] if trace else []))
    out = alignment.align(rows, p.scheme, p.mode, p.band, trace, keep)
    return out.filter(F.col("score") >= p.min_score).withColumn("sink", F.col("begin") + F.col("text_end"))


def best_scores(scores: DataFrame) -> DataFrame:
    """read_id and its best score over both strands and all diagonals."""
    return scores.groupBy("read_id").agg(F.max("score").alias("score"))


def best_two(scores: DataFrame, distance: int = 16) -> DataFrame:
    """The best row of each read (ties: smaller reference, place, forward strand) with sec_score: the best on another reference or strand, or further off than ``distance``."""
    cols = ["ref_id", "rc", "diag", "begin", "sink", "score"]
    first = F.first(F.struct(*cols)).over(Window.partitionBy("read_id").orderBy(F.desc("score"), "ref_id", "sink", "rc"))
    # scores are made once: one pass finds the best, and what is far enough from it
    rows = scores.select("read_id", *cols).withColumn("_b", first)
    far = (F.col("ref_id") != F.col("_b.ref_id")) | (F.col("rc") != F.col("_b.rc")) | (F.abs(F.col("sink") - F.col("_b.sink")) > distance)
    return rows.groupBy("read_id").agg(F.max("_b").alias("_b"), F.max(F.when(far, F.col("score"))).alias("sec_score")).select("read_id", "_b.*", "sec_score")


def map_reads(reads: DataFrame, reference: DataFrame, p: Mapper = Mapper()) -> DataFrame:
    """The best alignment of each read that has one: read_id, ref_id, pos, rc, score, sec_score, cigar, its tags (nm, md, and the numbers of mismatches xm, gap openings xo and gap extensions xg), and its quality (mapq)."""
    best = best_two(scored(windows(candidates(reads, reference, p), reads, reference, p), p))
    # the traceback is made for the chosen rows alone
    chosen = windows(best.select("read_id", "rc", "ref_id", "diag", F.lit(0).alias("n_hits")), reads, reference, p)
    traced = scored(chosen, p, trace=True).select("read_id", "cigar", "text_begin", "pattern", "nm", "md")
    out = best.join(traced, "read_id")
    opened, extended = alignment.gap_counts(F.col("cigar"))
    return out.select(
        "read_id", "ref_id", (F.col("begin") + F.col("text_begin")).cast("long").alias("pos"), "rc", "score", "sec_score", "cigar", "nm", "md",
        (F.col("nm") - opened - extended).alias("xm"), opened.alias("xo"), extended.alias("xg"),
        mq.mapq(p.scoring, F.col("score"), F.col("sec_score"), F.length("pattern")).alias("mapq"),
    )


def exact_hits(reads: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """read_id, rc, ref_id, pos of whole-read matches of reads of one size."""
    grams = seeds.qgrams(reference.select(F.col("ref_id").alias("string_id"), "seq"), size)
    return grams.join(joins.small_side(both_strands(reads)), F.col("seq") == F.col("gram")).select("read_id", "rc", F.col("string_id").alias("ref_id"), "pos")


def approximate_seeds(reads: DataFrame, reference: DataFrame, size: int, interval: int) -> DataFrame:
    """read_id, rc, begin, ref_id, pos, mismatches: seeds that match with at most one mismatch.

    One half of the seed is exact, so the halves are the join keys.
    """
    half = size // 2
    strands = both_strands(reads).withColumn("string_id", F.struct("read_id", "rc"))
    q = seeds.qgrams(strands.select("string_id", "seq"), size, interval).select("string_id", F.col("pos").alias("begin"), F.col("gram").alias("seed"))
    r = seeds.qgrams(reference.select(F.col("ref_id").alias("string_id"), "seq"), size).select(F.col("string_id").alias("ref_id"), "pos", "gram")
    halves = lambda c: F.array(F.struct(F.lit(0).alias("half"), F.substring(c, 1, half).alias("key")), F.struct(F.lit(1).alias("half"), F.substring(c, half + 1, size - half).alias("key")))
    a = q.select("*", F.inline(halves("seed")))
    b = r.select("*", F.inline(halves("gram")))
    pairs = b.join(joins.small_side(a), ["half", "key"]).withColumn("mismatches", joins.hamming(F.col("seed"), F.col("gram"))).filter("mismatches <= 1")
    return pairs.filter("mismatches = 1 or half = 0").select("string_id.read_id", "string_id.rc", "begin", "ref_id", "pos", "mismatches")


def select_seed_hits(hits: DataFrame, most: int = 100) -> DataFrame:
    """The seed hits of each read whose grams are rarest, up to ``most`` (a top-k by design)."""
    w = Window.partitionBy("read_id").orderBy("range_size", "begin")
    return hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def mate_windows(anchor: DataFrame, least: int, most: int, policy: str = "fr") -> DataFrame:
    """lo, hi and the strand (other_rc) in which the opposite mate of each anchor alignment (pos, end, rc) may lie."""
    flip = policy in ("fr", "rf")
    ahead = {"fr": ~F.col("rc"), "rf": F.col("rc"), "ff": ~F.col("rc"), "rr": F.col("rc")}[policy]
    lo = F.when(ahead, F.col("pos")).otherwise(F.greatest(F.col("end") - most, F.lit(0)))
    hi = F.when(ahead, F.col("pos") + most).otherwise(F.col("end"))
    return anchor.withColumn("lo", lo).withColumn("hi", hi).withColumn("least", F.lit(least)).withColumn("other_rc", F.col("rc") != F.lit(flip))


def pairs(anchor: DataFrame, opposite: DataFrame, least: int, most: int, policy: str = "fr") -> DataFrame:
    """Pairs of mates' alignments that lie as the policy says, with their fragment length and summed score."""
    a = mate_windows(anchor, least, most, policy)
    o = opposite.select("read_id", "ref_id", F.col("pos").alias("o_pos"), F.col("end").alias("o_end"), F.col("rc").alias("o_rc"), F.col("score").alias("o_score"))
    rows = a.join(o, ["read_id", "ref_id"]).filter((F.col("o_rc") == F.col("other_rc")) & (F.col("o_pos") >= F.col("lo")) & (F.col("o_end") <= F.col("hi")))
    length = F.greatest("end", "o_end") - F.least("pos", "o_pos")
    return rows.withColumn("fragment", length).filter(F.col("fragment").between(least, most)).withColumn("pair_score", F.col("score") + F.col("o_score"))


# SAM flag bits (fixed values of the format)
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY = 1, 2, 4, 8, 16, 32, 64, 128, 256


def sam_flags(mapped: Column, rc: Column, mate: Column | None = None, mate_mapped: Column | None = None, mate_rc: Column | None = None, proper: Column | None = None) -> Column:
    """SAM flags; with a mate (0 or 1), of a pair."""
    bit = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    out = bit(~mapped, UNMAPPED) + bit(mapped & rc, REVERSE)
    if mate is not None:
        out = out + PAIRED + F.when(mate == 0, FIRST).otherwise(SECOND) + bit(~mate_mapped, MATE_UNMAPPED) + bit(mate_mapped & mate_rc, MATE_REVERSE) + bit(proper, PROPER)
    return out.cast("int")


def template_length(pos: Column, end: Column, mate_pos: Column, mate_end: Column) -> Column:
    """TLEN: the fragment's length, positive for its leftmost mate, negative for the other (equal places: the first counts as leftmost)."""
    length = F.greatest(end, mate_end) - F.least(pos, mate_pos)
    return F.when(pos <= mate_pos, length).otherwise(-length)


def map_exact(reads: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """read_id, ref_id, pos, rc, n: each read's first exact match, and how many it has (reads of one size)."""
    hits = exact_hits(reads, reference, size)
    n = hits.groupBy("read_id").agg(F.count("*").alias("n"), F.min(F.struct("ref_id", "pos", "rc")).alias("_h"))
    return n.select("read_id", "_h.ref_id", "_h.pos", "_h.rc", "n")


def map_all(reads: DataFrame, reference: DataFrame, p: Mapper = Mapper()) -> DataFrame:
    """read_id, ref_id, rc, pos, score, cigar of every distinct alignment of each read above the minimum score."""
    rows = windows(candidates(reads, reference, p), reads, reference, p)
    found = scored(rows, p, trace=True).withColumn("pos", (F.col("begin") + F.col("text_begin")).cast("long"))
    # neighbouring diagonals give one alignment: its end and strand name it
    return found.groupBy("read_id", "ref_id", "rc", "sink").agg(F.max_by(F.struct("pos", "score", "cigar"), F.struct("score", "pos")).alias("_b")).select("read_id", "ref_id", "rc", "_b.*")


def map_pairs(mate1: DataFrame, mate2: DataFrame, reference: DataFrame, least: int = 0, most: int = 500, policy: str = "fr", p: Mapper = Mapper()) -> DataFrame:
    """The best pair of alignments of each pair of reads (read_id in both), its fragment length, summed and second-best score, and quality.

    All alignments of both mates are paired as the policy says; ties go to the smaller place.
    """
    one, two = (map_all(m, reference, p).withColumn("end", F.col("pos") + alignment.reference_length(F.col("cigar"))) for m in (mate1, mate2))
    found = pairs(one, two, least, most, policy)
    order = F.struct("pair_score", -F.col("ref_id"), -F.col("pos"), -F.col("o_pos"))
    best = primitives.best(found, ["read_id"], order, ["ref_id", "pos", "end", "rc", "score", "cigar", "o_pos", "o_end", "o_rc", "o_score", "fragment", "pair_score"])
    place = best.select("read_id", F.struct("ref_id", "pos", "o_pos").alias("_at"))
    second = found.join(place, "read_id").filter(F.struct("ref_id", "pos", "o_pos") != F.col("_at")).groupBy("read_id").agg(F.max("pair_score").alias("sec_score"))
    sizes = mate1.select("read_id", F.length("seq").alias("_n1")).join(mate2.select("read_id", F.length("seq").alias("_n2")), "read_id")
    out = best.join(second, "read_id", "left").join(sizes, "read_id")
    return out.withColumn("mapq", mq.mapq(p.scoring, F.col("pair_score"), F.col("sec_score"), F.col("_n1"), F.col("_n2"))).drop("_n1", "_n2")
