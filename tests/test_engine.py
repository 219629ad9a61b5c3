"""Kernels, files, mapping and streams: goldens, brute force and invariants."""

import os
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import bloom, codecs, kernels, mapq, numbers
from helixframe.operators import alignment, fulltext, mapper, seeds, suffix
from helixframe.sources import readers, writers
from helixframe.streaming import sequences as streams

PATTERN, TEXT = "ACAACTA", "AAACACCCTAACACACTAAA"
LONG_P = "TTATGTAGGTGGTCTGGTTTTTGCCTTTTAAGCTTCTGCAAAAAACAACAACAAACTTGTGGTATTACACTGACTCTACAGATCAATTTGGGGACAACTTCCATGTGTTCCACCACCAATACTGAATCTTTCAATCGACTGACGTGGTAT"
LONG_T = "ATCGGATTCTTTCTTACTTGTAGGTGGTCTGGTTTTTGCCTTTTAAGCTTCTGCAAAAAACAACAACAAACTTGTGGTATTACACTGACTCTACAGATCAATTTGGGGACAACTTCCATGTGTTCCACCACCAATACTGAATCTTTCAATCGACTGACGTGGTATCTCTCTCTCCATCTAT"
FULL_P = "TAGGAGGTAACATGTATGGAGCATTTACCATAGGCCAAGCACTGTTCTAAGAACTTCGGACATGTTATCTCACTTGTATAAGTACTTAGGTGCCTACAACATAAGCAGCACCTGGTAAATTAAGTATTGAAAAAATGCAGATCG"
FULL_T = "CAGCACTGACCGGTGAGCATAAACCCTGGGGATGCCCAGAGCTGGTACAGCCAGGAGCTCCAGAAGCGTGGGATTCTCAGAGGGAAGTGGAGCTCACTGCTCTACAGGTCCTATTCAAGTTAGAAAGTAAGATACAATGCACACAAAGCCAAATTGTCATCATTCAGCTCCTATTACAGGGGAACTAAGAGCTGCATTGAAAATTATTTGCAAAGCTTGTAAGTGGTTCTGCCACTTATTAGCCGTGTGAACCTTAGCAAATTACCTAGCGTCTCTGAGTTTCAACTTCCTCATCTACAAAATAGAAATGATAATAATAACCGCATCGCAAGAGTTGTTGGAAAAATGAAAATGAGGTATCATAGGAGGTAACATGTATGGAGCATTTACCATAGGCCAAGCACTGTTCTAAGAACTTCGGACATGTTATCTCACTTGTATAAGTACTTAGGTGCCTACAACATAAACAGCACCTGGTAAATTAAGTATTGAAAAAATGC"


@pytest.mark.parametrize(("text", "pattern", "score"), [
    ("AAAAGGGTGCTCAA", "GGGTGCTCAA", 0), ("AAAAGGGTGCTCAA", "GGGTAAGCTC", -2), ("AAAAGGGTGCAATC", "AAGGGTGCTC", -2),
    ("AAAAGGGTGCTCAA", "AAAAGGGTGC", 0), ("AAAAGGAAGTGCTC", "AAAAGGGTG", -2), ("AACAGGGTGCTC", "CACCGGGT", -2),
])
def test_banded_edit_distance(text, pattern, score):
    assert kernels.align([pattern], [text], kernels.EDIT, "semi", 5)[0]["score"] == score


@pytest.mark.parametrize(("scheme", "mode", "band", "p", "t", "cigar", "score"), [
    (kernels.smith_waterman(2, -1, -1, -1), "global", None, PATTERN, TEXT, "10D3M1D3M2D1M", 1),
    (kernels.smith_waterman(2, -1, -1, -1), "local", None, PATTERN, TEXT, "3M1D4M", 13),
    (kernels.smith_waterman(2, -1, -1, -1), "semi", None, PATTERN, TEXT, "3M1D4M", 13),
    (kernels.gotoh(2, -1, -1, -1), "global", None, PATTERN, TEXT, "10D3M1D3M2D1M", 1),
    (kernels.gotoh(2, -1, -1, -1), "local", None, PATTERN, TEXT, "3M1D4M", 13),
    (kernels.gotoh(2, -1, -1, -1), "semi", None, PATTERN, TEXT, "3M1D4M", 13),
    (kernels.gotoh(2, -1, -1, -1), "semi", 7, PATTERN, TEXT, "3M1D4M", 10),
    (kernels.gotoh(0, -5, -8, -3), "semi", 31, LONG_P, LONG_T, "3M2D147M", -11),
    (kernels.gotoh(0, -5, -8, -3), "semi", None, FULL_P, FULL_T, "138M6I", -28),
    (kernels.EDIT, "semi", None, FULL_P, FULL_T, "136M3I1M2I1M1I", -7),
])
def test_tracebacks(scheme, mode, band, p, t, cigar, score):
    got = kernels.align([p], [t], scheme, mode, band, trace=True)[0]
    assert (got["cigar"], got["score"]) == (cigar, score) and kernels.rescore(p, t, got, scheme) == score


def naive(p, t, s, mode):
    """Plain cell-by-cell scores."""
    far = float("-inf")
    gap = lambda k, one: 0 if k == 0 else s.gap_open + (k - 1) * s.gap_ext if s.affine else k * one
    h = [[0 if mode == "local" else (0 if mode == "semi" else gap(i, s.deletion)) if j == 0 else gap(j, s.insertion) if i == 0 else None for j in range(len(p) + 1)] for i in range(len(t) + 1)]
    e, f = [[far] * (len(p) + 1) for _ in h], [[far] * (len(p) + 1) for _ in h]
    for i in range(1, len(t) + 1):
        for j in range(1, len(p) + 1):
            if s.affine:
                e[i][j], f[i][j] = max(e[i][j - 1] + s.gap_ext, h[i][j - 1] + s.gap_open), max(f[i - 1][j] + s.gap_ext, h[i - 1][j] + s.gap_open)
            else:
                e[i][j], f[i][j] = h[i][j - 1] + s.insertion, h[i - 1][j] + s.deletion
            h[i][j] = max(h[i - 1][j - 1] + (s.match if p[j - 1] == t[i - 1] else s.mismatch), e[i][j], f[i][j], 0 if mode == "local" else far)
    return h[-1][-1] if mode == "global" else max(r[-1] for r in h) if mode == "semi" else max(map(max, h))


@pytest.mark.parametrize("mode", ["global", "semi", "local"])
@pytest.mark.parametrize("scheme", [kernels.EDIT, kernels.smith_waterman(2, -3, -2, -4), kernels.gotoh(2, -2, -5, -1)])
def test_scores_against_naive(scheme, mode):
    rng = random.Random(3)
    ps, ts = (["".join(rng.choice("ACG") for _ in range(rng.randint(0, n))) for _ in range(60)] for n in (9, 14))
    got = kernels.align(ps, ts, scheme, mode, trace=True)
    for p, t, r in zip(ps, ts, got):
        assert r["score"] == naive(p, t, scheme, mode) == kernels.rescore(p, t, r, scheme), (p, t, r)


def test_myers_and_gaps():
    rng = random.Random(4)
    for _ in range(200):
        p, t = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert kernels.myers(p, t) == -naive(p, t, kernels.EDIT, "global") and kernels.myers(p, t, "semi") == -naive(p, t, kernels.EDIT, "semi")
    assert [kernels.band_length(d) for d in (1, 3, 7, 15, 16)] == [3, 7, 15, 31, 63]
    assert kernels.max_gaps(kernels.EDIT, 50, -5, "deletion") == 5 and kernels.max_gaps(kernels.gotoh(0, -5, -8, -3), 100, -20, "deletion") == 5


def test_align_operator_and_cigars(spark):
    df = spark.createDataFrame([(1, 2, PATTERN, TEXT), (3, 4, None, "A"), (5, 6, "", "")], "pattern_id long, text_id long, pattern string, text string")
    got = {r.pattern_id: r for r in alignment.align(df, kernels.gotoh(2, -1, -1, -1), "semi", trace=True).collect()}
    assert got[1].cigar == "3M1D4M" and got[3].score is None and got[5].score == 0
    c = F.lit("2S10M1I3D4M")
    opens, ext = alignment.gap_counts(c)
    r = spark.range(1).select(alignment.reference_length(c).alias("a"), alignment.read_length(c).alias("b"), opens.alias("c"), ext.alias("d")).first()
    assert tuple(r) == (17, 17, 2, 2)
    t = kernels.align(["ACGTTACG"], ["ACGAATTCCG"], kernels.smith_waterman(2, -1, -1, -1), "global", trace=True)[0]
    assert alignment.md_string("ACGTACGT", "ACGTTTACCT", {"text_begin": 0, "pattern_begin": 0, "cigar": "4M2D4M"}) == "4^TT2C1" and t["score"] > 0


def test_codecs(spark):
    df = spark.createDataFrame([("ACGTN",), ("",)], "s string")
    r = df.select(codecs.to_codes(F.col("s")).alias("c"), codecs.reverse_complement(F.col("s")).alias("rc"), codecs.from_digits(codecs.to_digits(F.col("s"))).alias("b"), codecs.dna_to_iupac16(codecs.to_codes(F.col("s"))).alias("i")).first()
    assert r.c == [0, 1, 2, 3, 4] and r.rc == "NACGT" and r.b == "ACGTN" and r.i == [1, 2, 4, 8, 15]
    assert spark.range(1).select(codecs.qgram_code(F.lit("CAT")).alias("x")).first().x == 1 + 0 * 4 + 3 * 16
    assert [r.x for r in spark.createDataFrame([(-9,), (-8,), (7,), (8,), (9,)], "v long").select(numbers.snap(F.col("v"), 16).alias("x")).collect()] == [-16, -16, 0, 0, 16]


def test_custom_seeds(spark):
    df = spark.createDataFrame([(1, "ACGTACGT")], "string_id long, seq string")
    halves = lambda n: F.array(F.struct(F.lit(0).alias("begin"), (n / 2).cast("int").alias("end")), F.struct((n / 2).cast("int").alias("begin"), n.alias("end")))
    got = seeds.extract(df, seeds.custom_seeds(df, halves)).orderBy("begin").collect()
    assert [r.infix for r in got] == ["ACGT", "ACGT"] and seeds.seeds(df, 9).count() == 0 and seeds.seeds(df, 8, 100).count() == 1


def test_bloom(spark):
    keys, rows = spark.range(0, 100), spark.range(0, 5000)
    for bits in (1 << 11, 1 << 14):
        got = {r.id for r in bloom.contains(rows, "id", bloom.build(keys, "id", bits, 3), bits, 3).collect()}
        assert set(range(100)) <= got and len(got) < 400
    with pytest.raises(ValueError):
        bloom.places(F.lit(1), 1000, 2)


def test_suffix_order_and_bwt(spark):
    rng = random.Random(5)
    strings = {i: "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))) for i in range(12)}
    df = spark.createDataFrame(list(strings.items()), "string_id long, seq string")
    sa = suffix.suffix_array(df).orderBy("rank").collect()
    assert [(r.string_id, r.pos) for r in sa] == [x[1:] for x in sorted((s[k:], i, k) for i, s in strings.items() for k in range(len(s) + 1))]
    one = spark.createDataFrame([(0, strings[0] + "ACGTACGTACGT")], "string_id long, seq string")
    s = one.first().seq
    rows = suffix.suffix_array(one).orderBy("rank").collect()
    lf = {r.rank: r.lf for r in suffix.lf_mapping(suffix.suffix_array(one)).collect()}
    at, back = 0, ""
    while rows[at].bwt != "$":  # the inverse transform gives the string
        back, at = rows[at].bwt + back, lf[at]
    assert back == s
    sym = spark.createDataFrame(list(enumerate(s)), "pos long, symbol string")
    got = {r.pos: r["rank"] for r in suffix.prefix_doubling(sym).collect()}
    assert [p for p, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(len(s)), key=lambda k: s[k:])


def test_mems():
    rng = random.Random(6)
    ref = "".join(rng.choice("ACGT") for _ in range(300))
    index = fulltext.SuffixArray(ref)
    assert index.order == sorted(range(300), key=lambda k: ref[k:])
    p = ref[20:50] + "TTTTT" + ref[100:130] + "N" + ref[5:15]
    for a, b, n in fulltext.mems(index, p):
        s = p[a:b]
        assert n == sum(ref.startswith(s, k) for k in range(300)) >= 1
        assert (a == 0 or p[a - 1 : b] not in ref) and (b == len(p) or p[a : b + 1] not in ref)
    covered = {k for a, b, _ in fulltext.mems(index, p) for k in range(a, b)}
    assert covered == {k for k in range(len(p)) if p[k] != "N"}
    assert all(m[1] - m[0] >= 12 for m in fulltext.mems(index, p, min_span=12)) and fulltext.threshold_mems(index, p, 10)


def test_find_mems(spark):
    df = spark.createDataFrame([(1, "ACGTACGG"), (2, None)], "pattern_id long, pattern string")
    found = fulltext.find_mems(df, "TTACGTACTT", min_span=4)
    assert [(r.begin, r.end, r.n) for r in found.collect()] == [(0, 6, 1), (3, 7, 1)]
    assert sorted(r.pos for r in fulltext.locate_mems(found, df, "TTACGTACTT").collect()) == [1, 2]


# files


def test_fasta(spark, tmp_path):
    body = "".join(f">r{i} some words\n" + "ACGTN" * 3 + "\nacgt tt\n" for i in range(150))
    (tmp_path / "x.fasta").write_text(body)
    got = readers.fasta(spark, str(tmp_path / "x.fasta")).collect()
    assert sorted(r.name for r in got) == sorted(f"r{i}" for i in range(150)) and {r.seq for r in got} == {"ACGTN" * 3 + "acgttt"}
    s = readers.open_sequences(spark, str(tmp_path / "x.fasta"), ("forward", "reverse_complement"), max_len=8).collect()
    assert len(s) == 300 and {r.seq for r in s} == {"ACGTNACG", "CGTNACGT"} and {r.len for r in s} == {8} and s[0].quals == [255] * 8


def test_fastq(spark, tmp_path):
    import gzip

    good = "@a b\nACGT\nAC\n+\nIIIIII\n\n@c\nTTTT\n+c\n@@@\n"
    (tmp_path / "x.fastq").write_text(good)
    with gzip.open(tmp_path / "y.fastq.gz", "wt") as f:
        f.write(good)
    for name in ("x.fastq", "y.fastq.gz"):
        got = sorted(map(tuple, readers.fastq(spark, str(tmp_path / name)).collect()))
        assert got == [("a b", "ACGTAC", "IIIIII"), ("c", "TTT", "@@@")]
    for bad in ("x\nACGT\n+\nIIII\n", "@a\nACGT\n+\n"):
        with pytest.raises(ValueError):
            list(readers.parse_fastq(bad.encode()))
    assert list(readers.parse_fastq(b"junk\n@a\nAC\n+\nII\n@b\nAC", strict=False)) == [("a", "AC", "II")]


def test_txt_and_round_trips(spark, tmp_path):
    (tmp_path / "x.txt").write_text("ACGT\n\n  \nTT\n")
    assert sorted(r.seq for r in readers.txt(spark, str(tmp_path / "x.txt")).collect()) == ["ACGT", "TT"]
    rows = spark.createDataFrame([("a", "ACGT" * 40, "I" * 160), ("b", "TTT", "###")], "name string, seq string, quals string")
    writers.write_lines(writers.fasta_lines(rows, F.col("name"), F.col("seq")), str(tmp_path / "f"))
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "f")).collect())) == sorted((r.name, r.seq) for r in rows.collect())
    writers.write_lines(writers.fastq_lines(rows, F.col("name"), F.col("seq"), F.col("quals")), str(tmp_path / "q"), gz=True)
    assert sorted(map(tuple, readers.fastq(spark, str(tmp_path / "q")).collect())) == sorted(map(tuple, rows.collect()))


SAM = "@HD\tVN:1.3\tSO:coordinate\n@SQ\tSN:c1\tLN:100\n" + "\n".join([
    "r1\t0\tc1\t5\t42\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:0\tMD:Z:4", "r2\t16\tc1\t9\t30\t3M\t=\t5\t-8\tAAC\tABC", "r3\t256\tc1\t1\t0\t4M\t*\t0\t0\tACGT\tIIII", "short\t0\tc1",
]) + "\n"


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    path = str(tmp_path / "x.sam")
    got = {r.name: r for r in readers.sam(spark, path).collect()}
    assert set(got) == {"r1", "r2"} and got["r2"].seq == "GTT" and got["r2"].quals == "CBA"
    assert {r.kind: r.fields for r in readers.sam_header(spark, path).collect()}["SQ"] == {"SN": "c1", "LN": "100"}
    rec = readers.sam_records(spark, path).withColumn("NM", F.lit(1)).withColumn("MD", F.lit("4"))
    refs = spark.createDataFrame([("c1", 100)], "name string, len int")
    writers.write_sam(rec, refs, str(tmp_path / "out"))
    lines = [line for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out")).collect() for line in [r.value]]
    assert "@SQ\tSN:c1\tLN:100" in lines and "r1\t0\tc1\t5\t42\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tMD:Z:4" in lines


def test_bam(spark, tmp_path):
    records = [dict(zip(readers.SAM_COLUMNS, r)) for r in [("r1", 0, "c1", 5, 42, "3M1I1M", "*", 0, 0, "ACGTN", "IIIII"), ("r2", 16, "c2", 9, 30, "3M", "c1", 5, -8, "AAC", "*")]]
    (tmp_path / "x.bam").write_bytes(writers.bam_bytes(["@HD\tVN:1.3"], [("c1", 100), ("c2", 50)], records))
    got = [r.asDict() for r in readers.bam_records(spark, str(tmp_path / "x.bam")).collect()]
    assert got == records
    assert {r.name: r.seq for r in readers.bam(spark, str(tmp_path / "x.bam")).collect()} == {"r1": "ACGTN", "r2": "GTT"}


def test_vcf(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("##v\n#CHROM\n1\t10\t.\tAC\tG,T\t50\tPASS\tX=1\n1\t20\t.\tA\t.\t.\tPASS\tEND=99;Y=2\n2\t5\t.\tA\tC\tbad\tPASS\n3\t1\t.\tA\n")
    got = sorted(tuple(r) for r in readers.vcf(spark, str(tmp_path / "x.vcf")).collect())
    assert [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in got] == [("1", 10, 12, "AC", "G", 50), ("1", 10, 12, "AC", "T", 50), ("1", 20, 99, "A", "A", 255), ("2", 5, 6, "A", "C", 255)]


def test_pac_and_bwt_files(spark, tmp_path):
    for n in range(9):
        assert readers.parse_pac(writers.pac_bytes("ACGTTGCAC"[:n])) == "ACGTTGCAC"[:n]
    (tmp_path / "x.pac").write_bytes(writers.pac_bytes("GATTACA"))
    assert readers.pac(spark, str(tmp_path / "x.pac")).first().seq == "GATTACA"
    sa = suffix.suffix_array(spark.createDataFrame([(1, "ACA"), (2, "GA")], "string_id long, seq string"))
    assert writers.bwt_text(sa).first().value == "".join(r.bwt for r in sa.orderBy("rank").collect())
    assert sorted(r.string_id for r in writers.primaries(sa).collect()) == [1, 2]


# mapping


def test_read_mapper(spark):
    rng = random.Random(8)
    ref = ["".join(rng.choice("ACGT") for _ in range(600)) for _ in range(3)]
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [(1, ref[0][100:160]), (2, flip(ref[1][200:260])), (3, ref[2][300:330] + ref[2][332:362]), (4, "".join(rng.choice("ACGT") for _ in range(60)))]
    r, g = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(list(enumerate(ref)), "ref_id long, seq string")
    got = {x.read_id: x for x in mapper.map_reads(r, g).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].ref_id, got[1].pos, got[1].rc, got[1].score, got[1].cigar) == (0, 100, False, 0, "60M")
    assert (got[2].ref_id, got[2].pos, got[2].rc) == (1, 200, True) and got[1].mapq == 42
    assert (got[3].ref_id, got[3].score) == (2, -2) and "2D" in got[3].cigar
    exact = mapper.exact_hits(r.filter("read_id < 3"), g, 60)
    assert sorted((x.read_id, x.rc, x.pos) for x in exact.collect()) == [(1, False, 100), (2, True, 200)]
    near = mapper.approximate_seeds(spark.createDataFrame([(9, ref[0][10:30] + "A")], "read_id long, seq string"), g, 20, 50)
    assert (9, 10) in {(x.read_id, x.pos) for x in near.collect()}


def test_mates(spark):
    cols = "read_id long, ref_id long, pos long, end long, rc boolean, score int"
    a = spark.createDataFrame([(1, 0, 100, 150, False, -1), (2, 0, 100, 150, True, 0)], cols)
    o = spark.createDataFrame([(1, 0, 300, 350, True, -2), (1, 0, 900, 950, True, 0), (1, 0, 300, 350, False, 0), (2, 0, 20, 70, False, -3)], cols)
    got = [(r.read_id, r.fragment, r.pair_score) for r in mapper.pairs(a, o, 50, 400).orderBy("read_id").collect()]
    assert got == [(1, 250, -3), (2, 130, -3)]


def test_mapq(spark):
    df = spark.createDataFrame([(0, None, 100), (-30, None, 100), (0, -60, 100), (-100, None, 100), (0, 0, 100)], "best int, second int, n int")
    got = [r.q for r in df.select(mapq.mapq(mapq.END_TO_END, F.col("best"), F.col("second"), F.col("n")).alias("q")).collect()]
    assert got == [42, 23, 39, 0, 1]
    assert df.select(mapq.mapq_v3(mapq.END_TO_END, F.col("best"), F.col("second"), F.col("n")).alias("q")).first().q == 44


# streams


def drain(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(90)
    return spark.table(name)


def test_streams(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/a.txt").write_text("ACGTAC\n\n")
    (tmp_path / "in/b.txt").write_text("CGTACG\n")
    counts = drain(streams.qgram_counts(streams.lines(spark, str(tmp_path / "in")), 4), "complete", "grams", spark)
    assert {r.gram: r.n for r in counts.collect()} == {"ACGT": 1, "CGTA": 2, "GTAC": 2, "TACG": 1}
    for k, rows in enumerate([[(1, 5, 0), (2, 1, 0)], [(1, 7, 3), (2, 0, 9)]]):
        spark.createDataFrame(rows, "read_id long, score int, ref_id long").coalesce(1).write.parquet(str(tmp_path / f"s/{k}"))
    best = drain(streams.best_so_far(streams.tables(spark, str(tmp_path / "s/*"), "read_id long, score int, ref_id long")), "complete", "best", spark)
    assert sorted(map(tuple, best.collect())) == [(1, 7, 3), (2, 1, 0)]
    q = streams.map_batches(streams.lines(spark, str(tmp_path / "in")), lambda d: d.select("seq"), str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_event_windows(spark, tmp_path):
    spark.sql("select * from values (timestamp'2024-01-01 00:00:10', 'a', 1.0D, 1L), (timestamp'2024-01-01 00:04:00', 'a', 2.0D, 1L), (timestamp'2024-01-01 02:00:00', 'b', 1.0D, 2L) t(ts, event_type, value, user_id)").coalesce(1).write.parquet(str(tmp_path / "e"))
    e = streams.tables(spark, str(tmp_path / "e"), "ts timestamp, event_type string, value double, user_id long")
    w = drain(streams.windowed(e, "5 minutes", None, "1 minute"), "complete", "win", spark).collect()
    assert sorted((r.event_type, r.n, r.total) for r in w) == [("a", 2, 3.0), ("b", 1, 1.0)]
    assert sorted(r.n for r in drain(streams.sessions(e, "10 minutes", "1 minute"), "complete", "ses", spark).collect()) == [1, 2]


def test_pairs_of_reads(spark):
    rng = random.Random(12)
    ref = "".join(rng.choice("ACGT") for _ in range(1200))
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    schema = "read_id long, seq string"
    m1, m2 = spark.createDataFrame([(1, ref[100:160]), (2, ref[500:560])], schema), spark.createDataFrame([(1, flip(ref[300:360])), (2, ref[600:660])], schema)
    g = spark.createDataFrame([(0, ref)], "ref_id long, seq string")
    got = mapper.map_pairs(m1, m2, g).collect()
    assert [(r.read_id, r.pos, r.o_pos, r.fragment, r.pair_score, r.mapq) for r in got] == [(1, 100, 300, 260, 0, 42)]
    assert [(r.read_id, r.pos, r.n) for r in mapper.map_exact(m1, g, 60).orderBy("read_id").collect()] == [(1, 100, 1), (2, 500, 1)]


def test_archive_files(spark, tmp_path):
    s = spark.createDataFrame([(0, "a", "ACGTNNA"), (1, "b", "TT")], "number int, name string, seq string")
    (tmp_path / "x.ann").write_text("\n".join(writers.annotation_lines(s)) + "\n")
    assert sorted(map(tuple, readers.annotations(spark, str(tmp_path / "x.ann")).collect())) == [(0, "a", "", 0, 7, 1), (1, "b", "", 7, 2, 0)]
    (tmp_path / "x.amb").write_text("9 2 1\n4 2 N\n")
    assert list(map(tuple, readers.holes(spark, str(tmp_path / "x.amb")).collect())) == [(4, 2, "N")]
    assert [tuple(r) for r in s.select(writers.packed(F.lit("ACGTA")), writers.packed(F.lit("ACGTN"), 4)).limit(1).collect()] == [("1b0", "1248f")]


def test_report(spark):
    from helixframe.operators import stats

    page = stats.report_html("a < b", {"t": spark.range(3).toDF("x")}, most=2)
    assert "a &lt; b" in page and "<td>1</td>" in page and "<td>2</td>" not in page and "first 2 rows" in page


def test_qgrams_of_a_long_sequence_take_linear_time(spark):
    """Grams from stretches are the grams of the whole; 200,000 symbols take seconds, not minutes."""
    import time

    rng = random.Random(5)
    seq = "".join(rng.choice("ACGT") for _ in range(200_000))
    small = spark.createDataFrame([(0, seq[:1000]), (1, "ACG"), (2, ""), (3, None), (4, seq[:64]), (5, seq[:70])], "string_id int, seq string")
    for q, interval in ((3, 1), (20, 7), (64, 1), (100, 33), (5, 200)):
        want = sorted((i, p, s[p : p + q]) for i, s in ((0, seq[:1000]), (1, "ACG"), (2, ""), (4, seq[:64]), (5, seq[:70])) for p in range(0, len(s) - q + 1, interval))
        assert sorted(tuple(r) for r in seeds.qgrams(small, q, interval).collect()) == want
    start = time.time()
    assert seeds.qgrams(spark.createDataFrame([(0, seq)], "string_id int, seq string"), 20).filter("length(gram) = 20").count() == len(seq) - 19
    assert time.time() - start < 20


def test_maximal_matches_against_the_suffix_array(spark):
    rng = random.Random(6)
    refs = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(3)]
    patterns = [refs[0][20:80] + "N" + refs[1][5:50], refs[2][:40] + refs[0][100:160], "".join(rng.choice("ACGT") for _ in range(90)), "", refs[1]]
    p = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
    r = spark.createDataFrame(list(enumerate(refs)), "ref_id long, seq string")
    got = sorted(tuple(x) for x in fulltext.maximal_matches(p, r, 8).collect())
    assert got == sorted(tuple(x) for x in fulltext.find_mems(p, "N".join(refs), min_span=8).collect()) and got
    at = p.withColumn("at", F.lit(10))
    index = fulltext.SuffixArray("N".join(refs))
    assert sorted(tuple(x) for x in fulltext.threshold_matches(at, "N".join(refs)).collect()) == sorted((i, 10, *m) for i, s in enumerate(patterns) for m in fulltext.threshold_mems(index, s, 10))


def test_tags_of_mapped_reads(spark):
    rng = random.Random(7)
    ref = "".join(rng.choice("ACGT") for _ in range(3000))
    read = ref[1000:1060] + ("A" if ref[1060] != "A" else "C") + ref[1061:1100] + ref[1102:1150]
    got = mapper.map_reads(spark.createDataFrame([(1, read)], "read_id long, seq string"), spark.createDataFrame([(0, ref)], "ref_id long, seq string")).first()
    assert (got.pos, got.nm, got.xm, got.xo, got.xg) == (1000, 3, 1, 1, 1) and got.md.startswith(f"60{ref[1060]}")


def test_one_file_sinks(spark, tmp_path):
    """A SAM and a BAM file of many partitions are one valid file each, by the path's suffix."""
    rows = spark.range(2500).select(
        F.concat(F.lit("r"), "id").alias("name"), F.lit(0).alias("flag"), F.lit("c1").alias("ref"), (F.col("id") + 1).alias("pos"), F.lit(9).alias("mapq"), F.lit("4M").alias("cigar"), F.lit("*").alias("mate_ref"),
        F.lit(0).cast("long").alias("mate_pos"), F.lit(0).cast("long").alias("tlen"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("quals"),
    )
    refs = spark.createDataFrame([("c1", 9000)], "name string, len int")
    for end in ("sam", "bam"):
        path = str(tmp_path / f"x.{end}")
        writers.write_alignments(rows.repartition(4), refs, path)
        assert os.path.isfile(path)
        back = (readers.sam_records if end == "sam" else readers.bam_records)(spark, path)
        assert sorted(r.pos for r in back.collect()) == list(range(1, 2501))
    text = (tmp_path / "x.sam").read_text().splitlines()
    assert text[0].startswith("@HD") and sum(x.startswith("@") for x in text) == 3 and not any(x.startswith("@") for x in text[3:])


def test_mapping_quality_forms(spark):
    """Minimum scores are cut to integers; the table's perfect row is read by either rule."""
    df = spark.createDataFrame([(-43, None, 102), (0, -10, 100), (-10, -40, 100)], "best int, second int, n int")
    args = F.col("best"), F.col("second"), F.col("n")
    got = df.select(mapq.mapq(mapq.END_TO_END, *args).alias("v2"), mapq.mapq_v3(mapq.END_TO_END, *args).alias("c"), mapq.mapq_v3(mapq.END_TO_END, *args, compat=False).alias("s")).collect()
    assert [r.v2 for r in got][0] == 0 and got[1].c == mapq.V3_TWO_PERFECT[0] and got[1].s == mapq.V3_TWO_PERFECT[2] and got[2].c == got[2].s
