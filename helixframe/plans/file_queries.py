"""Queries that write files or folders in the formats of the sinks, and read them back with the sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import codecs
from helixframe.sources import readers, writers
from helixframe.streaming import sequences as streams

from .harness import SEQS, grams_sql, query, read, sequences


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local session may have one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="helixframe-")
    return f"{path}/{name}-{uuid.uuid4().hex}"


def _names(spark, sf_dir) -> DataFrame:
    return sequences(spark, sf_dir).filter("seq != ''").select(F.col("string_id").cast("string").alias("name"), "seq")


@query(f"WITH {SEQS} SELECT string_id::VARCHAR AS name, seq FROM seqs WHERE seq <> ''")
def fasta_files(spark, sf_dir):
    path = workspace(spark, "fasta") + ".fa"
    writers.write_lines(writers.fasta_lines(_names(spark, sf_dir), F.col("name"), F.col("seq")), path)
    return readers.fasta(spark, path)


_QUALS = "translate(seq, 'ACGT', '5?EI')"


@query(f"WITH {SEQS} SELECT string_id::VARCHAR AS name, seq, {_QUALS} AS quals FROM seqs WHERE seq <> ''")
def fastq_files(spark, sf_dir):
    path = workspace(spark, "fastq") + ".fastq.gz"
    writers.write_lines(writers.fastq_lines(_names(spark, sf_dir), F.col("name"), F.col("seq"), F.expr(_QUALS)), path, gz=True)
    return readers.fastq(spark, path)


@query(f"WITH {SEQS} SELECT seq, length(seq) AS len, list_aggregate(list_transform(string_split({_QUALS}, ''), lambda x: ascii(x) - 33), 'sum')::BIGINT AS quality FROM seqs WHERE seq <> ''")
def sequence_files(spark, sf_dir):
    """Any sequence file, chosen by its suffix: symbols, lengths and numeric qualities."""
    path = workspace(spark, "reads") + ".fastq"
    writers.write_lines(writers.fastq_lines(_names(spark, sf_dir), F.col("name"), F.col("seq"), F.expr(_QUALS)), path)
    total = F.aggregate("quals", F.lit(0).cast("long"), lambda a, x: a + x)
    return readers.open_sequences(spark, path).select("seq", F.col("len").cast("long").alias("len"), total.alias("quality"))


@query(f"WITH {SEQS} SELECT seq, count(*) AS n FROM seqs WHERE seq <> '' GROUP BY seq")
def text_files(spark, sf_dir):
    path = workspace(spark, "lines") + ".txt"
    writers.write_lines(sequences(spark, sf_dir).select(F.col("seq").alias("value")), path)  # empty ones are blank lines
    return readers.txt(spark, path).groupBy("seq").agg(F.count("*").alias("n"))


_RECORDS = """a AS (SELECT l_orderkey || '.' || l_linenumber || '.' || l_partkey AS name, (CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_discount > 0.09 THEN 256 ELSE 0 END)::INT AS flag,
'ref' || (l_suppkey % 5) AS ref, l_partkey::BIGINT AS pos, l_quantity::INT AS mapq, (10 + l_linenumber) || 'M' AS cigar, substring('ACGGTCATTGCAACGTTAGCC', 1, (10 + l_linenumber)::INT) AS seq,
substring('!#%5?EIIIIHGFEDCBA@97', 1, (10 + l_linenumber)::INT) AS quals, (l_discount * 100)::INT AS nm FROM lineitem WHERE l_linenumber <= 7)"""


def _records(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Alignment records made of order lines, and their references."""
    rows = read(spark, sf_dir, "lineitem").filter("l_linenumber <= 7").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey").alias("name"),
        (F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when(F.col("l_discount") > 0.09, 256).otherwise(0)).alias("flag"),
        F.concat(F.lit("ref"), (F.col("l_suppkey") % 5).cast("string")).alias("ref"), F.col("l_partkey").alias("pos"), F.col("l_quantity").cast("int").alias("mapq"),
        F.concat((10 + F.col("l_linenumber")).cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("mate_ref"), F.lit(0).cast("long").alias("mate_pos"), F.lit(0).cast("long").alias("tlen"),
        F.expr("substring('ACGGTCATTGCAACGTTAGCC', 1, 10 + l_linenumber)").alias("seq"), F.expr("substring('!#%5?EIIIIHGFEDCBA@97', 1, 10 + l_linenumber)").alias("quals"),
        F.round(F.col("l_discount") * 100).cast("int").alias("NM"),
    )
    refs = spark.range(5).select(F.concat(F.lit("ref"), F.col("id").cast("string")).alias("name"), F.lit(1 << 24).alias("len"))
    return rows, refs


@query(f"WITH {_RECORDS} SELECT name, flag, ref, pos, mapq, cigar, seq, quals, 'NM:i:' || nm AS tags FROM a")
def sam_files(spark, sf_dir):
    """One SAM file with a header, read as records."""
    path = workspace(spark, "sam") + ".sam"
    writers.write_alignments(*_records(spark, sf_dir), path)
    return readers.sam_records(spark, path).select("name", "flag", "ref", "pos", "mapq", "cigar", "seq", "quals", F.array_join("tags", "\t").alias("tags"))


@query("SELECT 'SQ' AS kind, 'ref' || k AS name, '16777216' AS len FROM range(5) r(k) UNION ALL SELECT 'HD', NULL, NULL UNION ALL SELECT 'PG', NULL, NULL")
def sam_headers(spark, sf_dir):
    path = workspace(spark, "sam") + ".sam"
    rows, refs = _records(spark, sf_dir)
    writers.write_alignments(rows.limit(0), refs, path)
    return readers.sam_header(spark, path).select("kind", F.col("fields")["SN"].alias("name"), F.col("fields")["LN"].alias("len"))


@query(f"""WITH {_RECORDS} SELECT name, flag, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq,
CASE WHEN flag & 16 <> 0 THEN reverse(quals) ELSE quals END AS quals FROM a WHERE flag & 256 = 0""")
def sam_reads(spark, sf_dir):
    """The reads of a SAM file on their own strands, without secondary records."""
    path = workspace(spark, "sam") + ".sam"
    writers.write_alignments(*_records(spark, sf_dir), path)
    return readers.sam(spark, path)


@query(f"WITH {_RECORDS} SELECT name, flag, ref, pos, mapq, cigar, seq, quals FROM a")
def bam_files(spark, sf_dir):
    """One BAM file, packed and compressed by the executors, read as records."""
    path = workspace(spark, "bam") + ".bam"
    writers.write_alignments(*_records(spark, sf_dir), path)
    return readers.bam_records(spark, path).select("name", "flag", "ref", "pos", "mapq", "cigar", "seq", "quals")


@query(f"WITH {_RECORDS} SELECT name, flag, ref, pos, mapq, nm FROM a")
def alignment_tables(spark, sf_dir):
    """Alignments as a table of fixed columns, for comparisons."""
    path = workspace(spark, "alignments") + ".dbg"
    writers.write_alignments(*_records(spark, sf_dir), path)
    return spark.read.parquet(path).select("name", "flag", "ref", "pos", "mapq", F.col("NM").alias("nm"))


@query("""WITH v AS (SELECT 'chr' || (p_partkey % 5) AS chrom, p_partkey AS pos, repeat('A', 1 + (p_partkey % 3)::INT) AS ref, CASE p_partkey % 4 WHEN 0 THEN '.' WHEN 1 THEN 'C,GT' ELSE 'T' END AS alt,
CASE WHEN p_partkey % 7 = 0 THEN 255 ELSE p_size END AS qual, CASE WHEN p_partkey % 6 = 0 THEN p_partkey + 50 END AS stop FROM part)
SELECT chrom, pos AS start, coalesce(stop, pos + length(ref)) AS stop, ref, CASE WHEN a = '.' THEN ref ELSE a END AS alt, qual::SMALLINT AS qual FROM (SELECT *, unnest(string_split(alt, ',')) AS a FROM v)""")
def variant_files(spark, sf_dir):
    k = F.col("p_partkey")
    fields = [
        F.concat(F.lit("chr"), (k % 5).cast("string")), k.cast("string"), F.lit("id"), F.expr("repeat('A', cast(1 + p_partkey % 3 as int))"),
        F.when(k % 4 == 0, ".").when(k % 4 == 1, "C,GT").otherwise("T"), F.when(k % 7 == 0, F.when(k % 2 == 0, ".").otherwise("high")).otherwise(F.col("p_size").cast("string")), F.lit("PASS"),
        F.when(k % 6 == 0, F.concat(F.lit("DP=1;END="), (k + 50).cast("string"))).otherwise("DP=2"),
    ]
    path = workspace(spark, "variants") + ".vcf"
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",), ("too\tshort",)], "value string")
    writers.write_lines(head.union(read(spark, sf_dir, "part").select(F.concat_ws("\t", *fields))), path)
    return readers.vcf(spark, path)


@query(f"""WITH {SEQS} SELECT string_id, 'forward' AS strand, seq FROM seqs WHERE seq <> '' UNION ALL SELECT string_id, 'reverse_complement', reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs WHERE seq <> ''""")
def extracted_reads(spark, sf_dir):
    """Reads on both strands, as 2-bit digits, written, read back and unpacked."""
    rows = sequences(spark, sf_dir).filter("seq != ''")
    both = F.array(*[F.struct(F.lit(s).alias("strand"), codecs.STRANDS[s](F.col("seq")).alias("s")) for s in ("forward", "reverse_complement")])
    path = workspace(spark, "packed")
    out = rows.select("string_id", F.inline(both)).select(F.concat_ws("\t", "string_id", "strand", F.length("s").cast("string"), writers.packed(F.col("s"))).alias("value"))
    writers.write_lines(out, path, gz=True)
    f = F.split("value", "\t")
    pairs = F.transform(F.split(f[3], ""), lambda h: F.lpad(F.conv(h, 16, 4), 2, "0"))
    seq = F.substring(F.translate(F.array_join(pairs, ""), "0123", "ACGT"), F.lit(1), f[2].cast("int"))
    return spark.read.text(path).select(f[0].cast("long").alias("string_id"), f[1].alias("strand"), seq.alias("seq"))


@query(f"WITH {SEQS}, d AS (SELECT DISTINCT seq, min(string_id) OVER (PARTITION BY seq) AS string_id FROM seqs WHERE length(seq) >= 12), {grams_sql('g', 'd', 12, 4)} SELECT gram, count(*) AS n FROM g GROUP BY gram")
def streamed_grams(spark, sf_dir):
    """Running counts of the grams of sequences that arrive as files in a folder, after the last file."""
    path = workspace(spark, "arriving")
    sequences(spark, sf_dir).filter("length(seq) >= 12").select("seq").distinct().repartition(3).write.text(path)
    return streams.result(streams.qgram_counts(streams.lines(spark, path, 2), 12, 4), workspace(spark, "grams"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def streamed_windows(spark, sf_dir):
    """Counts and sums of events by hour, from a stream of tables."""
    path, name = workspace(spark, "events"), f"windows_{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(path)
    counts = streams.windowed(streams.tables(spark, path, events.schema.simpleString()[7:-1].replace(":", " "), 2), "1 hour", None, "36500 days")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT read_id, max(score) AS score FROM (SELECT l_orderkey AS read_id, (l_quantity * 10)::INT AS score FROM lineitem) GROUP BY read_id")
def streamed_best(spark, sf_dir):
    """Each read's best score over all batches of a stream."""
    path = workspace(spark, "scores")
    read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.round(F.col("l_quantity") * 10).cast("int").alias("score"), F.col("l_partkey").alias("ref_id")).repartition(3).write.parquet(path)
    best = streams.best_so_far(streams.tables(spark, path, "read_id long, score int, ref_id long", 2))
    return streams.result(best, workspace(spark, "best")).select("read_id", "score")
