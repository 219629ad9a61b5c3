"""Readers of sequence, alignment and variant files.

Each gives a DataFrame with an explicit schema. Line formats use Spark's text reader, so they
are split and decompressed by Spark; FASTA records are split at their marks by the reader's
line separator. FASTQ with multi-line bases and binary formats are parsed file by file from
Spark's binary reader. No reader opens a path itself, so any store that Spark knows will do.
"""

from __future__ import annotations

import functools
import gzip
import io
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import codecs

READS = "name string, seq string, quals string"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of each record: the name ends at the first white space; body lines are joined."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    head, rest = F.regexp_extract(body, r"^([^\n]*)", 1), F.regexp_replace(body, r"^[^\n]*\n?", "")
    rows = raw.filter("trim(value) != ''").select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_replace(rest, r"[\s]", "").alias("seq"))
    return rows


def parse_fastq(data: bytes, strict: bool = True) -> Iterator[tuple[str, str, str]]:
    """(name, seq, quals) of each record. Bases may span lines and keep only visible characters; there is one quality line, and it sets the length.

    A record that doesn't begin with @ or is cut off raises ValueError, or is skipped up to the next line (strict=False).
    """
    rows = iter(data.decode("latin-1").split("\n"))
    for line in rows:
        line = line.rstrip("\r")
        if not line.strip():
            continue
        if line[0] != "@":
            if strict:
                raise ValueError(f"a record begins with {line[:20]!r}, not with @")
            continue
        name, bases = line[1:], []
        for body in rows:
            if body.startswith("+"):
                break
            bases.append("".join(c for c in body if "!" <= c <= "~"))
        quals = next(rows, None)
        if quals is None or (not quals and any(bases)):
            if strict:
                raise ValueError(f"record {name!r} is cut off")
            return
        quals = quals.rstrip("\r")
        yield name, "".join(bases)[: len(quals)], quals


def fastq(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """name, seq, quals (ASCII) of each record of .fastq or .fastq.gz files, one task a file."""
    return _files(spark, path, lambda data: parse_fastq(data, strict), READS)


def _files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = b.column("content")[k].as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = []
                for r in parse(data):
                    rows.append(r)
                    if len(rows) == 5000:
                        yield _batch(rows, names, schema)
                        rows = []
                yield _batch(rows, names, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "smallint": pa.int16()}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    types = [_TYPES[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def txt(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a line; blank lines are skipped; no names and no qualities."""
    return spark.read.text(path).filter("trim(value) != ''").select(F.lit("").alias("name"), F.trim("value").alias("seq"), F.lit(None).cast("string").alias("quals"))


SAM_COLUMNS = ("name", "flag", "ref", "pos", "mapq", "cigar", "mate_ref", "mate_pos", "tlen", "seq", "quals")


def sam_records(spark: SparkSession, path: str) -> DataFrame:
    """All alignment records with their 11 fields and the tags as an array; shorter lines are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter("not startswith(value, '@')").filter(F.size(f) >= 11)
    cast = {"flag": "int", "pos": "long", "mapq": "int", "mate_pos": "long", "tlen": "long"}
    return rows.select(*[f[k].cast(cast.get(c, "string")).alias(c) for k, c in enumerate(SAM_COLUMNS)], F.slice(f, 12, 1 << 20).alias("tags"))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """kind (HD, SQ, ..), fields: a map of tags."""
    rows = spark.read.text(path).filter("startswith(value, '@')")
    pairs = F.transform(F.filter(F.slice(F.split("value", "\t"), 2, 1 << 20), lambda x: F.instr(x, ":") > 0), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, 4, 1 << 20).alias("v")))
    return rows.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(pairs).alias("fields"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """The reads of a SAM file: secondary records are left out, reverse ones turned back to the read's strand."""
    return _as_reads(sam_records(spark, path))


def _as_reads(records: DataFrame) -> DataFrame:
    back = F.col("flag").bitwiseAND(F.lit(16)) != 0
    return records.filter(F.col("flag").bitwiseAND(F.lit(256)) == 0).select(
        "name", F.when(back, codecs.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("quals")).otherwise(F.col("quals")).alias("quals"), "flag"
    )


SYMBOLS = codecs.ALPHABETS["DNA_IUPAC"]
CIGAR = "MIDNSHP=X"
BAM = "name string, flag int, ref string, pos long, mapq int, cigar string, mate_ref string, mate_pos long, tlen long, seq string, quals string"


def parse_bam(data: bytes) -> Iterator[tuple]:
    """The records of an uncompressed BAM stream; places are 1-based as in SAM."""
    for refs, records in bam_pieces(io.BytesIO(data)):
        yield from parse_bam_records(refs, records)


def bam_pieces(stream, size: int = 1 << 20) -> Iterator[tuple[list[str], bytes]]:
    """Names of references and whole records, about ``size`` bytes at a time, of an uncompressed BAM stream."""

    def take(n: int) -> bytes:
        out = stream.read(n)
        if len(out) < n:
            raise ValueError("the BAM file is cut off")
        return out

    number = lambda: struct.unpack("<i", take(4))[0]
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    take(number())
    refs = []
    for _ in range(number()):
        refs.append(take(number())[:-1].decode())
        take(4)
    rest = b""
    while new := stream.read(size):
        data, at = rest + new, 0
        while at + 4 <= len(data) and (end := at + 4 + int.from_bytes(data[at : at + 4], "little", signed=True)) <= len(data):
            at = end
        if at:
            yield refs, data[:at]
        rest = data[at:]
    if rest:
        raise ValueError("the BAM file is cut off")


_HEX = str.maketrans(dict(zip("0123456789abcdef", SYMBOLS)))
_PHRED = "".join(chr(q + 33) for q in range(256))


@functools.lru_cache(1 << 16)
def _cigar(ops: bytes) -> str:
    return "".join(f"{o >> 4}{CIGAR[o & 15]}" for o in struct.unpack(f"<{len(ops) // 4}I", ops)) or "*"


def parse_bam_records(refs: list[str], data: bytes) -> Iterator[tuple]:
    name, at, fields = [*refs, "*"], 0, struct.Struct("<iiiBBHHHiiii").unpack_from  # -1 is the last
    while at < len(data):
        size, ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate_ref, mate_pos, tlen = fields(data, at)
        k = at + 36
        read = data[k : k + l_name - 1].decode()
        k += l_name
        cigar = _cigar(data[k : k + 4 * n_ops])
        k += 4 * n_ops
        seq = data[k : k + (l_seq + 1) // 2].hex().translate(_HEX)[:l_seq]
        k += (l_seq + 1) // 2
        raw = data[k : k + l_seq]
        quals = "*" if not raw or raw[0] == 255 else raw.decode("latin-1").translate(_PHRED)
        yield read, flag, name[max(ref, -1)], pos + 1, mapq, cigar, name[max(mate_ref, -1)], mate_pos + 1, tlen, seq or "*", quals
        at += 4 + size


def bam_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of BAM files (blocked gzip): one task a file unpacks it and cuts it between records, all tasks parse the pieces."""
    names = [c.split()[0] for c in BAM.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = b.column("content")[k].as_py()
                raw = io.BytesIO(data)
                for refs, records in bam_pieces(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw):
                    yield pa.record_batch([pa.array([refs], pa.list_(pa.string())), pa.array([records], pa.binary())], ["refs", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = parse_bam_records(b.column("refs")[k].as_py(), b.column("records")[k].as_py())
                while some := list(itertools.islice(rows, 5000)):
                    yield _batch(some, names, BAM)

    pieces = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "refs array<string>, records binary")
    return pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, BAM)


def bam(spark: SparkSession, path: str) -> DataFrame:
    return _as_reads(bam_records(spark, path))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, stop, ref, alt, qual: a row for each alternative.

    Text from # on is a comment; lines need 7 fields. stop is pos + length of ref, or INFO's
    END. An alternative of . is the reference itself; a quality that is no number is 255.
    """
    line = F.regexp_replace("value", "#.*$", "")
    f = F.split(line, "\t")
    rows = spark.read.text(path).filter(F.size(f) >= 7).select(f.alias("f"))
    end = F.regexp_extract(F.coalesce(F.get("f", F.lit(7)), F.lit("")), r"(?:^|;)END=(\d+)", 1)
    start = F.col("f")[1].cast("long")
    ref = F.col("f")[3]
    return rows.select(
        F.col("f")[0].alias("chrom"), start.alias("start"), F.when(end != "", end.cast("long")).otherwise(start + F.length(ref)).alias("stop"), ref.alias("ref"),
        F.explode(F.split(F.col("f")[4], ",")).alias("alt"), F.coalesce(F.expr("try_cast(f[5] as double)").cast("smallint"), F.lit(255).cast("smallint")).alias("qual"),
    ).withColumn("alt", F.when(F.col("alt") == ".", F.col("ref")).otherwise(F.col("alt")))


def parse_pac(data: bytes, n: int | None = None) -> str:
    """The symbols of a 2-bit archive: four a byte, the first in the high bits; the last byte is their number modulo 4, after an empty byte if that is 0."""
    if n is None:
        n = (len(data) - 2) * 4 + data[-1]
    return "".join("ACGT"[data[i >> 2] >> (6 - 2 * (i & 3)) & 3] for i in range(n))


def pac(spark: SparkSession, path: str) -> DataFrame:
    """seq of each .pac file."""
    return _files(spark, path, lambda d: [(parse_pac(d),)], "seq string")


def open_sequences(spark: SparkSession, path: str, strands: tuple[str, ...] = ("forward",), max_len: int | None = None, offset: int = 33) -> DataFrame:
    """seq_id, name, strand, seq, quals, len, alphabet of any sequence file, by its suffix (.gz aside; unknown: FASTQ).

    Symbols are upper-cased and others than A, C, G, T become N; sequences are cut to max_len;
    qualities are numbers (255 where the format has none).
    """
    end = path.lower().removesuffix(".gz").rsplit(".", 1)[-1]
    reader = {"fasta": fasta, "fa": fasta, "txt": txt, "sam": sam, "bam": bam}.get(end, fastq)
    rows = reader(spark, path)
    if "quals" not in rows.columns:
        rows = rows.withColumn("quals", F.lit(None).cast("string"))
    seq = F.regexp_replace(F.upper("seq"), "[^ACGT]", "N")
    rows = rows.select(F.monotonically_increasing_id().alias("seq_id"), "name", seq.alias("seq"), "quals")
    quals = F.when(F.col("quals").isNull() | (F.col("quals") == "*"), F.array_repeat(F.lit(255), F.length("seq"))).otherwise(codecs.phred(F.col("quals"), offset))
    n = F.lit(max_len) if max_len else F.length("seq")
    cut, q = F.substring("seq", F.lit(1), n), F.slice(quals, F.lit(1), F.greatest(n, F.lit(1)))
    each = F.array(*[F.struct(F.lit(s).alias("strand"), codecs.STRANDS[s](F.col("seq")).alias("s"), (F.reverse("quals") if "reverse" in s else F.col("quals")).alias("q")) for s in strands])
    out = rows.withColumn("seq", cut).withColumn("quals", q).select("seq_id", "name", F.inline(each))
    return out.select("seq_id", "name", "strand", F.col("s").alias("seq"), F.col("q").cast("array<smallint>").alias("quals"), F.length("s").alias("len"), F.lit("DNA_N").alias("alphabet"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """number, name, note, offset, len, n_ambiguous of the sequences of an archive, from its .ann file."""

    def parse(data: bytes) -> Iterator[tuple]:
        lines = data.decode().splitlines()
        for k in range(1, len(lines) - 1, 2):
            head, place = lines[k].split(" ", 2), lines[k + 1].split()
            yield (k - 1) // 2, head[1] if len(head) > 1 else "", head[2] if len(head) > 2 else "", int(place[0]), int(place[1]), int(place[2])

    return _files(spark, path, parse, "number int, name string, note string, offset long, len int, n_ambiguous int")


def holes(spark: SparkSession, path: str) -> DataFrame:
    """offset, len, symbol of the ambiguous stretches of an archive, from its .amb file."""

    def parse(data: bytes) -> Iterator[tuple]:
        for line in data.decode().splitlines()[1:]:
            offset, size, symbol = line.split()
            yield int(offset), int(size), symbol

    return _files(spark, path, parse, "offset long, len int, symbol string")
