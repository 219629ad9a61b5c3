"""Writers of sequence, alignment and index files.

Text formats are projections to one string column, written by Spark. Binary files are built
as values; single files are put together from parts through Spark's file systems, piece by
piece, so any store that Spark knows will do.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .readers import CIGAR, SAM_COLUMNS, SYMBOLS


def sam_header_lines(references: DataFrame, program: str = "helixframe", version: str = "0.1.0") -> list[str]:
    """The header for references (name, len), in name order; one line a reference."""
    refs = [f"@SQ\tSN:{r.name}\tLN:{r.len}" for r in references.orderBy("name").toLocalIterator()]
    return ["@HD\tVN:1.3", *refs, f"@PG\tID:{program}\tPN:{program}\tVN:{version}"]


def sam_lines(records: DataFrame) -> DataFrame:
    """value: a SAM line of each record (columns as read, and any of the tags NM, AS, XS, XM, XO, XG, MD)."""
    text = lambda c, none="*": F.coalesce(F.col(c).cast("string"), F.lit(none))
    fields = [text("name"), text("flag", "4"), text("ref"), text("pos", "0"), text("mapq", "0"), text("cigar"), text("mate_ref"), text("mate_pos", "0"), text("tlen", "0"), text("seq"), text("quals")]
    tags = [F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{t}:{'Z' if t == 'MD' else 'i'}:"), F.col(t).cast("string"))) for t in ("NM", "AS", "XS", "XM", "XO", "XG", "MD") if t in records.columns]
    return records.select(F.concat_ws("\t", *fields, *tags).alias("value"))


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def merge_parts(spark: SparkSession, folder: str, target: str, head: bytes = b"", tail: bytes = b"") -> None:
    """One file of a folder's parts, in their order, between head and tail; bytes are copied by the file system, none stays in memory."""
    fs, source = _file_system(spark, folder)
    parts = sorted(str(s.getPath()) for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    to, place = _file_system(spark, target)
    out = to.create(place, True)
    out.write(bytearray(head))
    for p in parts:
        data = fs.open(spark._jvm.org.apache.hadoop.fs.Path(p))
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 16, False)
        data.close()
    out.write(bytearray(tail))
    out.close()


def write_sam(records: DataFrame, references: DataFrame, path: str) -> None:
    """One SAM file: the header, then all records."""
    spark = records.sparkSession
    folder = f"{path}.parts"
    head = spark.createDataFrame([(x,) for x in sam_header_lines(references)], "value string").coalesce(1)
    head.union(sam_lines(records)).write.mode("overwrite").text(folder)  # parts keep the union's order
    merge_parts(spark, folder, path)
    fs, place = _file_system(spark, folder)
    fs.delete(place, True)


def write_bam(records: DataFrame, references: DataFrame, path: str) -> None:
    """One BAM file of records with the SAM columns; executors pack, compress and write parts, which the file system puts together.

    Parts are written as text whose line ends are the last byte of a blocked gzip's block: the
    high byte of its size, always 0.
    """
    spark = records.sparkSession
    refs = [(r.name, int(r.len)) for r in references.orderBy("name").toLocalIterator()]  # the header's lines
    number = _numbers(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                cols = [b.column(c).slice(k, 1000).to_pylist() for c in SAM_COLUMNS]
                yield pa.record_batch([pa.array([bgzf(_record_bytes(number, zip(*cols)), False)[:-1]], pa.binary())], ["data"])

    folder = f"{path}.parts"
    parts = records.select(*SAM_COLUMNS).mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    parts.write.mode("overwrite").option("lineSep", "\0").option("compression", "none").text(folder)
    merge_parts(spark, folder, path, bgzf(header_bytes(sam_header_lines(references), refs), False), bgzf(b""))
    fs, place = _file_system(spark, folder)
    fs.delete(place, True)


def write_alignments(records: DataFrame, references: DataFrame, path: str) -> None:
    """SAM or BAM by the path's suffix (others: SAM), Parquet for .dbg."""
    end = path.lower().rsplit(".", 1)[-1]
    if end == "dbg":
        records.write.mode("overwrite").parquet(path)
    else:
        {"bam": write_bam}.get(end, write_sam)(records, references, path)


def bgzf(data: bytes, end: bool = True) -> bytes:
    """Blocked gzip: blocks of at most 65,280 bytes, each with its size, and the empty end block."""
    out = []
    for i in [*range(0, len(data), 65280), *([None] if end else [])]:
        part = b"" if i is None else data[i : i + 65280]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def header_bytes(header: list[str], references: list[tuple[str, int]]) -> bytes:
    text = "\n".join(header).encode() + b"\n"
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(references))]
    for name, size in references:
        out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size))
    return b"".join(out)


def _numbers(references: list[tuple[str, int]]) -> dict[str, int]:
    return {"*": -1} | {name: k for k, (name, _) in enumerate(references)}


def record_bytes(references: list[tuple[str, int]], records: list[dict]) -> bytes:
    """BAM records of dicts with the SAM columns."""
    return _record_bytes(_numbers(references), ([r[c] for c in SAM_COLUMNS] for r in records))


_DIGITS = str.maketrans(dict(zip(SYMBOLS, "0123456789abcdef")))
_OTHERS = re.compile(f"[^{SYMBOLS}]")
_QUALS = bytes((q - 33) % 256 for q in range(256))


@functools.lru_cache(1 << 16)
def _operations(cigar: str) -> tuple[int, bytes]:
    ops = [int(n) << 4 | CIGAR.index(o) for n, o in re.findall(r"(\d+)(\D)", cigar)]
    return len(ops), struct.pack(f"<{len(ops)}I", *ops)


def _record_bytes(number: dict[str, int], records: Iterable) -> bytes:
    out = []
    for name, flag, ref, pos, mapq, cigar, mate_ref, mate_pos, tlen, seq, quals in records:
        n_ops, ops = _operations(cigar)
        seq = "" if seq == "*" else seq
        digits = _OTHERS.sub("N", seq).translate(_DIGITS)
        packed = bytes.fromhex(digits + "0" if len(seq) % 2 else digits)
        if quals == "*":
            q = b"\xff" * len(seq)
        else:
            q = quals.encode("latin-1")
            if q and min(q) < 33:
                raise ValueError(f"a quality of record {name!r} is below !")
            q = q.translate(_QUALS)
        key = name.encode() + b"\0"
        head = struct.pack("<iiBBHHHiiii", number[ref], pos - 1, len(key), mapq, 4680, n_ops, flag, len(seq), number[mate_ref], mate_pos - 1, tlen)
        out += [struct.pack("<i", len(head) + len(key) + len(ops) + len(packed) + len(q)), head, key, ops, packed, q]
    return b"".join(out)


def bam_bytes(header: list[str], references: list[tuple[str, int]], records: list[dict]) -> bytes:
    """A BAM file of records (dicts with the SAM columns)."""
    return bgzf(header_bytes(header, references) + record_bytes(references, records))


def pac_bytes(seq: str) -> bytes:
    """A 2-bit archive of A, C, G, T."""
    codes = ["ACGT".index(c) for c in seq] + [0, 0, 0]
    body = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(seq), 4))
    return body + (b"\0" if len(seq) % 4 == 0 else b"") + bytes([len(seq) % 4])


def bwt_text(sa: DataFrame) -> DataFrame:
    """string_id-independent BWT of a set as rows (block, value): stretches of 2^16 symbols in rank order."""
    block = F.floor(F.col("rank") / (1 << 16))
    rows = sa.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "bwt"))).alias("r"))  # 2^16 at most
    return rows.select("block", F.array_join(F.transform("r", lambda x: x["bwt"]), "").alias("value"))


def primaries(sa: DataFrame) -> DataFrame:
    """position, string_id of the end marks in the BWT (the .pri map)."""
    return sa.filter("bwt = '$'").select(F.col("rank").alias("position"), "string_id")


def fasta_lines(rows: DataFrame, name: Column, seq: Column, width: int = 70) -> DataFrame:
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return rows.select(F.concat(F.lit(">"), name, F.lit("\n"), body).alias("value"))


def fastq_lines(rows: DataFrame, name: Column, seq: Column, quals: Column) -> DataFrame:
    return rows.select(F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), quals).alias("value"))


def write_lines(rows: DataFrame, path: str, gz: bool = False) -> None:
    rows.select("value").write.mode("overwrite").option("compression", "gzip" if gz else "none").text(path)


def annotation_lines(sequences: DataFrame, seed: int = 11) -> list[str]:
    """The .ann file of an archive of sequences (number, name, seq), in the order of number."""
    rows = list(sequences.select("number", "name", F.length("seq").alias("n"), F.size(F.regexp_extract_all("seq", F.lit("[^ACGT]+"), F.lit(0))).alias("holes")).orderBy("number").toLocalIterator())
    out, at = [f"{sum(r.n for r in rows)} {len(rows)} {seed}"], 0
    for r in rows:
        out += [f"0 {r.name}", f"{at} {r.n} {r.holes}"]
        at += r.n
    return out


def packed(seq: Column, bits: int = 2) -> Column:
    """Sequences as hexadecimal digits of 2-bit (A, C, G, T) or 4-bit (one bit a base; N is 15) symbols, the first symbol highest."""
    if bits == 4:
        return F.translate(seq, "ACGTN", "1248f")
    pairs = F.regexp_extract_all(F.concat(F.translate(seq, "ACGT", "0123"), F.when(F.length(seq) % 2 == 1, "0").otherwise("")), F.lit(".."), F.lit(0))
    return F.array_join(F.transform(pairs, lambda p: F.lower(F.conv(p, 4, 16))), "")
