"""SimHash near-dedup with deletion-variant signatures.

Fingerprints have 64 bits. They are cut into three segments (22, 21, 21 bits), so of two
that differ in at most four bits, one segment differs in at most one. That segment is found
by equality: each fingerprint is listed under each segment with one bit taken out (a
wildcard), and under each whole segment; two that meet under a wildcard must differ in that
bit, so a pair meets a few times at most. Every meeting is verified on all bits, inside the join.

Beyond ``WIDE`` distinct fingerprints, segment keys alone would bring too many strangers
together. There the key also takes a part of the other bits, again by the pigeonhole rule:
after a whole segment, four differences leave one of five parts equal; after a wildcard,
three leave one of four. No pair is lost either way.

Documents with one fingerprint are one row throughout. Large groups of near copies are first
linked through the least and the greatest fingerprint of each whole segment, so that only
pairs which these links leave apart are tested (``linking``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as W
from .common import cut, stored, table
from .linking import components, cross_pairs, labelled, labels
from .xxh import xxh64

SEGMENTS = ((0, 22), (22, 43), (43, 64))
WIDE = 1 << 22
PIECE = 1 << 18  #: shingles hashed at once


def fingerprint_batch(column: pa.Array, k: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprints (uint64) of an Arrow batch of texts, of k-word shingles."""
    flat, offs = W.flat_bytes(column)
    flat = W.LOWER[flat]
    s, e, at = W.spans(flat, offs, W.NOT_SPACE)
    n = np.diff(at)
    size = e - s  # the words again, each followed by one space
    starts = np.cumsum(size + 1) - (size + 1)
    buf = np.full((int(starts[-1] + size[-1]) if len(s) else 0) + 9, 0x20, np.uint8)
    inside = np.repeat(starts - s, size) + np.flatnonzero(W.NOT_SPACE[flat])
    buf[inside] = flat[W.NOT_SPACE[flat]]
    ends = starts + size
    shingles = np.where(n > 0, np.maximum(1, n - k + 1), 0)
    doc = np.repeat(np.arange(len(n)), shingles)
    first = np.repeat(at[:-1], shingles) + W.runs(shingles)
    last = np.minimum(first + k - 1, np.repeat(at[1:], shingles) - 1)
    votes = np.zeros((len(n), 64), np.int64)
    for i in range(0, len(first), PIECE):
        j = min(len(first), i + PIECE)
        h = xxh64(buf, starts[first[i:j]], ends[last[i:j]], seed)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        heads = np.concatenate([[0], np.flatnonzero(np.diff(doc[i:j])) + 1])
        votes[doc[i:j][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > shingles[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """docs' kept columns and their fingerprint (fp, a long of the same 64 bits)."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches):
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(fingerprint_batch(b.column("text")).view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", fp long")


def _bits(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def _signed(m: int) -> int:
    m &= (1 << 64) - 1
    return m - (1 << 64) if m >> 63 else m


def _signatures(wide: bool) -> list[tuple[int, int]]:
    """(wildcard bit or -1, mask of the bits that must agree) of every signature."""
    out = []
    for lo, hi in SEGMENTS:
        seg = [i for i in range(64) if lo <= i < hi]
        rest = [i for i in range(64) if i not in seg]
        for bit in (-1, *seg):
            parts = (5 if bit < 0 else 4) if wide else 1
            for p in range(parts):
                agree = [i for i in seg if i != bit] + ([i for k, i in enumerate(rest) if k * parts // len(rest) == p] if wide else [])
                out.append((bit, _signed(sum(1 << i for i in agree))))
    return out


def hub_links(prints: DataFrame, distance: int = 4, known: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b): fingerprints (node) near one of two hubs that share a whole segment with them.

    A segment's hubs are its least and its greatest fingerprint, by value, or by a hash where
    labels are known; fingerprints of one label aren't paired.
    """
    segments = F.array(*[F.struct(F.lit(n).cast("short").alias("sig"), F.lit(_signed(_bits(*s))).alias("mask")) for n, s in enumerate(SEGMENTS)])
    rows = labelled(prints.select("node"), known).select("node", "root", F.explode(segments).alias("s")).select("node", "root", "s.sig", F.col("node").bitwiseAND(F.col("s.mask")).alias("key"))
    row = F.struct((F.col("node") if known is None else F.xxhash64("node")).alias("by"), "node", "root")
    hubs = rows.groupBy("sig", "key").agg(F.min(row).alias("lo"), F.max(row).alias("hi"), (F.min("root") != F.max("root")).alias("apart")).filter("apart")
    met = rows.join(hubs, ["sig", "key"]).select("node", "root", F.explode(F.array("lo", "hi")).alias("hub"))
    met = met.filter((F.col("root") != F.col("hub.root")) & (F.bit_count(F.col("node").bitwiseXOR(F.col("hub.node"))) <= distance))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def links(prints: DataFrame, wide: bool, distance: int = 4, known: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (node) that differ in 1 to ``distance`` bits (at most four) and whose labels differ.

    known: labels (node, root, size) of fingerprints that are connected already.
    """
    sigs = F.array(*[F.struct(F.lit(n).cast("short").alias("sig"), F.lit(bit).cast("byte").alias("bit"), F.lit(mask).alias("mask")) for n, (bit, mask) in enumerate(_signatures(wide))])
    rows = labelled(prints.select("node"), known).select("node", "root", "size", F.explode(sigs).alias("s"))
    rows = rows.select("s.sig", F.col("node").bitwiseAND(F.col("s.mask")).alias("key"), "node", "root", "size", "s.bit")
    differ = "(a_bit < 0 or (shiftrightunsigned(a_node ^ b_node, cast(a_bit as int)) & 1) = 1)"
    return cross_pairs(rows, ["sig", "key"], f"bit_count(a_node ^ b_node) <= {distance} and {differ}")


def edges(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links that connect all fingerprints (node) within ``distance`` bits of each other, each of them within it."""
    found, known = cut(hub_links(prints, distance)), None
    if not found.isEmpty():
        found = cut(found.union(hub_links(prints, distance, labels(found))))
        known = labels(found)
    return found.union(cut(links(prints, prints.count() > WIDE, distance, known)))


def classes(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root): the least of the ids (column id) in each fingerprint's component, null if it has none.

    prints: one row (fp, id) for each distinct fingerprint.
    """
    roots = components(edges(prints.select(F.col("fp").alias("node")), distance))
    whole = cut(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("top")))
    least = whole.groupBy("top").agg(F.min("id").alias("root"))
    return whole.join(least, "top").select("fp", "root")


def simhash(docs: DataFrame, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of every row.

    A null or empty text has fingerprint zero and is linked like any other; a row whose
    doc_id is null gets its component's least id like the rest, or null if the component has
    none. Rows that repeat are returned as often as they occur; an empty table gives an empty
    result; columns beyond doc_id and text are ignored.
    """
    rows = stored(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id"), "simhash")
    found = classes(cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id"))), distance)
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("root").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents", "doc_id", "text"))
