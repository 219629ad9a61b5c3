"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash fingerprints of the sets (``simhash``) find near copies that differ in few places. A
similarity of 0.8 leaves about ten of 64 bits different, beyond any deletion variants, so the
rest is found by shingles: with the shingles of each set in one order that holds for all
sets, two sets that are similar enough share one among the first fifth of the larger and the
first ninth of the smaller, and these become join keys. Sizes and places of a shared shingle
rule out pairs, and so do parities: 2048 bits tell for the shingles of each of 2048 hash classes
whether their number is odd, and each bit that differs needs a shingle that only one of the
sets has, of which two sets that are similar enough have a ninth of the sum of their sizes at
most. Pairs that are left are compared by their whole sets. Any order finds all pairs:
shingles that a sample shows to be common come last, as they would bring strangers together.

Links to a few hubs come first, so that big groups of near copies never give all pairs
(``linking``). A set goes by a 64-bit mark, a shingle by 50 bits of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import simhash
from . import words as W
from .common import cut, release, remove, stored
from .linking import components, cross_pairs, labelled, labels

K = 5
SHARE = 1 / 8  #: of the documents, for the order; SAMPLE documents at least
SAMPLE = 8192
BYTES = 1 << 20  #: of text at once
PARITIES = 32  #: longs of 64 parities each
FOLDED = 4  #: longs of the same parities, of larger classes
COMMON = 1 << 20  #: common shingles sent to the executors; the order of the rest is by hash
ROUNDS = 3  #: rounds of links to hubs, at most
SMALL = 1 << 20  #: rows of two numbers that may be sent to the executors

_TAGS = np.uint64(14)  #: bits for a text's number in a batch
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes and rows, as sets() takes them."""
    for b in W.pieces(batches, column, BYTES):
        for k in range(0, b.num_rows, 1 << 11):
            yield b.slice(k, 1 << 11)


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (uint64, of 50 bits) of each of 2**14 texts at most, ascending and end to end, and their offsets.

    A text of fewer words has one shingle, of all its words.
    """
    flat, offs = W.flat_bytes(column)
    flat = W.LOWER[flat]
    s, e, at = W.spans(flat, offs, W.NOT_SPACE)
    h, n = W.hashes(flat, s, e), np.diff(at)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    left = np.repeat(at[1:], n) - np.arange(len(h))  # words from here to the text's end
    with np.errstate(over="ignore"):
        sums = h * _FACTORS[0]
        for k in range(1, K):
            sums[:-k] += h[k:] * _FACTORS[k]
        for d in np.flatnonzero((n > 0) & (n < K)):
            sums[at[d]] = (h[at[d] : at[d + 1]] * _FACTORS[: n[d]]).sum() + np.uint64(n[d])
            left[at[d]] = K
    whole = left >= K
    key = np.sort(doc[whole] << (np.uint64(64) - _TAGS) | W.mix(sums[whole]) >> _TAGS)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key & ((np.uint64(1) << (np.uint64(64) - _TAGS)) - np.uint64(1)), np.searchsorted(key, np.arange(len(n) + 1, dtype=np.uint64) << (np.uint64(64) - _TAGS))


def parities(h: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    n = len(at) - 1
    spot = np.repeat(np.arange(n), np.diff(at)) * (64 * PARITIES) + (h & np.uint64(64 * PARITIES - 1)).astype(np.int64)
    odd = (np.bincount(spot, minlength=n * 64 * PARITIES) & 1).astype(np.uint8).reshape(n, 64 * PARITIES)
    return [pa.array(c) for c in np.packbits(odd, axis=1).view(np.int64).T.copy()]


def prints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of each set: the bits that more than half of its shingles' hashes have."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    votes = np.zeros((len(n), 64), np.int64)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), simhash.PIECE):
            part = doc[i : i + simhash.PIECE]
            bits = np.unpackbits(W.mix(h[i : i + simhash.PIECE] + np.uint64(1)).view(np.uint8).reshape(-1, 8), axis=1)
            heads = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
            votes[part[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > n[:, None], axis=1).view(np.int64).ravel()


def marks(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h + np.uint64(1)))])
        return W.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def firsts(h: np.ndarray, at: np.ndarray, common: np.ndarray, rank: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set, in order, and their offsets: common ones last by rank, the rest by hash.

    common: sorted; seen: a bitmap of the top 20 bits of common.
    """
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(h), bool)
    spot = np.flatnonzero(seen[(h >> np.uint64(30)).astype(np.int64)])
    k = np.minimum(np.searchsorted(common, h[spot]), max(0, len(common) - 1))
    if len(common):
        late[spot] = common[k] == h[spot]
    m = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
    early = np.bincount(doc[~late], minlength=len(n))  # of each set
    order = np.empty(len(h), np.int64)
    place = np.cumsum(~late) - 1 - np.repeat(np.cumsum(early) - early, n)  # among the set's own early shingles
    order[(np.repeat(at[:-1], n) + place)[~late]] = np.flatnonzero(~late)
    last = np.flatnonzero(late)
    if len(last):
        at_rank = rank[np.searchsorted(common, h[last])]
        last = last[np.lexsort((at_rank, doc[last]))]
        order[at[:-1][doc[last]] + early[doc[last]] + W.runs(np.bincount(doc[last], minlength=len(n)))] = last
    return h[order[np.repeat(at[:-1], m) + W.runs(m)]], np.concatenate([[0], np.cumsum(m)])


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles that are common in a sample of docs, the commonest last."""
    share = max(SHARE, min(1.0, SAMPLE / max(1, docs.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            yield pa.record_batch([pa.array(sets(b.column("text"))[0].view(np.int64))], ["h"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    counts = some.mapInArrow(run, "h long").groupBy("h").count().filter("count > 2")
    found = counts.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    return found.column("h").to_numpy().view(np.uint64)[::-1].copy()


def _identity() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("order")]


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, order (a hash of the text), node (the set's mark), n (its size), p0.. (parities), fp and keys of every row, stored.

    keys: a set's first shingles, for one of its rows in each task; null for the others.
    """
    common = _common(docs)
    by_hash = np.argsort(common)
    sent = docs.sparkSession.sparkContext.broadcast((common[by_hash], by_hash + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        seen = np.zeros(1 << 20, bool)
        seen[(known >> np.uint64(30)).astype(np.int64)] = True
        done = np.zeros(0, np.int64)  # this task's sets
        for b in _batches(batches):
            h, at = sets(b.column("text"))
            node = marks(h, at)
            keys, ends = firsts(h, at, known, rank, seen)
            fresh = np.zeros(len(node), bool)
            fresh[np.unique(node, return_index=True)[1]] = True
            fresh &= ~np.isin(node, done)
            done = np.concatenate([done, node[fresh]])
            size = np.diff(ends) * fresh
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys[np.repeat(fresh, np.diff(ends))].view(np.int64)), mask=pa.array(~fresh))
            cols = [b.column("doc_id"), b.column("order"), pa.array(node), pa.array(np.diff(at).astype(np.int32)), *parities(h, at), pa.array(prints(h, at)), lists]
            yield pa.record_batch(cols, ["doc_id", "order", "node", "n", *(f"p{i}" for i in range(PARITIES)), "fp", "keys"])

    schema = "doc_id long, order long, node long, n int, " + "".join(f"p{i} long, " for i in range(PARITIES)) + "fp long, keys array<long>"
    return stored(docs.select(*_identity(), "text").mapInArrow(run, schema), "marked")


class Texts:
    """Whole sets of nodes, read from docs when pairs are to be compared."""

    def __init__(self, docs: DataFrame, rows: DataFrame):
        self.docs = docs.select(*_identity(), "text")
        # of each set one row, and its size and parities
        self.one = stored(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "order")).alias("r"), F.min("n").alias("n"), *[F.min(f"p{i}").alias(f"p{i}") for i in range(PARITIES)]), "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough."""
        far = " + ".join(f"bit_count(a_p{i} ^ b_p{i})" for i in range(PARITIES))
        side = lambda x: few.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), *[F.col(f"p{i}").alias(f"{x}_p{i}") for i in range(PARITIES)])
        pairs = cut(pairs)
        few = self._of(pairs)
        pairs = cut(pairs.join(side("a"), "a").join(side("b"), "b").filter(f"9L * ({far}) <= a_n + b_n").select("a", "b"))
        wanted = cut(self._of(pairs).select("node", F.col("r.doc_id").alias("d"), "r.order"))
        # rows that repeat give their pairs again, which does no harm
        text = stored(self.docs.join(_sent(wanted), "order").filter("doc_id <=> d").select("node", "text"), "texts")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _batches(_batches(batches, "ta"), "tb"):
                (x, xa), (y, ya) = sets(b.column("ta")), sets(b.column("tb"))
                nx, ny = np.diff(xa), np.diff(ya)
                row = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)]).astype(np.uint64)
                key = np.sort(row << (np.uint64(64) - _TAGS) | np.concatenate([x, y]))
                twice = key[1:][key[1:] == key[:-1]]
                both = np.bincount((twice >> (np.uint64(64) - _TAGS)).astype(np.int64), minlength=len(nx))
                yield b.select(["a", "b"]).filter(pa.array(9 * both >= 4 * (nx + ny)))

        left, right = (text.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        found = cut(left.join(_sent(pairs), "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))
        remove(text)
        return found

    def _of(self, pairs: DataFrame) -> DataFrame:
        """The rows of the pairs' nodes."""
        nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return self.one.join(_sent(nodes), "node", "left_semi")


def _sent(df: DataFrame) -> DataFrame:
    """df marked to be sent to all executors if it has SMALL rows at most (of a few numbers each); else both sides are shuffled."""
    return F.broadcast(df) if df.count() <= SMALL else df.hint("merge")


#: two sets can be similar enough if this is the first shingle they share
_ODD = " + ".join(f"bit_count(a_p{i} ^ b_p{i})" for i in range(FOLDED))
_CAN = "9L * least(a_n - a_pos, b_n - b_pos) >= 4L * (a_n + b_n)"


def _to_hubs(rows: DataFrame, salt: int) -> DataFrame:
    """For each node the pair (a, b) with the hub of another label that shares most keys with it; a key's hub is its least node by a salted hash."""
    hub = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), "node", "n", "pos", "root")).alias("hub"))
    met = rows.join(hub, "key").select(
        F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("hub.node").alias("b"), F.col("hub.n").alias("b_n"), F.col("hub.pos").alias("b_pos"),
        "root", F.col("hub.root").alias("b_root"),
    ).filter(f"root != b_root and {_CAN}")
    best = met.groupBy("a", "b").count().groupBy("a").agg(F.max(F.struct("count", "b")).alias("r"))
    return best.select(F.least("a", "r.b").alias("a"), F.greatest("a", "r.b").alias("b")).distinct()


def near(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all that are similar enough, each pair similar enough itself.

    rows: as marked() gives them. Pairs that others of these pairs connect may be missing.
    """
    texts = Texts(docs, rows)
    fp = cut(rows.groupBy("node").agg(F.min("fp").alias("fp")))
    head = fp.groupBy("fp").agg(F.min("node").alias("b"))
    alike = simhash.edges(head.select(F.col("fp").alias("node")))
    to_node = lambda x, y: head.select(F.col("fp").alias(x), F.col("b").alias(y))
    first = alike.join(to_node("a", "x"), "a").join(to_node("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = first.union(fp.join(head, "fp").filter("node != b").select(F.col("node").alias("a"), "b"))
    by_key = Window.partitionBy("key")
    met = lambda rows, c: rows.withColumn("lo", F.min(c).over(by_key)).withColumn("hi", F.max(c).over(by_key)).filter("lo != hi").select("key", "node", "n", "pos")
    apart = stored(met(rows.filter("keys is not null").select("node", "n", F.posexplode("keys").alias("pos", "key")), "node").distinct(), "keys")
    release(docs.sparkSession)
    links = texts.verified(first.union(_to_hubs(_rooted(apart, None), 0)).distinct())
    most = links.count()
    for k in range(1, ROUNDS + 1):
        known = labels(links)
        now = stored(met(_rooted(apart, known), "root"), "keys")
        remove(apart)
        apart = now
        release(docs.sparkSession)
        if k == ROUNDS:
            break
        new = texts.verified(_to_hubs(_rooted(apart, known), k))
        found = new.count()
        links = links.union(new)
        if found * 20 <= most:
            known = labels(links)
            break
    parities = texts.one.select("node", *[_folded(i) for i in range(FOLDED)])
    last = labelled(apart, known).join(parities, "node")
    return links.union(texts.verified(cross_pairs(last, ["key"], f"{_CAN} and 9L * ({_ODD}) <= a_n + b_n")))


def _rooted(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows with the roots of their nodes."""
    if known is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(known.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _folded(i: int) -> Column:
    """The i-th long of the parities of classes that are PARITIES / FOLDED times as large."""
    out = F.col(f"p{i}")
    for k in range(i + FOLDED, PARITIES, FOLDED):
        out = out.bitwiseXOR(F.col(f"p{k}"))
    return out.alias(f"p{i}")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of documents with one document of each group of near copies: that with the least doc_id.

    Near copies share at least four fifths of their distinct shingles of five words,
    directly or through others; a text of fewer words has one shingle, and texts without
    words (null ones too) are copies of each other. Rows without a doc_id come after all
    others; of rows that share the doc_id, the one whose text is least by a hash stays, of
    equal rows one. An empty table gives an empty result; extra columns stay.
    """
    rows = marked(docs)
    roots = components(near(docs, rows))
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "order")
    each = cut(rows.groupBy("node", "doc_id", "order").agg(F.count("*").alias("copies")))
    top = each.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = top.groupBy("root").agg(F.min(F.struct(order.alias("o"), "copies")).alias("r")).select("r.o.doc_id", "r.o.order", "r.copies")
    kept = cut(kept)
    single = kept.filter("copies = 1").select(F.col("doc_id").alias("k"), F.col("order").alias("o"))
    gone = each.join(single, (F.col("doc_id").eqNullSafe(F.col("k"))) & (F.col("order") == F.col("o")), "left_anti").select(F.col("doc_id").alias("k"), F.col("order").alias("o"))
    gone = cut(gone)
    small = gone.count() <= SMALL
    is_it = lambda df: F.xxhash64(df["text"]) == F.col("o")
    same = lambda df: is_it(df) & df["doc_id"].cast("long").eqNullSafe(F.col("k"))
    out = docs.join(F.broadcast(gone) if small else gone.hint("merge"), same(docs), "left_anti")
    # rows that repeat: one of each
    many = cut(kept.filter("copies > 1").select(F.col("doc_id").alias("k"), F.col("order").alias("o")))
    cols = docs.columns
    again = docs.join(F.broadcast(many) if many.count() <= SMALL else many.hint("merge"), same(docs)).groupBy("k", "o").agg(F.min(F.struct(*cols)).alias("r")).select("r.*")
    return out.select(*cols).unionByName(again)
