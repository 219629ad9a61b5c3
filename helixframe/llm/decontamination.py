"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a stretch of a partition's texts of about ``shard_bytes``, whose words are found a
piece of ``PIECE`` bytes at a time. Words that no benchmark item has can't be part of a match:
they cut the shard's word sequence into runs of benchmark words, which the index holds (runs
shorter than the shortest window are left out, too; more than ``INDEXED`` words get several
indexes). All windows of the items are searched backward together; their occurrences are
located from sampled suffix positions and merged into spans of words.

The benchmark is split into blocks of at most ``block_bytes`` text by a measured size, and
each block is sent to the executors for one pass over the documents, so a benchmark of any
size is searched whole with bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as W
from .common import stored, table
from .fmindex import FMIndex

WINDOW = 10
CHUNK = 1 << 17  #: occurrences located at once
PIECE = 1 << 20  #: bytes of texts whose words are looked at together
INDEXED = 1 << 18  #: words of an index, or one run: runs are searched apart from each other anyway


@dataclass(frozen=True)
class Windows:
    """The distinct windows of a block of items, over the block's own vocabulary.

    vocab: sorted word hashes, whose places are symbols 1..; text: the words' bytes end to end,
    offsets text_at; twins: symbols of further words that share a word's hash; owners: item
    numbers of each window, end to end with offsets.
    """

    vocab: np.ndarray
    text: np.ndarray
    text_at: np.ndarray
    twins: dict[bytes, int]
    seen: np.ndarray  #: a bitmap of the hashes' first 16 bits
    patterns: np.ndarray
    lengths: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray
    items: list[str]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lower-cased bytes, starts and ends of all words, their hashes, offsets of each text's words."""
    flat, offs = W.flat_bytes(column)
    flat = W.LOWER[flat]
    s, e, at = W.spans(flat, offs, W.ALNUM)
    return flat, s, e, W.hashes(flat, s, e), at


def build_windows(items: list[tuple[str, str]], window: int = WINDOW) -> Windows | None:
    """items: (item id, text). None if no item has a word."""
    flat, s, e, h, at = word_hashes(pa.array([t for _, t in items], pa.string()))
    if not len(h):
        return None
    vocab, first, symbol = np.unique(h, return_index=True, return_inverse=True)
    symbol = symbol + 1
    twins: dict[bytes, int] = {}  # words of one hash: all but the first have symbols of their own
    for i in np.flatnonzero(~W.equal(flat, s, e, flat, s[first[symbol - 1]], e[first[symbol - 1]])):
        symbol[i] = twins.setdefault(flat[s[i] : e[i]].tobytes(), len(vocab) + 1 + len(twins))
    text_at = np.concatenate([[0], np.cumsum(e[first] - s[first])])
    text = flat[np.repeat(s[first] - text_at[:-1], np.diff(text_at)) + np.arange(text_at[-1])]
    names = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    words = np.diff(at)
    count = np.where(words > 0, np.maximum(1, words - window + 1), 0)
    item = np.repeat(np.array([number[i] for i, _ in items]), count)
    start, end = np.repeat(at[:-1], count) + W.runs(count), np.repeat(at[1:], count)
    place = start[:, None] + np.arange(min(window, int(words.max())))
    rows = np.where(place < end[:, None], symbol[np.minimum(place, len(symbol) - 1)], 0).astype(np.int32)
    as_key = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, which, owned = np.unique(as_key, return_index=True, return_inverse=True)
    pairs = np.unique(owned * len(names) + item)
    seen = np.zeros(1 << 16, bool)
    seen[(vocab >> np.uint64(48)).astype(np.int64)] = True
    return Windows(vocab, text, text_at, twins, seen, rows[which], (rows[which] > 0).sum(1), np.searchsorted(pairs, np.arange(len(which) + 1) * len(names)), pairs % len(names), names)


def symbols(flat: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, w: Windows) -> np.ndarray:
    """Each word's symbol, 0 for words that no item has: found by hash, then compared by bytes."""
    out = np.zeros(len(h), np.int64)
    maybe = np.flatnonzero(w.seen[(h >> np.uint64(48)).astype(np.int64)])
    k = np.minimum(np.searchsorted(w.vocab, h[maybe]), len(w.vocab) - 1)
    met = w.vocab[k] == h[maybe]
    maybe, k = maybe[met], k[met]
    same = W.equal(flat, s[maybe], e[maybe], w.text, w.text_at[k], w.text_at[k + 1])
    out[maybe[same]] = k[same] + 1
    for i in maybe[~same]:
        out[i] = w.twins.get(flat[s[i] : e[i]].tobytes(), 0)
    return out


def occurrences(sym: np.ndarray, at: np.ndarray, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word places, window numbers) of all occurrences in the shard, in bounded chunks."""
    n = len(sym)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    start = (sym > 0) & (cut[:-1] | np.concatenate([[True], sym[:-1] == 0]))
    stop = (sym > 0) & (cut[1:] | np.concatenate([sym[1:] == 0, [True]]))
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    long = b - a >= w.lengths.min()
    a, b = a[long], b[long]
    if not len(a):
        return
    group = np.cumsum(b - a + 1) // INDEXED
    for g in np.split(np.arange(len(a)), np.flatnonzero(np.diff(group)) + 1):
        yield from _in_runs(sym, a[g], b[g], w)


def _in_runs(sym: np.ndarray, a: np.ndarray, b: np.ndarray, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """occurrences() in the runs of words from a to b, by one index."""
    size = b - a + 1
    place = np.repeat(a, size) + W.runs(size)  # the last of each run is its end
    text = sym[np.minimum(place, len(sym) - 1)]
    text[np.cumsum(size) - 1] = 0
    index = FMIndex(text, len(w.vocab) + len(w.twins) + 1)
    lo, hi = index.search(w.patterns, w.lengths)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return
    count = (hi - lo)[some]
    total, ends = int(count.sum()), np.cumsum(count)
    for i in range(0, total, CHUNK):  # the i-th occurrence belongs to the window that holds it in the running sum
        k = np.arange(i, min(total, i + CHUNK))
        win = np.searchsorted(ends, k, "right")
        yield place[index.locate(lo[some[win]] + k - (ends - count)[win])], some[win]


def matches(texts: Iterable[pa.Array], w: Windows | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits of all words of a shard, given in pieces, each text's word offsets, and (text << 32 | item) of all matches."""
    found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for column in texts:
        flat, s, e, h, at = word_hashes(column)
        counts.append(np.diff(at))
        found.append(np.zeros(len(h), np.int32) if w is None else symbols(flat, s, e, h, w).astype(np.int32))
    sym, at = np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    edge, pairs = np.zeros(len(sym) + 1, np.int32), [np.zeros(0, np.int64)]
    if w is not None and len(sym):
        for place, win in occurrences(sym, at, w):
            np.add.at(edge, place, 1)
            np.add.at(edge, place + w.lengths[win], -1)
            doc = np.searchsorted(at, place, "right") - 1
            got = np.unique(doc << 32 | win)
            doc, win = got >> 32, got & 0xFFFFFFFF
            n = (w.owner_at[1:] - w.owner_at[:-1])[win]
            pairs.append(np.unique(np.repeat(doc, n) << 32 | w.owners[np.repeat(w.owner_at[win], n) + W.runs(n)]))
    return np.cumsum(edge, dtype=np.int32)[:-1] > 0, at, np.unique(np.concatenate(pairs))


def search(column: pa.Array, w: Windows | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hits, each text's word offsets, and (text << 32 | item) of all matches."""
    flat, offs = W.flat_bytes(column)
    s, e, _ = W.spans(W.LOWER[flat], offs, W.ALNUM)
    return s, e, *matches([column], w)


def _hits(hit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of each text's words that are hit."""
    return np.add.reduceat(np.append(hit, False), at[:-1], dtype=np.int64) * (np.diff(at) > 0)


def block_count(bench: DataFrame, block_bytes: int) -> int:
    size = bench.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)).first()[0] or 0
    return int(size // block_bytes + 1)


def block(bench: DataFrame, k: int, n: int, window: int) -> Windows | None:
    """The windows of one of n blocks of items; only that block comes to the driver."""
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    return build_windows([(r.i, r.t) for r in rows.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()], window)


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.Table]:
    """The shards' rows, in the pieces that their words are found in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in W.pieces(batches, max_bytes=min(shard_bytes, PIECE)):
        held.append(b)
        size += b.nbytes
        if size >= shard_bytes:
            t, held, size = pa.Table.from_batches(held), [], 0
            yield t
    if held:
        yield pa.Table.from_batches(held)


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_bytes: int = 16 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    An item shorter than the window is one window itself; items without words match nothing,
    items that share an id count once. A null text has no words. Rows that repeat are
    returned as often as they occur; an empty table gives an empty result; columns beyond
    those named are ignored. Items without an id go by the empty string.
    """
    n = block_count(bench, block_bytes)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if n > 1:
        return _contamination_in_blocks(docs, bench, n, window, shard_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(block(bench, 0, 1, window))
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for t in _shards(batches, shard_bytes):
            hit, at, pairs = matches(t.column("text").chunks, w)
            n_hit = _hits(hit, at)
            n_items = np.bincount(pairs >> 32, minlength=t.num_rows)
            sha = [none] * t.num_rows
            ends = np.cumsum(n_items)
            for d in np.flatnonzero(n_items):
                sha[d] = hashlib.sha256(",".join(w.items[p & 0xFFFFFFFF] for p in pairs[ends[d] - n_items[d] : ends[d]]).encode()).hexdigest()
            cols = [_column(t, "doc_id"), pa.array(np.diff(at)), pa.array(n_hit), pa.array(n_items), pa.array(sha, pa.string()), pa.array(n_hit > 0)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _contamination_in_blocks(docs: DataFrame, bench: DataFrame, n: int, window: int, shard_bytes: int) -> DataFrame:
    """One pass for each block; hit words and items of a row are then merged by its number."""
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "decontamination")
    passes = []
    for k in range(n):
        sent = docs.sparkSession.sparkContext.broadcast(block(bench, k, n, window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            w = sent.value
            for t in _shards(batches, shard_bytes):
                hit, at, pairs = matches(t.column("text").chunks, w)
                spots = [np.flatnonzero(hit[a:b]).tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
                names: list[list[str]] = [[] for _ in spots]
                for p in pairs:
                    names[p >> 32].append(w.items[p & 0xFFFFFFFF])
                yield pa.RecordBatch.from_arrays([_column(t, "row"), pa.array(np.diff(at)), pa.array(spots, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["row", "n_words", "spots", "names"])

        passes.append(stored(rows.select("row", "text").mapInArrow(run, "row long, n_words long, spots array<long>, names array<string>"), "decontamination"))
        sent.destroy()
    every = passes[0]
    for x in passes[1:]:
        every = every.union(x)
    merged = every.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spots"))).alias("spots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
    )
    return rows.select("doc_id", "row").join(merged, "row").select(
        "doc_id", "n_words", F.size("spots").cast("long").alias("n_hit"), F.size("names").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "names"), 256).alias("items_sha256"), (F.size("spots") > 0).alias("contaminated"),
    )


def _without(raw: bytes, s: np.ndarray, e: np.ndarray, hit: np.ndarray) -> str:
    """A text without its hit words (of bytes s to e), each span of them a line break."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    kept, end = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        kept.append(raw[end : s[a]])
        end = e[b - 1]
    return b"\n".join([*kept, raw[end:]]).decode()


def cut_spans(texts: list[str | None], w: Windows | None) -> list[str | None]:
    """The texts without their hit words; each span of them, with what lies between, becomes one line break.

    What is left is searched again until nothing matches, as a cut can bring words together.
    """
    out, todo = list(texts), np.arange(len(texts))
    while len(todo):
        s, e, hit, at, _ = search(pa.array([out[i] for i in todo], pa.string()), w)
        changed, base = [], 0
        for k, i in enumerate(todo):
            raw = (out[i] or "").encode()
            h = hit[at[k] : at[k + 1]]
            if h.any():
                out[i] = _without(raw, s[at[k] : at[k + 1]] - base, e[at[k] : at[k + 1]] - base, h)
                changed.append(i)
            base += len(raw)
        todo = np.array(changed, np.int64)
    return out


def _cut(b: pa.RecordBatch, dirty: np.ndarray, w: Windows | None) -> pa.RecordBatch:
    """The rows of documents with the texts in dirty places cut; those without a word left go."""
    if not len(dirty):
        return b
    texts, sizes, kept = b.column("text").to_pylist(), b.column("n_chars").to_pylist(), np.ones(b.num_rows, bool)
    for i, x in zip(dirty, cut_spans([texts[i] for i in dirty], w), strict=True):
        texts[i], sizes[i], kept[i] = x, len(x), any(c.isalnum() for c in x)
    names = b.schema.names
    new = {"text": pa.array(texts, b.column("text").type), "n_chars": pa.array(sizes, pa.int64())}
    return pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names).filter(pa.array(kept))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_bytes: int = 16 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of documents with all benchmark windows cut out of their texts, and n_chars to match.

    Texts without a match stay as they are; a row whose text has no word left after a cut
    goes. A cut text is searched again until nothing matches, as in cut_spans(); a benchmark
    in several blocks is cut as one block is, see _decontaminate_in_blocks().
    """
    n = block_count(bench, block_bytes)
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    if n > 1:
        return _decontaminate_in_blocks(docs, bench, n, window, shard_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(block(bench, 0, 1, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for t in _shards(batches, shard_bytes):
            hit, at, _ = matches(t.column("text").chunks, w)
            dirty, first = _hits(hit, at) > 0, 0
            for b in t.to_batches():
                yield _cut(b, np.flatnonzero(dirty[first : first + b.num_rows]), w)
                first += b.num_rows

    return docs.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")


def _hit_words(rows: DataFrame, bench: DataFrame, k: int, n: int, window: int, shard_bytes: int) -> DataFrame:
    """(row, spots): the places of words that block k of n hits, of rows that have any."""
    sent = rows.sparkSession.sparkContext.broadcast(block(bench, k, n, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for t in _shards(batches, shard_bytes):
            hit, at, _ = matches(t.column("text").chunks, w)
            some = np.flatnonzero([hit[a:b].any() for a, b in zip(at[:-1], at[1:], strict=True)])
            spots = [np.flatnonzero(hit[at[i] : at[i + 1]]).tolist() for i in some]
            yield pa.RecordBatch.from_arrays([_column(t, "row").take(pa.array(some)), pa.array(spots, pa.list_(pa.int64()))], ["row", "spots"])

    found = stored(rows.select("row", "text").mapInArrow(run, "row long, spots array<long>"), "decontamination")
    sent.destroy()
    return found


def _decontaminate_in_blocks(docs: DataFrame, bench: DataFrame, n: int, window: int, shard_bytes: int) -> DataFrame:
    """In each round the words that any block hits are found first and then cut together; cut texts go to the next round."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches):
            texts = []
            for raw, spots in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spots").to_pylist(), strict=True):
                s, e, _ = W.spans(W.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), W.ALNUM)
                hit = np.zeros(len(s), bool)
                hit[spots] = True
                texts.append(_without(raw, s, e, hit))
            words = pa.array([any(c.isalnum() for c in x) for x in texts], pa.bool_())
            yield pa.record_batch([b.column("row"), pa.array(texts, pa.string()), words], ["row", "text", "words"])

    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "decontamination")
    todo, rounds = rows, []
    while True:
        hits = _hit_words(todo, bench, 0, n, window, shard_bytes)
        for k in range(1, n):
            hits = hits.union(_hit_words(todo, bench, k, n, window, shard_bytes))
        if hits.isEmpty():
            break
        spots = hits.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("spots"))).alias("spots"))
        todo = stored(todo.select("row", "text").join(spots, "row").mapInArrow(cut, "row long, text string, words boolean"), "decontamination")
        rounds.append(todo.withColumn("round", F.lit(len(rounds))))
    if not rounds:
        return rows.drop("row")
    every = rounds[0]
    for x in rounds[1:]:
        every = every.union(x)
    last = every.groupBy("row").agg(F.max_by(F.struct("text", "words"), "round").alias("new"))
    whole = rows.join(last, "row", "left").filter("new is null or new.words")
    text = F.when(F.col("new").isNotNull(), F.col("new.text")).otherwise(F.col("text"))
    size = F.when(F.col("new").isNotNull(), F.length("new.text").cast("long")).otherwise(F.col("n_chars"))
    return whole.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: DuckDB SQL of query(): windows of each length that items have, met by equality.
ORACLE = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, list_aggregate(w[k:k + least(len(w), {WINDOW}) - 1], 'string_agg', ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT r, k, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, k, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
