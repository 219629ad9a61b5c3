"""Token-ID / binary output: documents as ids in plane files, and back.

Documents are range-partitioned and sorted by doc_id; each task encodes its texts and writes
files of about ``file_ids`` ids (``planes``). The files are rows of a Parquet table in the
shared folder, so that Spark commits them: a task that is lost and run again leaves nothing
behind, and any store that Spark knows will do. ``export`` puts them out as single files.

Encoding splits a text into the tokenizer's own pre-tokens and encodes each distinct one
once, by the tokenizers library, while it is remembered; many new ones are encoded as one
string and told apart by their bytes. Texts with characters whose classes differ between the
two pattern libraries are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import planes
from . import words as W
from .common import partitions, stored, table

CACHE = 300_000  #: pre-tokens and stretches between spaces that an encoder remembers beyond those of a batch
CHUNK = 100  #: of them that are encoded as one string
PIECE = 1 << 20  #: bytes of texts that are split together: memory grows with it, ids do not depend on it
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False
_CLASS = np.zeros(256, np.uint8)  # 0 marks and controls, 1 letters (beyond ASCII those of two bytes up to U+023F), 2 digits, 3 white space
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]], _CLASS[0x30:0x3A], _CLASS[[0x20, *range(0x09, 0x0E)]] = 1, 2, 3
_WHOLE = np.zeros(256, bool)  # bytes of stretches that these classes can't split: apostrophes (contractions) and all other characters
_WHOLE[0x27] = _WHOLE[0xC0:0xC3] = _WHOLE[0xC9:] = True
_SEPARATORS = re.compile("[\x1c-\x1f]")  #: the ASCII characters of _unlike()
_WORD = re.compile(rb" (?:[A-Za-z]|[\xc4-\xc8][\x80-\xbf]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Of a token, in byte-level characters (U+0120 is a space): it runs on from the end of a _WORD into a space.
_INTO_SPACE = re.compile("(?:[A-Za-z]|(?<!\u00c2)[\u00a1-\u00bf\u0122-\u0143])\u0120")
_TWO_SPACES = re.compile(r"\s\s")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _unlike() -> re.Pattern:
    """Characters up to U+FFFF that Python's \\w, \\d and \\s put elsewhere than Unicode's letters, numbers and white space do."""
    odd = [c for c in map(chr, range(0x10000)) if (k := unicodedata.category(c)) in ("Nl", "No") or c.isspace() != (k in ("Zs", "Zl", "Zp") or c in "\t\n\v\f\r\x85") or (c.isalnum() != (k[0] in "LN")) or (k == "Nd") != c.isdecimal() or k in ("Cn", "Co", "Cs")]
    spans: list[list[int]] = []
    for c in map(ord, odd):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans) + "]")


def _parts(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all stretches between spaces, plain ones cut where the class of their bytes changes."""
    s, e, _ = W.spans(flat, offs, _NOT_BLANK)
    if not len(s):
        return s, e
    kind, inside = _CLASS[flat], _NOT_BLANK[flat]
    whole = _WHOLE[flat]
    whole[:-1] |= (flat[:-1] == 0xC3) & ((flat[1:] == 0x97) | (flat[1:] == 0xB7))  # two marks among the letters
    whole = np.concatenate([[0], np.cumsum(whole, dtype=np.int64)])
    whole = whole[e] > whole[s]
    cut = np.flatnonzero((kind[1:] != kind[:-1]) & inside[1:] & inside[:-1]) + 1
    cut = cut[~whole[np.searchsorted(s, cut, "right") - 1]]
    first, last = np.zeros(len(flat), bool), np.zeros(len(flat) + 1, bool)
    first[s] = first[cut] = last[e] = last[cut] = True
    return np.flatnonzero(first), np.flatnonzero(last)


def _begins(part: bytes, at: int) -> bool:
    """Whether a character other than white space is there."""
    return len(part) > at and (0x20 < part[at] < 0x7F or part[at] > 0x7F and not part.decode()[at].isspace())


class Encoder:
    """encode(text) and batch(column): ids of the tokenizer, each distinct part of a text encoded once while remembered."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # of each id: a byte-level token has a character for each byte
        self.n_bytes[list(vocab.values())] = [len(x) for x in vocab]
        self.unsplit = Tokenizer(self.whole.model)
        self.unsplit.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.apart = not any(_INTO_SPACE.search(x) for x in vocab)
        self.unlike = _unlike()
        self.known: dict[bytes, bytes] = {}  # pre-tokens and stretches
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]

    def odd(self, text: str) -> bool:
        """Whether pre-tokens can't be found here as the tokenizer finds them."""
        if any(x in text for x in self.special):
            return True
        if text.isascii():
            return _SEPARATORS.search(text) is not None
        return len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text) or self.unlike.search(text) is not None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.odd(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        parts = [x.encode() for x in _SPLIT.findall(text)]
        self._learn(set(parts))
        return b"".join([self.known[x] for x in parts])

    def _learn(self, parts: Collection[bytes]) -> None:
        """Makes the ids of all parts, each a pre-token or several of them, known.

        New parts follow each other in strings of CHUNK parts. A pre-token never runs on into
        a space or a line feed and what follows it, so a part that begins with neither a
        space nor white space gets a line feed before it, whose id is dropped.
        """
        known = self.known
        if len(known) > CACHE:  # only a cache: what goes is encoded again
            self.known = known = {x: known[x] for x in parts if x in known}
        new = [x for x in parts if x not in known]
        if not new:
            return
        words = [x for x in new if _WORD.fullmatch(x)] if self.apart else []  # pre-tokens that no token leaves: joined, they need not be split again
        rest = [*set(new).difference(words)]
        spaced = [x for x in rest if x[0] == 0x20 and _begins(x, 1)]
        plain = [x for x in rest if x[0] != 0x20 and _begins(x, 0)]
        single = [x for x in rest if not _begins(x, x[0] == 0x20)]
        new = words + spaced + plain + single
        strings = [(b"\n" + b"\n".join(plain[i : i + CHUNK])).decode() for i in range(0, len(plain), CHUNK)]
        strings = [b"".join(spaced[i : i + CHUNK]).decode() for i in range(0, len(spaced), CHUNK)] + strings + [x.decode() for x in single]
        unsplit = [b"".join(words[i : i + CHUNK]).decode() for i in range(0, len(words), CHUNK)]
        found = self.unsplit.encode_batch_fast(unsplit, add_special_tokens=False) + self.whole.encode_batch_fast(strings, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
        drop = np.repeat([0, 1, 0], [len(words) + len(spaced), len(plain), len(single)])
        ends, to = np.cumsum(self.n_bytes[ids]), np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + drop)
        at = np.searchsorted(ends, to) + 1
        if at[-1] != len(ids) or (ends[at - 1] != to).any():  # not a byte-level tokenizer as it should be
            known.update((x, array("I", self.whole.encode(x.decode(), add_special_tokens=False).ids).tobytes()) for x in new)
            return
        raw, begin = ids.tobytes(), np.concatenate([[0], at[:-1]]) + drop
        known.update(zip(new, [raw[i:j] for i, j in zip((4 * begin).tolist(), (4 * at).tolist(), strict=True)], strict=True))

    def _alone(self, flat: np.ndarray, raw: bytes, offs: np.ndarray) -> np.ndarray:
        """Which texts are odd, end with a space or have neighbouring white space: ASCII ones are told by their bytes."""
        n = len(offs) - 1
        full = offs[1:] > offs[:-1]

        def has(hit: np.ndarray) -> np.ndarray:
            out = np.zeros(n, bool)
            out[np.searchsorted(offs, np.flatnonzero(hit), "right") - 1] = True
            return out

        white = _CLASS[flat] == 3
        two = white[1:] & white[:-1]
        two[offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(flat))] - 1] = False  # of two texts
        alone = has(two) | has((flat >= 0x1C) & (flat <= 0x1F))
        alone[full] |= flat[offs[1:][full] - 1] == 0x20
        rest = has(flat >= 0x80)
        if any(x.encode() in raw for x in self.special):
            rest |= full
        for i in np.flatnonzero(rest & ~alone):
            t = raw[offs[i] : offs[i + 1]].decode()
            alone[i] = _TWO_SPACES.search(t) is not None or self.odd(t)
        return alone

    def batch(self, column: pa.Array, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, each text closed by end_id, and each text's number of ids.

        Where no white space neighbours another, each pre-token begins at or after a space, so
        the stretches between spaces can be encoded one by one. Plain stretches (Latin
        letters, ASCII otherwise, no apostrophes) are cut further, where the class of their bytes
        changes, which gives their pre-tokens. Equal parts are found by a 64-bit hash and compared byte by byte; texts with
        a part whose hash is another's, and texts with neighbouring white space, are encoded by
        themselves.
        """
        flat, offs = W.flat_bytes(column)
        raw, n_texts = flat.tobytes(), len(column)
        alone = self._alone(flat, raw, offs)
        s, e = _parts(flat, offs)
        h = W.hashes(flat, s, e)
        doc = np.searchsorted(offs, s, "right") - 1
        start = (s != offs[doc]) & ~_NOT_BLANK[flat[s - 1]]
        s = s - start  # the space before belongs to a part, but at a text's start
        h[start] = W.mix(h[start])
        while True:
            keep = ~alone[doc]
            s, e, h, doc = s[keep], e[keep], h[keep], doc[keep]
            unit = pd.factorize(h)[0]
            where = np.zeros(unit.max(initial=-1) + 1, np.int64)
            where[unit[::-1]] = np.arange(len(unit))[::-1]  # the first of each hash
            first, n = where[unit], e - s
            same = (n == n[first]) & (start[keep] == start[keep][first])
            long = np.flatnonzero(same & (n > 7))  # hashes of words of seven bytes at most are all different
            same[long] = W.equal(flat, s[long], e[long], flat, s[first[long]], e[first[long]])
            if same.all():
                break
            alone[doc[~same]] = True
            start = start[keep]
        keys = [raw[a:b] for a, b in zip(s[where].tolist(), e[where].tolist(), strict=True)]
        self._learn(dict.fromkeys(keys))
        bits = [*map(self.known.__getitem__, keys)]
        bits += [self.encode(raw[offs[i] : offs[i + 1]].decode()) for i in np.flatnonzero(alone)] + [np.array([end_id], "<u4").tobytes()]
        # each text's units: its parts, or the unit of the whole text, and the end
        ends = np.searchsorted(doc, np.arange(n_texts), "right")
        places, values = np.repeat(ends, 1 + alone), np.full(n_texts + int(alone.sum()), len(bits) - 1)
        values[np.flatnonzero(alone) + np.arange(int(alone.sum()))] = len(keys) + np.arange(int(alone.sum()))
        unit = np.insert(unit, places, values)
        size = np.fromiter(map(len, bits), np.int64, len(bits)) // 4
        begin = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(bits), "<u4")[np.repeat(begin[unit], size[unit]) + W.runs(size[unit])]
        units = np.diff(np.concatenate([[0], ends])) + 1 + alone
        return ids, np.add.reduceat(size[unit], np.cumsum(units) - units) if n_texts else size[:0]


_ENCODERS: dict[str | None, Encoder] = W.kept()


def encoder_of(path: str | None) -> Encoder:
    """This process's encoder for a tokenizer: tasks that a worker runs one after another share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_files(docs: DataFrame, tokenizer: str | None = None, kind: str = "byte", file_ids: int = 1 << 22) -> DataFrame:
    """The stored table of files: part, seq (their order), n_ids, n_docs, data.

    docs: doc_id, text. Each document's ids end with 0. Rows of one doc_id follow each other
    in the order of a hash of their texts; null ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(spark) * 2, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer)
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        seq = n = 0

        def file() -> pa.RecordBatch:
            nonlocal held, doc_ids, sizes, seq, n
            data = planes.write(np.concatenate(held), doc_ids, sizes, kind)
            out = pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (n, pa.int64()), (len(sizes), pa.int64()), (data, pa.binary()))], ["part", "seq", "n_ids", "n_docs", "data"])
            held, doc_ids, sizes, seq, n = [], [], [], seq + 1, 0
            return out

        for b in W.pieces(batches, max_bytes=PIECE, keep=_ENCODERS):
            ids, size = encoder.batch(b.column("text"))
            held.append(ids)
            doc_ids += b.column("doc_id").to_pylist()
            sizes += size.tolist()
            n += len(ids)
            if n >= file_ids:
                yield file()
        if held:
            yield file()

    return stored(rows.mapInArrow(run, "part int, seq int, n_ids long, n_docs long, data binary"), "tokens")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = planes.Reader(b.column("data")[k].as_buffer())
                ends = np.cumsum(r.sizes)
                ids = memoryview(r.ids().tobytes())
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), r.sizes.tolist(), strict=True)]
                yield pa.record_batch([
                    pa.array([b.column("part")[k].as_py()] * len(crc), pa.int32()), pa.array([b.column("seq")[k].as_py()] * len(crc), pa.int32()),
                    pa.array(r.doc_ids, pa.int64()), pa.array(ends - r.sizes), pa.array(r.sizes), pa.array(crc, pa.int64()),
                ], ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "data").mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)))
    each = files.select("part", "seq", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("seq")), F.lit(0)))
    starts = each.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("at"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("at") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, tokenizer: str | None = None, kind: str = "byte", file_ids: int = 1 << 22) -> DataFrame:
    """Writes docs' ids in ascending doc_id order and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null text is empty: its ids are the end id alone. Rows that repeat are written as often
    as they occur; null ids come first; an empty table gives no file and an empty result;
    columns beyond doc_id and text are ignored.
    """
    return read_files(write_files(docs.select(F.col("doc_id").cast("long"), "text"), tokenizer, kind, file_ids))


def export(files: DataFrame, folder: str) -> None:
    """The files as single files part-seq.hxpl of a local folder (for one machine)."""
    os.makedirs(folder, exist_ok=True)
    for r in files.toLocalIterator():
        with open(f"{folder}/{r.part:06d}-{r.seq:06d}.hxpl", "wb") as f:
            f.write(r.data)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))
