"""Words of Arrow string batches, found and hashed with whole-array numpy operations.

A batch's texts lie end to end in one byte array. Words are found with a byte table, so no
Python object is made for a word, and time is a few nanoseconds a byte whatever the lengths.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 512  #: bytes of a word that are hashed eight at a time
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of ``[^\x20\x09-\x0D]+`` in UTF-8.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in UTF-8, after A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and len+1 offsets into them; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def give_back() -> None:
    """Returns memory that this process has freed to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)


_KEPT: list[dict] = []


def kept() -> dict:
    """A dictionary that a worker keeps from task to task, until pieces() begins for tasks that don't use it."""
    _KEPT.append({})
    return _KEPT[-1]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20, keep: dict | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have at most max_bytes, or one text: memory doesn't grow with a batch.

    keep: what the task uses of kept().
    """
    if old := [x for x in _KEPT if x and x is not keep]:
        for x in old:
            x.clear()
        give_back()
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i, done = 0, 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, done + max_bytes, "right")))
            yield b.slice(i, j - i)
            i, done = j, int(size[j - 1])
    give_back()


def spans(flat: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and len(texts)+1 offsets into the words."""
    w = inside[flat]
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = offs[1:] > offs[:-1]
    at, to = offs[:-1][full], offs[1:][full] - 1
    first[at], last[to] = w[at], w[to]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on all others."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _lanes(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of flat on, as little-endian numbers; zeros follow its end."""
    return np.ndarray((len(flat) + 1,), "<u8", np.concatenate([flat, np.zeros(8, np.uint8)]), strides=(1,))


def hashes(flat: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: the same for the same bytes in any batch.

    Different words may share a hash (not if both have seven bytes at most): where that
    matters, ``equal`` tells.
    """
    lanes, n = _lanes(flat), e - s
    h = lanes[s] & _MASK[np.minimum(n, 8)]
    with np.errstate(over="ignore"):
        h = mix(np.where(n < 8, h | n.astype(np.uint64) << np.uint64(56), mix(h + _BASE) + n.astype(np.uint64)))
        long = n > LONG
        todo, k = np.flatnonzero((n > 8) & ~long), 8
        while len(todo):
            h[todo] = mix((h[todo] ^ (lanes[s[todo] + k] & _MASK[np.minimum(n[todo] - k, 8)])) * _BASE)
            k += 8
            todo = todo[n[todo] > k]
    for i in np.flatnonzero(long):
        h[i] = int.from_bytes(hashlib.blake2b(flat[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def equal(flat: np.ndarray, s: np.ndarray, e: np.ndarray, other: np.ndarray, os: np.ndarray, oe: np.ndarray) -> np.ndarray:
    """Whether flat[s:e] and other[os:oe] hold the same bytes, pair by pair."""
    n = e - s
    same = n == oe - os
    a, b = _lanes(flat), _lanes(other)
    todo, k = np.flatnonzero(same), 0
    while len(todo) and k < LONG:
        differ = ((a[s[todo] + k] ^ b[os[todo] + k]) & _MASK[np.minimum(n[todo] - k, 8)]) != 0
        same[todo[differ]] = False
        k += 8
        todo = todo[~differ & (n[todo] > k)]
    for i in todo:
        same[i] = np.array_equal(flat[s[i] + k : e[i]], other[os[i] + k : oe[i]])
    return same


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. n-1 for each n of counts, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
