"""A file format for token ids: fixed-size blocks, transposed into bit or byte planes.

    magic "HXPL", then for each block its planes, each one zstandard frame;
    then the index: JSON {kind, block, n, docs, at: [end of each plane], ids: [start, end],
    sizes: [start, end]} as one zstandard frame, its length as 8 little-endian bytes, magic.

All blocks hold ``block`` ids but the last. ``ids`` and ``sizes`` point at the documents'
numbers and id counts (8-byte little-endian integers, zstandard). The index makes any block
readable without the others.
"""

from __future__ import annotations

import json

import numpy as np
import zstandard

MAGIC = b"HXPL"
BLOCK = 1 << 16


def _planes(ids: np.ndarray, kind: str) -> list[bytes]:
    b = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(b[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(b, axis=1, bitorder="little")  # 32 columns
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def _joined(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def write(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int], kind: str = "byte", block: int = BLOCK, level: int = 1) -> bytes:
    """One file's bytes. A doc_id of None is stored as such."""
    c = zstandard.ZstdCompressor(level=level)
    out, at, end = [MAGIC], [], len(MAGIC)

    def put(raw: bytes) -> list[int]:
        nonlocal end
        out.append(c.compress(raw))
        end += len(out[-1])
        return [end - len(out[-1]), end]

    for i in range(0, len(ids), block):
        at += [put(p)[1] for p in _planes(ids[i : i + block], kind)]
    index = {"kind": kind, "block": block, "n": len(ids), "docs": len(sizes), "none": [k for k, x in enumerate(doc_ids) if x is None], "at": at}
    index["ids"] = put(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    index["sizes"] = put(np.array(sizes, "<i8").tobytes())
    tail = c.compress(json.dumps(index).encode())
    return b"".join([*out, tail, len(tail).to_bytes(8, "little"), MAGIC])


class Reader:
    """Random access to a file's bytes."""

    def __init__(self, data: bytes):
        self.data, self.zstd = memoryview(data), zstandard.ZstdDecompressor()
        if bytes(self.data[:4]) != MAGIC or bytes(self.data[-4:]) != MAGIC:
            raise ValueError("not a plane file")
        n = int.from_bytes(self.data[-12:-4], "little")
        self.index = json.loads(self.zstd.decompress(self.data[-12 - n : -12]))
        self.sizes = np.frombuffer(self._get(*self.index["sizes"]), "<i8")
        self.doc_ids: list[int | None] = np.frombuffer(self._get(*self.index["ids"]), "<i8").tolist()
        for k in self.index["none"]:
            self.doc_ids[k] = None

    def _get(self, a: int, b: int) -> bytes:
        return self.zstd.decompress(self.data[a:b])

    def block(self, k: int) -> np.ndarray:
        n = min(self.index["block"], self.index["n"] - k * self.index["block"])
        w = 4 if self.index["kind"] == "byte" else 32
        ends = [4, *self.index["at"]][k * w : (k + 1) * w + 1]
        return _joined([self._get(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)], n, self.index["kind"])

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from start to end; only the blocks they lie in are read."""
        end, size = self.index["n"] if end is None else end, self.index["block"]
        if end <= start:
            return np.zeros(0, np.uint32)
        got = np.concatenate([self.block(k) for k in range(start // size, (end - 1) // size + 1)])
        return got[start - start // size * size :][: end - start]
