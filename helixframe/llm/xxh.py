"""XXH64 of many byte spans at once, after the public specification of that hash.

Spans of one length are hashed together by whole-array operations; the few that are longer
than ``LONG`` go through the xxhash library one by one.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: The five primes of the XXH64 specification (fixed values).
P1, P2, P3, P4, P5 = (
    _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x85EBCA77C2B2AE63), _U(0x27D4EB2F165667C5),
)
LONG = 192


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def _same_length(b8: np.ndarray, b4: np.ndarray, b1: np.ndarray, s: np.ndarray, n: int, seed: int) -> np.ndarray:
    """b8, b4, b1: the buffer's 8-, 4- and 1-byte values at every byte offset."""
    at, seed = 0, _U(seed)
    if n >= 32:
        v = [np.full(len(s), seed + P1 + P2), np.full(len(s), seed + P2), np.full(len(s), seed), np.full(len(s), seed - P1)]
        while at + 32 <= n:
            v = [_round(x, b8[s + (at + 8 * i)]) for i, x in enumerate(v)]
            at += 32
        h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for x in v:
            h = (h ^ _round(_U(0), x)) * P1 + P4
    else:
        h = np.full(len(s), seed + P5)
    h = h + _U(n)
    while at + 8 <= n:
        h = _rot(h ^ _round(_U(0), b8[s + at]), 27) * P1 + P4
        at += 8
    if at + 4 <= n:
        h = _rot(h ^ (b4[s + at].astype(_U) * P1), 23) * P2 + P3
        at += 4
    while at < n:
        h = _rot(h ^ (b1[s + at].astype(_U) * P5), 11) * P1
        at += 1
    h = (h ^ (h >> _U(33))) * P2
    h = (h ^ (h >> _U(29))) * P3
    return h ^ (h >> _U(32))


def xxh64(buf: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of buf[s:e] for each pair of s and e; buf: uint8 with 8 bytes of padding at its end."""
    out = np.empty(len(s), _U)
    if not len(s):
        return out
    b8 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    b4 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    n = np.minimum(e - s, LONG + 1).astype(np.uint16)
    order = np.argsort(n, kind="stable")
    with np.errstate(over="ignore"):
        for k, part in zip(*_groups(n[order], order), strict=True):
            if k <= LONG:
                out[part] = _same_length(b8, b4, buf, s[part], int(k), seed)
            else:
                out[part] = [xxhash.xxh64_intdigest(buf[a:b], seed) for a, b in zip(s[part], e[part], strict=True)]
    return out


def _groups(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], cuts])], np.split(order, cuts)
