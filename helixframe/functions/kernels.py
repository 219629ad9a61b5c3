"""Pairwise alignment by dynamic programming, in numpy, over whole batches of pairs.

Texts lie along rows, patterns along columns. A step down uses a text symbol (a deletion, D),
a step right a pattern symbol (an insertion, I). Cells of one place are computed for all
pairs of a batch at once, so the Python loop is over cells, not over pairs.

Ties: the diagonal wins any tie it takes part in; of insertion and deletion, the insertion
wins in full matrices, the deletion in banded ones. Of equal scores the largest text end
counts, then the largest pattern end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FAR = -(1 << 28)
S, I, D, STOP = 0, 1, 2, 3


@dataclass(frozen=True)
class Scheme:
    """Scores; with ``affine`` a gap of n symbols costs gap_open + (n - 1) gap_ext, else n times its kind's cost."""

    match: int = 0
    mismatch: int = -1
    deletion: int = -1
    insertion: int = -1
    gap_open: int = 0
    gap_ext: int = 0
    affine: bool = False


EDIT = Scheme()


def smith_waterman(match: int, mismatch: int, deletion: int, insertion: int) -> Scheme:
    return Scheme(match, mismatch, deletion, insertion)


def gotoh(match: int, mismatch: int, gap_open: int, gap_ext: int) -> Scheme:
    return Scheme(match, mismatch, gap_open, gap_open, gap_open, gap_ext, True)


def _matrix(strings: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in strings], np.int64)
    out = np.full((len(strings), int(n.max(initial=0))), fill, np.int64)
    for k, s in enumerate(strings):
        out[k, : len(s)] = np.frombuffer(s.encode("utf-32-le"), "<u4")
    return out, n


def align(patterns: list[str], texts: list[str], scheme: Scheme = EDIT, mode: str = "global", band: int | None = None, trace: bool = False) -> list[dict]:
    """score, text_end, pattern_end (and with trace text_begin, pattern_begin, cigar) of each pair.

    mode: global, semi (the text's ends are free) or local. With a band, the text place may
    run ahead of the pattern place by 0 .. band-1 only. A pair without any allowed alignment
    has score None.
    """
    if not patterns:
        return []
    if mode not in ("global", "semi", "local"):
        raise ValueError(f"unknown mode {mode}")
    p, np_ = _matrix(patterns, -1)
    t, nt = _matrix(texts, -2)
    b, w, h = len(patterns), p.shape[1], t.shape[1]
    go, ge = (scheme.gap_open, scheme.gap_ext) if scheme.affine else (None, None)
    ids = np.arange(b)
    free_text = mode != "global"

    def border(k: int, one: int) -> int:
        return 0 if k == 0 else go + (k - 1) * ge if scheme.affine else k * one

    def allowed(i: int, j: int) -> bool:
        return band is None or 0 <= i - j < band

    row = np.full((w + 1, b), FAR)
    e = np.full((w + 1, b), FAR)  # ends with an insertion
    f = np.full((w + 1, b), FAR)  # ends with a deletion
    ways = np.zeros((h + 1, w + 1, b), np.uint8) if trace else None
    best, end_i, end_j = np.full(b, FAR), np.full(b, -1), np.full(b, -1)

    def sink(i: int, j: int, score: np.ndarray) -> None:
        if mode == "global":
            ok = (nt == i) & (np_ == j)
        elif mode == "semi":
            ok = (np_ == j) & (i <= nt)
        else:
            ok = (i <= nt) & (j <= np_)
        ok = ok & (score > FAR // 2) & ((score > best) | ((score == best) & ((i > end_i) | ((i == end_i) & (j > end_j)))))
        best[ok], end_i[ok], end_j[ok] = score[ok], i, j

    for i in range(h + 1):
        old, row = row, np.full((w + 1, b), FAR)
        e[:] = FAR
        for j in range(w + 1):
            if not allowed(i, j):
                f[j] = FAR
                continue
            way = np.full(b, STOP, np.uint8)
            if i == 0 or j == 0:
                if mode == "local" or (j == 0 and free_text):
                    row[j] = 0
                else:
                    row[j] = border(i, scheme.deletion) if j == 0 else border(j, scheme.insertion)
                    way[:] = D if j == 0 and i else I if j else STOP
                    way |= 12  # borders of gaps extend
                f[j] = FAR
            else:
                diag = old[j - 1] + np.where(p[:, j - 1] == t[:, i - 1], scheme.match, scheme.mismatch)
                if scheme.affine:
                    e_open, e_ext = row[j - 1] + go, e[j - 1] + ge
                    f_open, f_ext = old[j] + go, f[j] + ge
                    e[j], f[j] = np.maximum(e_open, e_ext), np.maximum(f_open, f_ext)
                    left, top = e[j], f[j]
                    bits = (e_ext > e_open).astype(np.uint8) * 4 | (f_ext > f_open).astype(np.uint8) * 8
                else:
                    left, top, bits = row[j - 1] + scheme.insertion, old[j] + scheme.deletion, 0
                gap = np.maximum(left, top)
                kind = np.where(left >= top if band is None else left > top, I, D).astype(np.uint8)
                row[j] = np.maximum(diag, gap)
                way = np.where(diag >= gap, S, kind).astype(np.uint8)
                if mode == "local":
                    zero = row[j] <= 0
                    row[j][zero] = 0
                    way[zero] = STOP
                way = way | bits
                row[j] = np.maximum(row[j], FAR)
            if trace:
                ways[i, j] = way
            sink(i, j, row[j])
    out = []
    for k in ids:
        if best[k] <= FAR // 2:
            out.append({"score": None, "text_end": None, "pattern_end": None} | ({"text_begin": None, "pattern_begin": None, "cigar": None} if trace else {}))
            continue
        r = {"score": int(best[k]), "text_end": int(end_i[k]), "pattern_end": int(end_j[k])}
        if trace:
            r |= _trace(ways[:, :, k], int(end_i[k]), int(end_j[k]), scheme.affine)
        out.append(r)
    return out


def _trace(ways: np.ndarray, i: int, j: int, affine: bool) -> dict:
    ops: list[str] = []
    state = STOP  # in a gap: its kind, while its extensions last
    while True:
        way = int(ways[i, j])
        step = state if state in (I, D) else way & 3
        if step == STOP:
            break
        if step == S:
            ops.append("M")
            i, j = i - 1, j - 1
        elif step == I:
            ops.append("I")
            state = I if affine and way & 4 and j > 1 else STOP
            j -= 1
        else:
            ops.append("D")
            state = D if affine and way & 8 and i > 1 else STOP
            i -= 1
    return {"text_begin": i, "pattern_begin": j, "cigar": run_lengths(ops[::-1])}


def run_lengths(ops: list[str]) -> str:
    out, k = [], 0
    while k < len(ops):
        n = k
        while n < len(ops) and ops[n] == ops[k]:
            n += 1
        out.append(f"{n - k}{ops[k]}")
        k = n
    return "".join(out)


def rescore(pattern: str, text: str, result: dict, scheme: Scheme) -> int:
    """The score of a traced alignment, by its CIGAR."""
    import re

    i, j, total = result["text_begin"], result["pattern_begin"], 0
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MID])", result["cigar"])):
        if op == "M":
            total += sum(scheme.match if text[i + k] == pattern[j + k] else scheme.mismatch for k in range(n))
        else:
            one = scheme.deletion if op == "D" else scheme.insertion
            total += scheme.gap_open + (n - 1) * scheme.gap_ext if scheme.affine else n * one
        i, j = i + (n if op != "I" else 0), j + (n if op != "D" else 0)
    return total


def myers(pattern: str, text: str, mode: str = "global") -> int:
    """Edit distance by bit vectors of the pattern's length: global, or semi (free text ends)."""
    m = len(pattern)
    if not m:
        return len(text) if mode == "global" else 0
    full, high = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for k, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << k
    plus, minus, score, best = full, 0, m, m
    for c in text:
        x = eq.get(c, 0)
        v = x | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = (minus | ~(d | plus)) & full, plus & d
        score += bool(up & high) - bool(down & high)
        up = (up << 1 | (mode == "global")) & full
        down = down << 1 & full
        plus, minus = (down | ~(v | up)) & full, up & v
        best = min(best, score)
    return score if mode == "global" else best


def max_gaps(scheme: Scheme, size: int, min_score: int, kind: str) -> int:
    """The most gap symbols (kind: deletion or insertion) an alignment of a pattern of this size can have."""
    top = size * scheme.match
    spare = top - min_score
    if spare < 0:
        return 0
    if scheme.affine:
        first, more = -scheme.gap_open, -scheme.gap_ext
    else:
        first = more = -(scheme.deletion if kind == "deletion" else scheme.insertion)
    if kind == "insertion":  # an inserted symbol isn't matched either
        first, more = first + scheme.match, more + scheme.match
    if spare < first:
        return 0
    return int(1 + (spare - first) // more) if more > 0 else size


def band_length(max_dist: int) -> int:
    """The least 2**k - 1 (k >= 2) that is at least 2 max_dist + 1."""
    n = 4
    while n - 1 < 2 * max_dist + 1:
        n *= 2
    return n - 1
