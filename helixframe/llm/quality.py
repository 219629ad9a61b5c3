"""Quality classifier: Bradley-Terry pairwise ranking over text statistics.

Each preference pair (a text labelled 1, a text labelled 0) gives a logistic loss on the
difference of their feature vectors; the fitted weights score single texts. The cut is a
quantile of the training scores: the share labelled 0. A text's score is the probability of
preferring it to the text at that quantile, with odds shifted so that the cut lies at the
threshold.

Training takes every labelled document, and every pair of them, by Newton steps. A step
reads the stored feature vectors twice: once for how the current scores of either label are
spread, once for gradient and Hessian. What a text meets in all texts of the other label
depends on its score alone, so it is tabulated over a grid of scores (``STEP`` apart, cubic
interpolation: errors below 1e-7 of a pair's loss), and no pair is ever listed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as W
from .common import id_mod, remove, stored, table

#: Printable ASCII that is neither letter, digit nor space.
MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]

_LINE = np.ones(256, dtype=bool)
_LINE[[0x0A, 0x0D]] = False
_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 upper, 2 lower or beyond ASCII, 3 digit, 4 white space, 5.. marks
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x80:], _KIND[0x30:0x3A], _KIND[~W.NOT_SPACE] = 1, 2, 2, 3, 4
_KIND[MARKS] = 5 + np.arange(len(MARKS))
N_KINDS = 5 + len(MARKS)
_MARK = _KIND >= 5
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = False  # marks of ordinary prose


@dataclass(frozen=True)
class BradleyTerry:
    """Parameters of the learner. max_pairs is for fit() alone: with it, that many listed pairs at most; without, all pairs."""

    max_pairs: int | None = None
    ridge: float = 1e-3
    steps: int = 30


def _share(doc: np.ndarray, hit: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(doc, weights=hit, minlength=n) / np.maximum(of, 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text; an empty text has zeros throughout."""
    flat, offs = W.flat_bytes(column)
    n, size = len(column), np.diff(offs)
    kinds = np.empty((n, N_KINDS))
    for i in range(n):
        kinds[i] = np.bincount(_KIND[flat[offs[i] : offs[i + 1]]], minlength=N_KINDS)
    s, e, at = W.spans(flat, offs, W.NOT_SPACE)
    doc, length, count = np.repeat(np.arange(n), np.diff(at)), (e - s).astype(float), np.diff(at)
    h = W.hashes(W.LOWER[flat], s, e)
    first, last = (flat[s], flat[e - 1]) if len(s) else (flat[:0], flat[:0])
    upper = (_KIND[first] == 1) & (_KIND[flat[np.minimum(s + 1, e - 1)]] == 1) & (length > 1) if len(s) else np.zeros(0, bool)
    ls, le, lat = W.spans(flat, offs, _LINE)
    lines, ldoc = np.diff(lat), np.repeat(np.arange(n), np.diff(lat))
    lh = W.hashes(flat, ls, le)

    def repeated(doc, h, of):
        if not len(h):
            return np.zeros(n)
        o = np.lexsort((h, doc))
        again = np.zeros(len(h))
        again[1:] = (h[o][1:] == h[o][:-1]) & (doc[o][1:] == doc[o][:-1])
        return _share(doc[o], again, n, of)

    mean = _share(doc, length, n, count)
    return np.column_stack([
        np.sqrt(kinds / np.maximum(size, 1)[:, None]),
        np.log1p(count), mean, np.sqrt(np.maximum(0, _share(doc, length**2, n, count) - mean**2)),
        _share(doc, upper, n, count), _share(doc, _MARK[last], n, count), _share(doc, _MARK[first], n, count),
        _share(doc, (length == 1) & (_KIND[first] >= 5) if len(s) else length, n, count),
        repeated(doc, h, count), repeated(ldoc, lh, lines), np.log1p(count / np.maximum(lines, 1)),
    ])


N_FEATURES = N_KINDS + 10
PIECE = 1 << 20  #: bytes of texts whose words are looked at together: memory grows with it, results do not depend on it


STEP = 1 / 16  #: between the grid's scores
BINS = 1 << 15  #: in which a quantile is looked for at a time

#: total(f, size): the sum of f(x, y), a vector of that size, over all batches of training rows.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray], int], np.ndarray]


def _weights(s: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """The first of the four places of a grid (its second place is low) around each score, and the places' cubic weights."""
    u = (s - low) / STEP
    i = np.floor(u).astype(np.int64)
    t = u - i
    return i, np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6])


def _places(low: float, high: float) -> int:
    return math.ceil((high - low) / STEP) + 5


def _spread(s: np.ndarray, values: np.ndarray, low: float, n: int) -> np.ndarray:
    """Rows of values, each dealt to the four places around its score: n rows."""
    out = np.zeros((n, values.shape[1]))
    if len(s):
        o = np.argsort(s)
        i, w = _weights(s[o], low)
        first = np.flatnonzero(np.diff(i, prepend=-1))
        for k in range(4):
            out[i[first] + k] += np.add.reduceat(values[o] * w[k][:, None], first)
    return out


def _read(grid: np.ndarray, s: np.ndarray, low: float) -> np.ndarray:
    i, w = _weights(s, low)
    return sum(w[k] * grid[i + k] for k in range(4))


def _standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / np.where(std > 0, std, 1), -8, 8)


def _newton(total: Total, z: Callable[[np.ndarray], np.ndarray], w: np.ndarray, pairs: float, p: BradleyTerry) -> np.ndarray:
    """One Newton step from w for the loss over all pairs."""
    far = 8 * float(np.abs(w).sum())
    n = _places(-far, far)

    def sides(x, y):
        s = z(x) @ w
        return np.concatenate([_spread(s[y == v], np.ones((int((y == v).sum()), 1)), -far, n)[:, 0] for v in (1, 0)])

    spread = total(sides, 2 * n).reshape(2, n)
    used = np.flatnonzero(spread.any(0))
    i = max(0, int(used[0]) - 3)  # places of weight 0 belong to it
    n = min(n, int(used[-1]) + 4) - i
    good, bad = spread[:, i : i + n]
    low = -far + i * STEP
    apart = np.clip(STEP * np.arange(1 - n, n), -700, 700)
    q = 1 / (1 + np.exp(apart))  # a pair's loss is -log(1 - q) where the text labelled 1 scores so much higher
    grids = np.stack([np.convolve(v, k)[n - 1 : 2 * n - 1] for v, k in ((bad, q), (good, -q[::-1]), (bad, q * (1 - q)), (good, q * (1 - q)))])
    m, d = 2 * n, len(w)

    def slopes(x, y):
        v, known = z(x), (y == 1) | (y == 0)
        v, y = v[known], y[known]
        s = v @ w
        g, h = (np.where(y == 1, _read(grids[k], s, low), _read(grids[k + 1], s, low)) for k in (0, 2))
        around = [_spread(s[y == c], v[y == c], low, n).ravel() for c in (1, 0)]
        return np.concatenate([v.T @ g, ((v * h[:, None]).T @ v).ravel(), *around])

    got = total(slopes, d + d * d + m * d)
    zg, zb = got[d + d * d :].reshape(2, n, d)
    near = np.stack([np.convolve(c, q * (1 - q))[n - 1 : 2 * n - 1] for c in zb.T], 1)
    cross = zg.T @ near
    hessian = got[d : d + d * d].reshape(d, d) - cross - cross.T + p.ridge * pairs * np.eye(d)
    return np.linalg.solve(hessian, got[:d] - p.ridge * pairs * w)


def _quantile(total: Total, s: Callable[[np.ndarray], np.ndarray], n: int, share: float, far: float) -> float:
    """The quantile (between ranks: in proportion) of all n rows' scores, which are at most far from 0."""
    place = (n - 1) * share
    ranks = (math.floor(place), math.ceil(place))
    ends = [(-far - 1, far + 1)] * 2
    for _ in range(3):
        edges = [np.linspace(*x, BINS + 1) for x in ends]

        def counts(x, y):
            v = s(x)
            return np.concatenate([np.bincount(np.searchsorted(e, v, "right"), minlength=BINS + 2) for e in edges]).astype(float)  # noqa: B023

        got = total(counts, 2 * (BINS + 2)).reshape(2, -1).cumsum(1)
        at = [int(np.searchsorted(c, k, "right")) for c, k in zip(got, ranks, strict=True)]
        ends = [(float(e[i - 1]), float(e[i])) for e, i in zip(edges, at, strict=True)]
    return ends[0][0] + (ends[1][0] - ends[0][0]) * (place - ranks[0])


def learn(total: Total, p: BradleyTerry) -> dict:
    """Weights for standardised features over all pairs, and the training score at the cut.

    With one label only there is no pair, and all weights are zero.
    """
    head = total(lambda x, y: np.concatenate([[len(y), (y == 1).sum(), (y == 0).sum()], x.sum(0)]), 3 + N_FEATURES)
    n, good, bad = (int(c) for c in head[:3])
    if not n:
        return {"mean": np.zeros(N_FEATURES), "std": np.ones(N_FEATURES), "w": np.zeros(N_FEATURES), "cut": 0.0}
    mean = head[3:] / n
    std = np.sqrt(total(lambda x, y: ((x - mean) ** 2).sum(0), N_FEATURES) / n)
    std[std < 1e-9 * np.abs(mean)] = 0  # a constant, but for rounding
    z, w = (lambda x: _standard(x, mean, std)), np.zeros(N_FEATURES)
    if not (good and bad):
        return {"mean": mean, "std": std, "w": w, "cut": 0.0}
    for _ in range(p.steps):
        step = _newton(total, z, w, good * bad, p)
        w = w + step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return {"mean": mean, "std": std, "w": w, "cut": _quantile(total, lambda x: z(x) @ w, n, bad / n, 8 * float(np.abs(w).sum()))}


def fit(x: np.ndarray, y: np.ndarray, p: BradleyTerry) -> dict:
    """learn() from rows in memory. With max_pairs the pairs are listed instead.

    Listed pairs take each text of the rarer label as often as the bound allows, each time
    with another text of the other label, in the order given.
    """
    if p.max_pairs is None:
        return learn(lambda f, size: f(x, y) if len(y) else np.zeros(size), p)
    mean, std = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    z = _standard(x, mean, std)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(z.shape[1])
    if len(good) and len(bad):
        k = np.arange(max(len(good), len(bad), min(p.max_pairs, 8 * max(len(good), len(bad))))) [: p.max_pairs]
        d = z[good[k % len(good)]] - z[bad[(k * 7919 + k // len(good)) % len(bad)]]
        ridge = p.ridge * len(d) * np.eye(len(w))
        for _ in range(p.steps):
            q = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
            step = np.linalg.solve((d * (q * (1 - q))[:, None]).T @ d + ridge, d.T @ q - ridge @ w)
            w += step * min(1, 5 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-4:
                break
    cut = float(np.quantile(z @ w, len(bad) / len(y))) if len(y) else 0.0
    return {"mean": mean, "std": std, "w": w, "cut": cut}


def total_of(rows: DataFrame) -> Total:
    """Sums over a table of y and x (a vector's bytes), always in the same order; tasks' sums meet in groups before the driver."""
    spark, tasks = rows.sparkSession, rows.rdd.getNumPartitions()
    groups = math.isqrt(max(tasks - 1, 0)) + 1

    def total(f, size: int) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            out = np.zeros(size)
            for b in batches:
                out += f(W.flat_bytes(b.column("x"))[0].view("<f8").reshape(-1, N_FEATURES), b.column("y").to_numpy(zero_copy_only=False))
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "v"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = sorted(r for b in batches for r in zip(b.column("part").to_pylist(), b.column("v").to_pylist(), strict=True))
            if got:
                out = sum((np.frombuffer(v) for _, v in got), np.zeros(size))
                yield pa.record_batch([pa.array([got[0][0]], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "v"])

        sums = rows.mapInArrow(each, "part int, v binary")
        if groups > 4:
            sums = sums.repartition(groups, F.col("part") % groups).mapInArrow(meet, "part int, v binary")
        return sum((np.frombuffer(r.v) for r in sorted(sums.collect())), np.zeros(size))

    return total


def train(docs: DataFrame, labels: DataFrame, p: BradleyTerry = BradleyTerry()) -> dict:
    """docs: doc_id, text. labels: doc_id, quality; null labels are left out, the least of repeated ones counts.

    Of documents that share a labelled doc_id, the one whose text is least by a hash is
    learned. All pairs count, whatever p.max_pairs says.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    texts = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, max_bytes=PIECE):
            x = features(b.column("text")).astype("<f8")
            yield pa.record_batch([b.column("doc_id"), b.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "h", "x"])

    # vectors are shuffled, not texts: a few hundred bytes a document
    each = texts.mapInArrow(extract, "doc_id long, h long, x binary").groupBy("doc_id").agg(F.min_by("x", F.struct("h", "x")).alias("x"))
    rows = stored(each.join(marks, "doc_id").sortWithinPartitions("doc_id").select("y", "x"), "quality")
    model = learn(total_of(rows), p)
    remove(rows)
    return model


def score(docs: DataFrame, model: dict, threshold: float, keep: str = "doc_id long, held_out boolean") -> DataFrame:
    """The kept columns and the score of every row of docs."""
    names = [x.split()[0] for x in keep.split(", ")]
    shift = np.log(threshold / (1 - threshold))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in W.pieces(batches, max_bytes=PIECE):
            x = _standard(features(b.column("text")), m["mean"], m["std"])
            s = 1 / (1 + np.exp(-np.clip(x @ m["w"] - m["cut"] + shift, -700, 700)))
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(s)], [*names, "score"])

    return docs.select(*names, *(["text"] if "text" not in names else [])).mapInArrow(run, f"{keep}, score double")


def quality(docs: DataFrame, labels: DataFrame, p: BradleyTerry = BradleyTerry(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every row.

    Labels of rows whose crc32(doc_id) mod 4 is 2 are never learned (held_out). A null text
    scores like an empty one; rows that repeat score alike; an empty table gives an empty
    result; columns beyond those named are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", (id_mod("doc_id", 4) == 2).alias("held_out"))
    model = train(docs.filter("not held_out"), labels.filter(id_mod("doc_id", 4) != 2), p)
    return score(docs, model, threshold).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, p: BradleyTerry = BradleyTerry(), threshold: float = 0.7) -> DataFrame:
    """The rows of documents (all its columns) that the classifier doesn't reject.

    Labels are learned as in quality(). Rows reach Python once, with all their columns. A null
    text scores like an empty one; rows that repeat stay or go alike; an empty table gives an
    empty result; columns beyond the five of documents are dropped.
    """
    model = train(docs.select(F.col("doc_id").cast("long"), "text").filter(id_mod("doc_id", 4) != 2), labels.filter(id_mod("doc_id", 4) != 2), p)
    keep = "doc_id long, text string, lang string, source string, n_chars long"
    return score(docs, model, threshold, keep).filter(F.col("score") >= threshold).drop("score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
