"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of unigrams, bigrams and gap-one skip-grams of lower-cased words,
hashed to 2**bits coordinates. FTRL keeps a learning rate for each coordinate, and its L1
term leaves few weights: only those are sent to the executors, at most 2**bits of them.

Training reads at most ``max_rows`` labelled rows, the least by a hash of doc_id, so its cost
doesn't grow with the corpus; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as W
from .common import id_mod, table

_SALT = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xAAF3C1E5D1B54A33, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner. max_rows bounds the labelled rows that it reads."""

    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 4
    max_rows: int = 10_000


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and text number of every n-gram of a batch, repeats included."""
    flat, offs = W.flat_bytes(column)
    flat = W.LOWER[flat]
    s, e, at = W.spans(flat, offs, W.ALNUM)
    h = W.hashes(flat, s, e)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    shift, idx, docs = np.uint64(64 - bits), [h >> np.uint64(64 - bits)], [doc]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, _SALT[0]), (2, _SALT[1])):
            same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
            g = (h[:-gap] * salt + h[gap:] * _SALT[2])[same] if len(same) else h[:0]
            idx.append(W.mix(g) >> shift)
            docs.append(doc[:-gap][same] if len(same) else doc[:0])
    return np.concatenate(idx).astype(np.int64), np.concatenate(docs)


def distinct_features(column: pa.Array, bits: int) -> list[np.ndarray]:
    idx, doc = features(column, bits)
    key = np.unique((doc << bits) | idx)
    return np.split(key & ((1 << bits) - 1), np.searchsorted(key, np.arange(1, len(column)) << bits))


def fit_ftrl(rows: list[tuple[int, np.ndarray]], p: Ftrl) -> tuple[np.ndarray, float]:
    """Weights and intercept after p.epochs passes over (label, coordinates) rows in order.

    The intercept is the last coordinate, without L1.
    """
    d = 1 << p.bits
    z, n = np.zeros(d + 1), np.zeros(d + 1)
    l1 = np.full(d + 1, p.l1)
    l1[d] = 0.0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, -(zi - np.sign(zi) * l1[i]) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for y, i in rows:
            i = np.append(i, d)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(d + 1))
    return w[:d], float(w[d])


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero coordinates, their weights and the intercept.

    docs: doc_id, text. labels: doc_id, toxic; null labels are left out, the largest of
    repeated labels counts. One task learns from the bounded sample; without labelled rows
    of both kinds nothing is learned and all scores are the intercept's (a half, or the
    only label's side).
    """
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)
    )
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches):
            f = distinct_features(b.column("text"), p.bits)
            yield pa.record_batch([b.column("doc_id"), b.column("y"), b.column("h"), pa.array([x.astype(np.int32) for x in f], pa.list_(pa.int32()))], ["doc_id", "y", "h", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []  # max_rows rows
        for b in batches:
            seen += zip(b.column("y").to_pylist(), (np.asarray(x.values, dtype=np.int64) for x in b.column("f")), strict=True)
        w, b0 = fit_ftrl(seen, p)
        i = np.flatnonzero(w)
        yield pa.record_batch([pa.array(np.append(i, -1)), pa.array(np.append(w[i], b0))], ["i", "w"])

    each = rows.mapInArrow(extract, "doc_id long, y int, h long, f array<int>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by("f", F.struct("h", "f")).alias("f"))
    each = each.select("y", F.xxhash64("doc_id").alias("o"), "doc_id", "f")
    found = each.repartition(1).sortWithinPartitions("o", "doc_id").mapInArrow(learn, "i long, w double").collect()
    kept = sorted((r.i, r.w) for r in found)
    return np.array([i for i, _ in kept[1:]], np.int64), np.array([w for _, w in kept[1:]]), kept[0][1] if kept else 0.0


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int) -> DataFrame:
    """doc_id, held_out and the probability of a toxic text for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, w, b0 = sent.value
        dense = np.zeros(1 << bits)
        dense[i] = w
        for b in W.pieces(batches):
            idx, doc = features(b.column("text"), bits)
            key = np.unique(((doc << bits) | idx)[dense[idx] != 0])
            total = np.bincount(key >> bits, weights=dense[key & ((1 << bits) - 1)], minlength=b.num_rows) + b0
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], ["doc_id", "held_out", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double")


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every row.

    Labels of rows whose crc32(doc_id) mod 3 is 1 are never learned (held_out). A null or
    empty text scores as a text without features; rows that repeat score alike; an empty
    table gives an empty result; columns beyond those named are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", (id_mod("doc_id", 3) == 1).alias("held_out"))
    model = train(docs, labels.filter(id_mod("doc_id", 3) != 1), p)
    return score(docs, model, p.bits).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
