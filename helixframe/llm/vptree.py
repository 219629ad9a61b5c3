"""Approximate nearest neighbours by inner product: a vantage-point tree for each shard.

Largest inner product becomes nearest distance by one more coordinate, sqrt(M^2 - |v|^2) with
the largest norm M over all vectors (0 for queries). Vectors are dealt to shards of about
``shard_rows`` by a hash; each shard's tree is built once, by the task that reads the shard,
and all queries stream through it in blocks of ``query_rows``, so that no task holds more than
one shard and one block. Subtrees are skipped by the triangle inequality with the current
k-th distance times ``factor``: 1 is exact, less skips more. A query's first bound on that
distance is the k-th among a bounded sample of vectors.

Equal vectors are rivals only by vec_id: of each group the k+1 least ids can be among the
nearest of any query, so the rest leave before the search (exactly; by a group limit that
works before the shuffle), and equal queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, stored, table


@dataclass(frozen=True)
class Search:
    k: int = 20
    factor: float = 0.7
    shard_rows: int = 8192
    query_rows: int = 4096
    sample: int = 2048  #: vectors that give the first bounds
    leaf: int = 128
    seed: int = 7


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in one order for every pair (equal vectors tie exactly)."""
    return np.einsum("qd,vd->qv", q, v)


class VPTree:
    """Nodes hold a vantage point and the median distance; leaves hold up to ``leaf`` points."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int):
        self.points, self.leaf = points, leaf
        self.square = (points**2).sum(1)
        self.root = self._build(np.arange(len(points)), np.random.default_rng(seed))

    def _build(self, idx: np.ndarray, rng: np.random.Generator):
        if len(idx) <= self.leaf:
            return idx
        vp = idx[rng.integers(len(idx))]
        d = self.distance(self.points[vp][None], idx)[0]
        mid = float(np.median(d))
        near = d < mid
        if not near.any() or near.all():  # all as far: no way to split
            return idx
        return vp, mid, self._build(idx[near], rng), self._build(idx[~near], rng)

    def distance(self, q: np.ndarray, idx: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + self.square[idx] - 2 * (q @ self.points[idx].T)))

    def search(self, q: np.ndarray, k: int, factor: float, bound: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Distances and numbers of the k nearest found of each query (inf, -1 where there are fewer).

        bound: a distance of each query beyond which nothing is wanted.
        """
        bound = np.broadcast_to(bound, len(q))
        far, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1)

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                for i in range(0, len(node), 1024):
                    part = node[i : i + 1024]
                    d = np.concatenate([far[rows], self.distance(q[rows], part)], axis=1)
                    w = np.concatenate([who[rows], np.broadcast_to(part, (len(rows), len(part)))], axis=1)
                    best = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.argsort(d, axis=1)
                    far[rows], who[rows] = np.take_along_axis(d, best, 1), np.take_along_axis(w, best, 1)
                return
            vp, mid, inner, outer = node
            d = self.distance(q[rows], np.array([vp]))[:, 0]
            near = d < mid
            visit(inner, rows[near])
            visit(outer, rows[~near])
            reach = factor * np.minimum(far[rows].max(1), bound[rows])
            visit(outer, rows[near & (d + reach >= mid)])
            visit(inner, rows[~near & (d - reach <= mid)])

        visit(self.root, np.arange(len(q)))
        return far, who


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part: not null or zero, all numbers finite.

    If lengths differ, those of the most frequent length do (of equally frequent: the longest).
    """
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).filter(fine & F.col("vec_id").isNotNull())
    most = v.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return v.filter(F.size("embedding") == (most.n if most else 0))


def _vectors(column: pa.Array) -> np.ndarray:
    """A matrix of a column of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _found(tree: VPTree, v: np.ndarray, ids: np.ndarray, q: np.ndarray, asked: np.ndarray, bound: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    """q, vec_id, score: the k+1 best of a shard for each query of a block, by exact score, ties to the smaller id."""
    m = min(len(v), k + 1 + 8)  # a few more, as these distances are rounded
    _, who = tree.search(np.column_stack([q, np.zeros(len(q))]), m, factor, bound)
    row, col = np.nonzero(who >= 0)
    who = who[row, col]
    score = np.einsum("nd,nd->n", q[row], v[who])
    order = np.lexsort((ids[who], -score, row))
    row, who, score = row[order], who[order], score[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] <= k
    return pa.record_batch([pa.array(asked[row[keep]]), pa.array(ids[who[keep]]), pa.array(score[keep])], ["q", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, p: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: the p.k nearest found of each query, nearest first, ties to the smaller id.

    Candidates of a query are all rows but those with its own vec_id. A vec_id that repeats
    counts once, with the least of its vectors. An empty table, or one without a vector that
    takes part, gives an empty result; rows whose vec_id is null take no part; columns beyond
    vec_id and embedding are ignored.
    """
    k = p.k
    rows = stored(valid(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    largest = rows.agg(F.max(norm)).first()[0] or 0.0
    order = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    rivals = cut(rows.withColumn("r", order).filter(F.col("r") <= k + 1).drop("r"))
    asked = rows.filter(is_query)
    queries = cut(asked.groupBy("embedding").agg(F.min("vec_id").alias("q")))
    shards = max(1, -(-rivals.count() // p.shard_rows))
    sample = _vectors(rivals.orderBy(F.xxhash64("vec_id", F.lit(p.seed)), "vec_id").limit(p.sample).select("embedding").toArrow().combine_chunks().column("embedding"))
    sent = vectors.sparkSession.sparkContext.broadcast(sample)

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            for i in range(0, b.num_rows, p.query_rows):
                part = b.slice(i, p.query_rows)
                q = _vectors(part.column("embedding"))
                bound = np.full(len(q), np.inf)
                if len(v) > k + 1:
                    least = np.partition(q @ v.T, len(v) - k - 1, axis=1)[:, len(v) - k - 1]  # of the k+1 best, as one may be the query itself
                    bound = np.sqrt(np.maximum(0, (q**2).sum(1) + largest**2 - 2 * least)) * (1 + 1e-9) + 1e-9
                yield pa.record_batch([part.column("q"), part.column("embedding"), pa.array(bound)], ["id", "embedding", "bound"])

    asked_rows = cut(queries.mapInArrow(first_bounds, "id long, embedding array<double>, bound double"))
    points = rivals.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("double").alias("bound"))
    asks = asked_rows.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "embedding", "bound")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        tree, now = None, None
        for b in batches:
            shard, query = b.column("shard").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (query[1:] != query[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if shard[i] != now:
                    held, ids, tree, now = [], [], None, shard[i]
                if not query[i]:
                    held.append(_vectors(b.column("embedding").slice(i, j - i)))
                    ids.append(b.column("id").slice(i, j - i).to_numpy())
                    continue
                if not held:  # no vector fell to this shard
                    continue
                if tree is None:
                    v, who = np.concatenate(held), np.concatenate(ids)
                    tree = VPTree(np.column_stack([v, np.sqrt(np.maximum(0, largest**2 - (v**2).sum(1)))]), p.leaf, p.seed)
                for x in range(i, j, p.query_rows):
                    part = b.slice(x, min(p.query_rows, j - x))
                    yield _found(tree, v, who, _vectors(part.column("embedding")), part.column("id").to_numpy(), part.column("bound").to_numpy(), k, p.factor)

    both = points.union(asks).repartition("shard").sortWithinPartitions("shard", "asks", "id")
    found = both.mapInArrow(search, "q long, vec_id long, score double")
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = cut(found.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1))
    # every query takes the list of its vector, without itself
    member = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(queries, "embedding").select("query_id", "q")
    lists = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))  # k+1 at most
    own = member.join(lists, "q").select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)))
    return own.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)
