"""Classes of nodes that meet by keys: exact, without all pairs of a group.

Nodes that share a key may be linked, if a test of the two says so. In a group of n similar
nodes most of the n * n / 2 tests are idle, as other links connect the two already. So links
to a few hubs come first; what they connect has one label, and only rows that differ from
the label of a key's largest class are then tested against the key's other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, stored


FEW = 1 << 20  #: edges that one task may finish by itself


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the components of FEW edges (u, v) at most."""
    pairs = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not pairs:
        return
    nodes, ends = np.unique(np.concatenate([np.concatenate(x) for x in zip(*pairs, strict=True)]), return_inverse=True)
    a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        if (root[a] == root[b]).all():
            break
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.record_batch([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of edges (a, b), for all that aren't roots.

    Up to FEW edges are solved by one task. More go through large-star and small-star rounds,
    in which each node links its neighbours to the least of them, until every edge leads to a
    root or few enough are left. Both group by node with pre-aggregated minima, so a node with
    very many links is not gathered.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while edges.count() > FEW:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return edges.coalesce(1).mapInArrow(_solve, "node long, root long")


def labels(edges: DataFrame) -> DataFrame:
    """(node, root, size) of every node of edges, roots too."""
    roots = components(edges)
    every = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    return cut(every.join(every.groupBy("root").agg(F.count("*").alias("size")), "root").select("node", "root", "size"))


def labelled(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows (with node) and their root and size; a node without a label is its own."""
    if known is None:
        return rows.withColumn("root", F.col("node")).withColumn("size", F.lit(1).cast("long"))
    return rows.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("size", F.coalesce("size", F.lit(1).cast("long")))


def cross_pairs(rows: DataFrame, keys: list[str], test: str) -> DataFrame:
    """Pairs (a, b) of nodes of different labels that share a key and pass the test.

    rows: the keys, node, root, size and what the test needs, under the names a_.. and b_..
    there. Of a key's rows those of its largest class aren't paired with each other.
    """
    by = Window.partitionBy(*keys)
    label = F.struct((-F.col("size")).alias("s"), F.col("root").alias("r"))
    rows = rows.withColumn("first", F.min(label).over(by)).withColumn("last", F.max(label).over(by)).filter("first != last")
    rows = stored(rows.withColumn("minor", F.col("root") != F.col("first.r")).drop("first", "last", "size"), "linking")
    of = lambda side, df: df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys])
    both = of("a", rows.filter("minor")).join(of("b", rows), keys)
    met = both.filter(f"a_root != b_root and (not b_minor or a_node < b_node) and ({test})")
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
