"""Connected components of an edge list, by rounds of large and small stars on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import settle

#: Edges that a task joins up at once; it holds no more of them.
AT_ONCE = 250_000
#: Edges over those of one node beyond which its neighbours are joined by broadcast, at least.
HOT = 100


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """edges(u, v) with m of least(u, m, n); n: neighbours of u. Nodes with over a 500th of all edges, 1,000 at most as the ns sum to twice the edges, are joined by broadcast, so that no task gets all their neighbours."""
    limit = max(HOT, n_edges // 500)
    hot = least.filter(F.col("n") > limit).select("u", F.col("m").alias("hot"))
    met = edges.join(F.broadcast(hot), "u", "left")
    rest = met.filter("hot is null").drop("hot").join(least.filter(F.col("n") <= limit).select("u", "m"), "u")
    return met.filter("hot is not null").select("u", "v", F.col("hot").alias("m")).unionByName(rest)


def _stars(edges: DataFrame) -> bool:
    """If every node of edges(u, v) hangs under one other, or is one that nodes hang under: then no round would change them."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return odd.agg(F.count("*")).first()[0] == 0


def stars(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value and the least of those that the links (positions a, b) join it to, where it is another."""
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return values[label != np.arange(len(values))], values[label[label != np.arange(len(values))]]
        label = new


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars, AT_ONCE of them at a time."""

    def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = pa.Table.from_batches(held)
        nodes = pc.unique(pa.chunked_array([*met["u"].chunks, *met["v"].chunks]))
        nodes = nodes.take(pc.sort_indices(nodes))
        node, root = stars(np.arange(len(nodes)), *(pc.index_in(met[c], nodes).to_numpy().astype(np.int64) for c in ("u", "v")))
        yield from pa.table([nodes.take(pa.array(node)), nodes.take(pa.array(root))], names=["u", "v"]).to_batches(10_000)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= AT_ONCE:
            yield from joined(held)
            held, n = [], 0
    if held:
        yield from joined(held)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(u, v); root is the smallest node that it reaches.

    Before each round, every task joins up the edges that it has, AT_ONCE at a time, so what is left is a few edges a node
    and task; up to AT_ONCE edges are one task's and no round is made. Each round hangs every node's larger neighbours under its smallest one, then the smaller ones; the
    diameter falls by a constant factor. Each round is written to the shared folder; once the edges are stars, no
    further round is made, so none at all where they are given as stars. Groups are only ever reduced
    to their minimum, by partial sums, and neighbours of a node with very many meet it where they are.
    """
    e = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(e):
        parts = 1 + e.count() // AT_ONCE
        near = e.coalesce(parts).mapInArrow(_joined_up, e.schema)
        if parts == 1:
            e = settle(near, "edges")
            break
        e = settle(near.distinct(), "edges")
        n_edges = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.filter("v > u"), least, n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, n_edges).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = settle(small.filter("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
