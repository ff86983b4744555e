"""Connected components of a graph that no machine holds: local contraction, then large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, join_counted, settle

#: Links that one task contracts at once; the number of tasks follows from it.
LINKS_PER_TASK = 500_000


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v) that are not their component's smallest, each with that smallest node."""
    if not len(u):
        return u[:0], u[:0]
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            break
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of stars with the same components as the links of the partition, contracted piece by piece."""
    u = v = np.empty(0, np.int64)
    fresh = 0
    for batch in batches:
        u = np.concatenate([u, batch.column(0).to_numpy()])
        v = np.concatenate([v, batch.column(1).to_numpy()])
        fresh += batch.num_rows
        if fresh >= 4 * LINKS_PER_TASK:
            (u, v), fresh = local_components(u, v), 0
    u, v = local_components(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _large_star(links: DataFrame, hot: int) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_counted(both.filter("v > u"), least, ["u"], "n", hot).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, hot: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(down, least, ["u"], "n", hot).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """Components of the links (u long, v long) as (node, component), for the nodes above their component's smallest.

    ``component`` is the smallest node reachable. Nodes without links, or that are the smallest of their component, have
    no row. Self-links and repeated links are harmless, an empty table gives an empty one, links with a null end are
    dropped. Each round works on a table in the shared folder, so an executor's loss costs that round's lost tasks.

    Up to ``per_task`` links are contracted in one task. More are dealt by their larger end, of which a forest has one
    link for each task that met it: a hub, however many leaves it has, is the smaller end and gathers nowhere.
    """
    links = links.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u <> v")
    links = settle(links.mapInArrow(_contract, "u long, v long"), "links")
    while True:
        size = links.count()
        if size <= per_task:
            forest = settle(links.repartition(1).mapInArrow(_contract, "u long, v long"), "forest")
            discard(links)
            break
        forest = settle(links.repartition(-(-size // per_task), "u").mapInArrow(_contract, "u long, v long"), "forest")
        discard(links)
        stars = settle(_large_star(forest, per_task), "stars")
        links = settle(_small_star(stars, per_task), "stars")
        discard(stars)
        facts = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
        if forest.agg(*facts).first() == links.agg(*facts).first():
            discard(forest)
            forest = links
            break
        discard(forest)
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component"))
