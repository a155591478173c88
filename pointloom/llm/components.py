"""Connected components of a table of links, without leaving Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: Links (counted) up to which one task finds the components: each round below costs the driver five plans with their code and threads.
GATHERED = 500_000


def least_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def _gathered(once: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if ends:
            found = least_roots(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])

    return map_arrow(once.select(F.col("x").cast("long"), F.col("y").cast("long")).coalesce(1), run, "node long, root long", 100_000)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node of its component) for every node that has a link.

    Every round each node takes the least root among its own and its
    neighbours', then the root of that root; labels only fall, and rounds end
    when none does. Rounds grow with the logarithm of a component's width.
    Neighbour roots are combined before they are shuffled, and each round is written out.
    Up to ``GATHERED`` links are worked on by one task instead.
    """
    once = materialize(links.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x != y").distinct())
    if once.count() <= GATHERED:
        return materialize(_gathered(once))
    both = once.union(once.select("y", "x"))
    now = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")))
    while True:
        near = both.join(now.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        # hooking: a root also hears of the least root next to any of its members
        heard = near.join(now, "node").select("root", "near").where("near < root").groupBy(F.col("root").alias("node")).agg(F.min("near").alias("far"))
        low = now.join(near, "node").join(heard, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "near", "far").alias("root"))
        low = materialize(low)
        jump = low.alias("l").join(low.select(F.col("node").alias("n"), F.col("root").alias("r")).alias("j"), F.col("l.root") == F.col("j.n"), "left")
        new = materialize(jump.select("l.node", "l.was", F.least("l.root", "j.r").alias("root")))
        now = new.select("node", "root")
        if new.where("root < was").isEmpty():
            return now
