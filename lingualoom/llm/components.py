"""Connected components of a large edge table by alternating star contractions.

Every round replaces neighbours by the least neighbour, first for the larger
and then for the smaller side, until nothing changes. All steps are partial
minima and equi-joins; the edges of a hub don't meet in one task. Each round is
written to the shared folder, which cuts the lineage.

Defined results: loops, repeated and null-ended edges are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import forget, written

#: A node with more edges is a hub.
HUB = 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge that isn't the least of its
    component, with that least node."""
    now = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        then = written(_small_star(_large_star(now)), "edges")
        new = _state(then)
        forget(now)
        now = then
        if new == state:
            break
        state = new
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def _with_least(e: DataFrame, on: str) -> DataFrame:
    """Add ``m``: the least neighbour of the node in column ``on`` among the lesser ones, null if it has none.

    Edges of nodes with more than HUB edges don't meet by the node: such nodes
    are fewer than the edges / HUB, so they are broadcast.
    """
    least = e.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m"))
    degree = e.groupBy(F.col(on).alias("h")).agg(F.count("*").alias("n"))
    if (degree.agg(F.max("n")).first()[0] or 0) <= HUB:
        return e.join(least, F.col(on) == F.col("k"), "left").drop("k")
    hubs = written(degree.where(F.col("n") > HUB).join(least, F.col("h") == F.col("k"), "left").select("h", "m"), "hubs")
    usual = e.join(F.broadcast(hubs.select("h")), F.col(on) == F.col("h"), "left_anti").join(least, F.col(on) == F.col("k"), "left")
    return usual.drop("k").unionByName(e.join(F.broadcast(hubs), F.col(on) == F.col("h")).drop("h"))


def _large_star(e: DataFrame) -> DataFrame:
    """The greater neighbours of each node move to its least one."""
    return _with_least(e, "lo").select("hi", F.least("lo", "m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """The lesser neighbours of each node, and the node, move to its least one."""
    out = _with_least(e, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("x"))
    return out.where("x.hi != x.m").select(F.col("x.hi").alias("hi"), F.col("x.m").alias("lo")).distinct()


class Forest:
    """Union of pairs given as arrays, inside one task: keeps a label for each
    place, never the pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label[:] = up
