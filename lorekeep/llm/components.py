"""Connected components over a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Links that one step of contract() holds.
STEP = 1 << 20


def roots_of(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """For the nodes 0..m-1, the smallest node that the links (i, j) reach."""
    root = np.arange(m)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task as links to the smallest node they reach among them: the same components, fewer steps between."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        a, b = (table.column(k).to_numpy() for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots_of(at[: len(a)], at[len(a) :], len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= STEP:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in a link between two different nodes; component is the smallest node reachable.

    Each task first contracts its own links. Then large-star and small-star steps alternate: every node passes its smallest neighbour on to its larger, then to its
    smaller neighbours, until all links point to the root. The number of rounds grows with the logarithm of the size. A minimum
    and a join back take the place of neighbour lists, so a hub with any number of links needs no memory of its own."""
    edges = links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b")
    edges = cut(edges.mapInArrow(contract, "a long, b long").distinct(), "links")
    seen = _mark(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour of a node gets the node's minimum
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours get the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        last, edges = edges, cut(small.where("a <> b").distinct(), "links")
        discard(last)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
