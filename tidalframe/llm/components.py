"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, settle
from .workers import lean


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) that isn't its component's smallest, and that smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


@lean
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1 << 20:
            a, b = forest(a, b)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


#: Forest edges up to this many (16 bytes each) are joined by one task; more take distributed steps.
ONE_TASK_EDGES = 1 << 20


def connected_components(edges: DataFrame, max_rounds: int = 64, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every node of the edges (a, b: long); component is its smallest node.

    Every partition first shrinks its own edges to a forest.  Few forest edges are joined by one task of
    bounded memory; more by alternating large-star and small-star steps, which finish in a
    logarithmic number of rounds and never hold more than the edges.  The result is the same.  No edges
    give no rows.  Self loops and repeats are fine.
    """
    now = settle(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long"), "edges")
    if now.count() <= one_task:
        whole = settle(now.coalesce(1).mapInArrow(_contract, "a long, b long"), "forest")
        discard(now)
        now = whole
        max_rounds = 0
    mark = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large, "large")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        then = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        then = settle(then.where("a <> b").distinct(), "small")
        discard(now)
        discard(large)
        now = then
        new = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        if max_rounds:
            raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
