"""Connected components of an edge table.

First each task joins what it can of at most TASK_EDGES edges.  Then, if there were more tasks than
one, large and small stars alternate: each round replaces edges by stars around the least
neighbour and never adds any, so tables stay as large as the input; the number of rounds grows with
the logarithm of the longest path.  Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

TASK_EDGES = 1 << 20


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def least_of_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of some edges and the least vertex of each one's component."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # hooking the labels themselves, not only the ends, makes long paths short
        for at in (label[x], label[y], x, y):
            np.minimum.at(new, at, low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return names, names[label]
        label = new


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        v, root = least_of_component(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["a", "b"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(v, root) of each vertex of ``edges`` (a long, b long) but those with loops only; the root is the component's least vertex.

    Repeated edges do no harm; an empty table gives an empty result.
    """
    own = edges.where("a != b").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    tasks = -(-own.count() // task_edges)
    now = written(own.repartition(max(1, tasks)).mapInArrow(_local, "a long, b long").where("a != b"), "edges")
    own.unpersist()
    before = None
    while tasks > 1:
        now = written(_small(_large(now)), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
