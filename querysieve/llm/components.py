"""Connected components of a large edge list: alternating large and small stars.

Edges are first contracted inside each task, AT_A_TIME of them together, which shortens chains. Up to SMALL edges that
are left are contracted once more in one task. More are worked on in rounds of two aggregations and two joins over the
edges; the number of rounds grows with the logarithm of the longest path. Nothing is gathered on the driver but two
numbers a round. Least neighbours are aggregated before the shuffle and then written out, so that the join back on a
hub's edges is one that adaptive execution can split. What a round has written goes when the next one has written its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, tidy

#: Edges that a task contracts together, and those that are few enough for one task: 16 MB of numbers.
AT_A_TIME, SMALL = 500_000, 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) with the least node that they reach; a node that is itself the least is left out."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    least = np.arange(len(ids))
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    off = least != np.arange(len(ids))
    return ids[off], ids[least[off]]


def _contract(most: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            u, v = contracted(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            if sum(len(u) for u, _ in held) >= most:
                yield out()
                held = []
        if held:
            yield out()

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (least id of the component) of every node with an edge to another node. Null ends make no edge."""
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    e = cut(e.mapInArrow(_contract(AT_A_TIME), "u long, v long"))
    if e.count() <= SMALL:
        e = cut(e.coalesce(1).mapInArrow(_contract(2 * SMALL), "u long, v long"))
        return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        small = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        starred = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut(starred.where("u > v").distinct())
        for written in (e, least, large, small):
            release(written)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
        tidy(e.sparkSession)
