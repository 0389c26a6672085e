"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a partially aggregated minimum per node and a join; nothing is gathered on the driver but
one count, and a hub's edges are never held in one task.  Rounds grow with the logarithm of the longest
path, not with the size of the graph.  As each costs the driver its plans, a table of at most FEW edges is
merged in one task instead.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Stage

FEW = 10_000  # edges that one task takes


def _merged(batches):
    """Every node with the smallest one that it reaches."""
    of, kind = {}, None

    def top(x):
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            of.setdefault(u, u), of.setdefault(v, v)
            u, v = top(u), top(v)
            of[max(u, v)] = min(u, v)
    if of:
        yield pa.RecordBatch.from_arrays([pa.array(list(of), kind), pa.array([top(x) for x in of], kind)], names=["node", "component"])


def components(edges: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component: the smallest node reachable.

    Empty input gives an empty table; loops and repeated edges do no harm.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stage.put(e, f"{name}-0")
    if e.count() <= FEW:
        kind = dict(e.dtypes)["u"]
        return stage.put(e.coalesce(1).mapInArrow(_merged, f"node {kind}, component {kind}"), f"{name}-all")
    done, k = None, 0
    while True:
        k += 1
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage.put(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stage.drop(f"{name}-{k - 1}")
        e = new
        if not state[0]:
            break
        if tuple(state) == done:  # and stars only: no centre is an end of another's edge
            if new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
                break
        done = tuple(state)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
