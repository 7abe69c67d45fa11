"""Connected components by union-find in partitions and star contraction between them.

Edges become stars: each partition joins its own edges by union-find, then
large-star and small-star steps move every node to the smallest node it can
see, until there are only stars. A step is an aggregate by node, which is summed
before it moves, and a merge join of the edges with it as a written table, which
adaptive execution splits where a node has very many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

EDGE = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])


#: Nodes that a task's union-find holds at a time.
NODES = 1 << 20


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a partition, ``NODES`` nodes or so at a time; every node but a root with its root, the smallest node of its set."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    def stars() -> pa.RecordBatch:
        hi = list(root)
        out = pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array([find(x) for x in hi], pa.int64())], schema=EDGE)
        root.clear()
        return out

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > NODES:
            yield stars()
    yield stars()


def large_star(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    return both.filter("v > u").hint("merge").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def small_star(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    least = work.save(edges.groupBy("hi").agg(F.min("lo").alias("m")), f"{name}-least")
    moved = edges.hint("merge").join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.withColumnRenamed("m", "lo")).distinct()


def only_stars(edges: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has one alone, and no larger one."""
    ends = edges.select(F.col("hi").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select(F.col("lo").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """``node, component`` of every node of ``edges`` (two long columns); the component is its smallest node. Nulls and loops are left out; no edges give no rows."""
    a, b = edges.columns
    clean = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = work.save(clean.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).mapInArrow(local_stars, "hi long, lo long"), f"{name}-0")
    k = 0
    while not only_stars(now):
        k += 1
        large = work.save(large_star(now, work, f"{name}-{k}-large"), f"{name}-{k}-large")
        now = work.save(small_star(large, work, f"{name}-{k}-small"), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}", f"{name}-{k}-large-least", f"{name}-{k}-large", f"{name}-{k}-small-least")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
