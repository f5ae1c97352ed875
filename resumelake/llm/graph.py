"""Connected components of a graph held as a DataFrame of edges.

Alternating large-star and small-star steps (Kiveris et al., 2014): each round
is two aggregations and two joins, and the number of rounds grows with the
logarithm of a component's size. Nothing but a count and a checksum of the
edges reaches the driver; each round is checkpointed in the shared folder.
A caller may have few edges put together at the driver instead: the rounds'
shuffles cost more than such edges do.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resumelake.llm.shared import settled


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _joined(e: DataFrame) -> DataFrame:
    """components, of edges (u, v: long) that the driver holds."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    rows = e.toArrow()
    for u, v in zip(rows.column("u").to_pylist(), rows.column("v").to_pylist(), strict=True):
        a, b = root(u), root(v)
        above[max(a, b)] = min(a, b)
    found = pa.table({"node": pa.array(list(above), pa.int64()), "component": pa.array([root(x) for x in above], pa.int64())})
    return e.sparkSession.createDataFrame(found, "node long, component long")


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, component) for each node of edges (src, dst: long); component: the smallest node reachable.

    Loops, repeated edges, edges with a null end and an empty graph are allowed;
    a node without an edge to another is not returned. Up to few edges (16 bytes each) are put together at the driver.
    """
    e = settled(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    mark = _mark(e)
    if 0 < mark[0] <= few:
        return _joined(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settled(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(e)
        if mark == before:
            break
    leaf = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaf.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
