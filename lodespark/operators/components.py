"""Connected components by alternating large and small stars.

Every round replaces edges by edges to smaller neighbours and writes the result
to the shared folder, so the plan never grows and a lost executor costs one
round. Node keys may have any orderable type. No edge reaches the driver; the
test for the fixed point compares two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import written


#: Rows that a node must have at least to count as one of many rows.
MANY = 200


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _towards_least(near: DataFrame, total: int) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours in `near`.

    Nodes with more than a thousandth of some `total` rows, of which there are two
    thousand at most, are looked up in a broadcast table, so no task gets all the
    rows of one of them; the others are joined by a shuffle.
    """
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n")
    hot = F.col("n") > max(MANY, total // 1000)
    busy = F.broadcast(least.where(hot).select(F.col("k").alias("hk"), F.col("m").alias("hm")))
    marked = near.join(busy, F.col("u") == F.col("hk"), "left")
    calm = marked.where("hk IS NULL").select("u", "v").join(least.where(~hot).hint("merge"), F.col("u") == F.col("k")).select("u", "v", "m")
    return calm.unionByName(marked.where("hk IS NOT NULL").select("u", "v", F.col("hm").alias("m")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    return _towards_least(_both_ways(edges), 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _towards_least(down, total)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its least node."""
    now = written(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct(), "cc")
    before = None
    for _ in range(rounds):
        mark = _mark(now)
        if mark == before or mark[0] == 0:
            break
        before = mark
        now = written(_small_star(written(_large_star(now, mark[0]), "cc"), mark[0]), "cc")
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
