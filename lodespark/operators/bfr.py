"""BFR clustering: discard, compression and retained sets over chunks of points.

Points stay distributed; cluster summaries (a bounded number, N, SUM and SUMSQ
each) live on the driver. Within a chunk the summaries are frozen at its start:
assignments don't depend on the order of points, and a chunk is one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.functions.scalars import mahalanobis
from lodespark.session import written


def summaries(points: DataFrame, group: str, vector: str = "x") -> DataFrame:
    """(group, dim, n, sum, sumsq, mean, sd) in long form."""
    long = points.select(F.col(group), F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    sums = long.groupBy(group, "dim").agg(F.count("*").alias("n"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sumsq"))
    mean = F.col("sum") / F.col("n")
    return sums.withColumn("mean", mean).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("sumsq") / F.col("n") - mean * mean)))


def nearest(points: DataFrame, clusters: DataFrame, key: str, group: str, vector: str = "x") -> DataFrame:
    """(key, group, distance): the nearest cluster by Mahalanobis distance; a dimension without spread admits equal values only.

    The clusters (a bounded number of summaries) travel as one row, and each point
    is judged in its own row, so points are not shuffled.
    """
    each = clusters.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "sd"))).alias("_d"))
    one = each.agg(F.collect_list(F.struct(group, F.col("_d.mean").alias("mean"), F.col("_d.sd").alias("sd"))).alias("_clusters"))
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    near = F.array_min(F.transform("_clusters", lambda c: F.struct(mahalanobis(F.col("_x"), c["mean"], c["sd"]).alias("distance"), c[group].alias(group))))
    found = points.select(key, x.alias("_x")).crossJoin(F.broadcast(one)).where(F.size("_clusters") > 0).select(key, near.alias("_n"))
    return found.select(key, F.col(f"_n.{group}").alias(group), F.col("_n.distance").alias("distance"))


@dataclass
class Summary:
    n: float
    sum: np.ndarray
    sumsq: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sum / self.n

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.sumsq / self.n - self.mean**2))

    def merged(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.sum + other.sum, self.sumsq + other.sumsq)


def distance(x: np.ndarray, s: Summary) -> float:
    sd, d = s.sd, x - s.mean
    z = np.where(sd > 0, d / np.where(sd > 0, sd, 1), np.where(np.abs(d) > 1e-12, np.inf, 0))
    return float(np.sqrt((z * z).sum()))


def kmeans(points: DataFrame, k: int, seed: int, tries: int = 10) -> DataFrame:
    """points with a column cluster: the best of several starts by training cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    if n == 0:
        return points.withColumn("cluster", F.lit(None).cast("int"))
    data = written(points.withColumn("features", array_to_vector(F.transform("x", lambda v: v.cast("double")))), "kmeans")
    best = min((KMeans(k=max(1, min(k, n)), seed=seed + i).fit(data) if n > 1 else None for i in range(tries if n > 1 else 1)), key=lambda m: m.summary.trainingCost if m else 0)
    if best is None:
        return data.drop("features").withColumn("cluster", F.lit(0))
    return best.transform(data).withColumnRenamed("prediction", "cluster").drop("features")


def chunks(points: DataFrame, key: str, share: float = 0.2, seed: int = 553) -> DataFrame:
    """Adds chunk: equal parts of the points in a seeded order; a remainder makes one more."""
    from lodespark.operators.sketches import numbered

    mixed = points.withColumn("_o", F.xxhash64(F.lit(seed), key))
    size = max(1, int(points.count() * share))
    return numbered(mixed, ["_o", key], size).withColumnRenamed("batch", "chunk").drop("_o", "seq")


def _summarised(assigned: DataFrame, group: str) -> dict[int, Summary]:
    rows = summaries(assigned, group).groupBy(group).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "sum", "sumsq"))).alias("s")).collect()
    return {r[group]: Summary(float(r.n), np.array([v["sum"] for v in r.s]), np.array([v["sumsq"] for v in r.s])) for r in rows}


def _clusters(spark, named: dict[int, Summary]) -> DataFrame:
    rows = [(int(c), d, float(m), float(s)) for c, v in named.items() for d, (m, s) in enumerate(zip(v.mean, v.sd, strict=True))]
    return F.broadcast(spark.createDataFrame(rows, "cluster int, dim int, mean double, sd double"))


class BFR:
    def __init__(self, spark, k: int, seed: int = 553):
        self.spark, self.k, self.seed = spark, k, seed
        self.ds: dict[int, Summary] = {}
        self.cs: dict[int, Summary] = {}
        self.placed: list[DataFrame] = []  # (point, set, cluster)
        self.retained: DataFrame | None = None
        self.moved: dict[int, int] = {}
        self.next_cs = 0
        self.rounds: list[tuple[int, int, int, int, int]] = []

    def _place(self, rows: DataFrame, where: str) -> None:
        self.placed.append(written(rows.select("point", F.lit(where).alias("set"), F.col("cluster").cast("int").alias("cluster")), "placed"))

    def _compress(self, rows: DataFrame) -> None:
        """k-means on the retained points: clusters of several points join the compression set."""
        found = written(kmeans(rows, 5 * self.k, self.seed), "retained")
        sizes = found.groupBy("cluster").agg(F.count("*").alias("size"))
        several = found.join(sizes.where("size > 1"), "cluster").withColumn("cluster", F.col("cluster") + self.next_cs)
        made = _summarised(several, "cluster")
        if made:
            self.cs |= made
            self.next_cs = max(made) + 1
            self._place(several, "cs")
        self.retained = written(found.join(sizes.where("size = 1"), "cluster").select("point", "x"), "retained")

    def first(self, rows: DataFrame) -> None:
        rough = written(kmeans(rows, 5 * self.k, self.seed), "rough")
        sizes = rough.groupBy("cluster").agg(F.count("*").alias("size"))
        main = written(kmeans(rough.join(sizes.where("size > 1"), "cluster").select("point", "x"), self.k, self.seed), "main")
        self.ds = _summarised(main, "cluster")
        self._place(main, "ds")
        self._compress(rough.join(sizes.where("size = 1"), "cluster").select("point", "x"))

    def add(self, rows: DataFrame) -> None:
        rest = rows.select("point", "x")
        for where, held in (("ds", self.ds), ("cs", self.cs)):
            if not held:
                continue
            limit = 2 * np.sqrt(len(next(iter(held.values())).sum))
            got = written(nearest(rest, _clusters(self.spark, held), "point", "cluster").where(F.col("distance") < float(limit)).join(rest, "point"), "near")
            for c, s in _summarised(got, "cluster").items():
                held[c] = held[c].merged(s)
            self._place(got, where)
            rest = written(rest.join(got.select("point"), "point", "left_anti"), "rest")
        self._compress(rest if self.retained is None else rest.unionByName(self.retained))
        self._merge_cs()

    def _merge_cs(self) -> None:
        """One pass over pairs of compression clusters, in order: mean of the earlier against the later."""
        for i in sorted(self.cs):
            for j in sorted(self.cs):
                if i < j and i in self.cs and j in self.cs and distance(self.cs[i].mean, self.cs[j]) < 2 * np.sqrt(len(self.cs[i].sum)):
                    self.cs[i] = self.cs[i].merged(self.cs.pop(j))
                    self.moved[j] = i

    def report(self) -> None:
        count = lambda held: int(sum(s.n for s in held.values()))
        self.rounds.append((len(self.rounds) + 1, count(self.ds), len(self.cs), count(self.cs), 0 if self.retained is None else self.retained.count()))

    def finish(self) -> dict[int, int]:
        """Compression clusters near a discard cluster go to it; returns where each went."""
        to = {}
        for c, s in sorted(self.cs.items()):
            near = min(((distance(s.mean, d), k) for k, d in self.ds.items()), default=None)
            if near is not None and near[0] < 2 * np.sqrt(len(s.sum)):
                to[c] = near[1]
        return to


def cluster(points: DataFrame, key: str, vector: str, k: int, share: float = 0.2, seed: int = 553) -> tuple[DataFrame, DataFrame]:
    """(labels, rounds): labels (point, cluster), -1 outside the discard set; rounds (round, n_ds, n_cs, in_cs, n_rs)."""
    spark = points.sparkSession
    rows = written(chunks(points.select(F.col(key).alias("point"), F.transform(vector, lambda v: v.cast("double")).alias("x")), "point", share, seed), "points")
    state = BFR(spark, k, seed)
    for c in [r.chunk for r in rows.select("chunk").distinct().orderBy("chunk").collect()]:
        part = rows.where(F.col("chunk") == c)
        state.first(part) if not state.ds else state.add(part)
        state.report()
    to = state.finish()
    final = {}
    for c in range(state.next_cs):
        at = c
        while at in state.moved:
            at = state.moved[at]
        final[c] = to.get(at, -1)
    placed = state.placed[0]
    for p in state.placed[1:]:
        placed = placed.unionByName(p)
    where = spark.createDataFrame(list(final.items()) or [(-1, -1)], "cluster int, to int")
    named = placed.join(F.broadcast(where), "cluster", "left").select("point", F.when(F.col("set") == "ds", F.col("cluster")).otherwise(F.col("to")).alias("label"))
    labels = rows.select("point").join(named, "point", "left").select("point", F.coalesce("label", F.lit(-1)).alias("cluster"))
    return labels, spark.createDataFrame(state.rounds, "round int, n_ds int, n_cs int, in_cs int, n_rs int")
