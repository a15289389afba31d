"""Co-occurrence graphs: edges, label propagation, edge betweenness, modularity, Girvan-Newman."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.operators.components import connected_components
from lodespark.operators.partners import partners
from lodespark.session import written


def cooccurrence(pairs: DataFrame, node: str, item: str, threshold: int) -> DataFrame:
    """(src, dst, n), src < dst: nodes that share `threshold` items or more.

    A node's partners lie in one sorted list, with one entry for every shared item. An entry whose equal stands
    threshold - 1 places on belongs to an edge; only those are counted.
    """
    pairs = pairs.select(F.col(node).alias("src"), F.col(item).alias("i")).where("src IS NOT NULL AND i IS NOT NULL").distinct()
    met = partners(pairs, "i", "src").groupBy("src").agg(F.sort_array(F.flatten(F.collect_list("srcs"))).alias("all"))
    more = max(int(threshold), 1) - 1
    held = met.select("src", F.explode(F.filter("all", lambda x, k: F.get("all", k + more) == x)).alias("dst"))
    return held.groupBy("src", "dst").agg((F.count("*") + more).alias("n"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def mirrored(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; one pass over the edges, which may be long in the making."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("e")).select("e.src", "e.dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return mirrored(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(id, community) of every vertex; a community is named by its least vertex."""
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("community"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): in each round a vertex takes its neighbours' most frequent label, the least of equals.

    Every round is written to the shared folder.
    """
    both = written(mirrored(edges), "edges")
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        labels = written(heard.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")), "labels")
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """(members, size), members in order."""
    return labels.groupBy(label).agg(F.sort_array(F.collect_list("id")).alias("members")).select("members", F.size("members").alias("size"))


def shortest_paths(edges: DataFrame, most_levels: int = 1000) -> DataFrame:
    """(s, t, d, paths) between all connected pairs, s = t included, level by level from all sources at once.

    A neighbour of a vertex at distance d is at d - 1, d or d + 1, so new pairs are told by the last two levels.
    """
    return _paths(written(mirrored(edges), "edges"), most_levels)


def _paths(both: DataFrame, most_levels: int = 1000) -> DataFrame:
    level = written(both.select(F.col("src").alias("s")).distinct().select("s", F.col("s").alias("t"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")), "paths")
    found, last = level, level
    for d in range(1, most_levels):
        grown = level.join(both, F.col("t") == F.col("src")).groupBy("s", F.col("dst").alias("t")).agg(F.sum("paths").alias("paths"))
        known = last.select("s", "t").union(level.select("s", "t"))
        last, level = level, written(grown.join(known, ["s", "t"], "left_anti").select("s", "t", F.lit(d).alias("d"), "paths"), "paths")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """(src, dst, betweenness): shortest paths over each edge, each pair of ends once, as shares of the pair's paths.

    A path from s to t runs over (u, v) when d(s,u) + 1 + d(v,t) = d(s,t). It is
    counted back from the ends, level by level, so nothing grows beyond the rows
    of the path table times a vertex's neighbours.
    """
    both = written(mirrored(edges), "edges")
    paths = written(_paths(both), "paths")
    most = paths.agg(F.max("d")).first()[0] or 0
    flows, gained = [], None
    for d in range(most, 0, -1):
        credit = paths.where(F.col("d") == d).withColumn("credit", F.lit(1.0))
        if gained is not None:
            credit = credit.join(gained, ["s", "t"], "left").withColumn("credit", 1.0 + F.coalesce("gained", F.lit(0.0)))
        here = credit.join(both.select(F.col("src").alias("t"), F.col("dst").alias("parent")), "t")
        up = paths.where(F.col("d") == d - 1).select("s", F.col("t").alias("parent"), F.col("paths").alias("up"))
        flow = written(here.join(up, ["s", "parent"]).select("s", "parent", "t", (F.col("credit") * F.col("up") / F.col("paths")).alias("flow")), "flow")
        flows.append(flow)
        gained = flow.groupBy("s", F.col("parent").alias("t")).agg(F.sum("flow").alias("gained"))
    if not flows:
        return both.select("src", "dst", F.lit(0.0).alias("betweenness"))
    flow = flows[0]
    for f in flows[1:]:
        flow = flow.unionByName(f)
    return flow.groupBy(F.least("parent", "t").alias("src"), F.greatest("parent", "t").alias("dst")).agg((F.sum("flow") / 2).alias("betweenness"))


def modularity(original: DataFrame, current: DataFrame, labels: DataFrame, label: str = "community") -> DataFrame:
    """q: sum over communities of inner edges (of the cut graph) / m - (degrees / 2m)**2, degrees and m of the original graph."""
    m = original.agg(F.count("*").alias("m"))
    names = labels.select("id", F.col(label).alias("c"))
    inner = current.join(names.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(names.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.count("*").alias("inner"))
    total = degrees(original).join(names, "id").groupBy("c").agg(F.sum("degree").alias("total"))
    each = total.join(inner, "c", "left").join(F.broadcast(m)).select((F.coalesce("inner", F.lit(0)) / F.col("m") - F.pow(F.col("total") / (2 * F.col("m")), F.lit(2.0))).alias("q"))
    return each.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("q"))


def without_heaviest(edges: DataFrame, betweenness: DataFrame, digits: int = 9) -> DataFrame:
    """Cuts all edges of the highest betweenness; values equal after rounding count as ties."""
    rounded = betweenness.withColumn("r", F.round("betweenness", digits))
    top = rounded.agg(F.max("r").alias("top"))
    cut = rounded.join(F.broadcast(top)).where("r = top").select("src", "dst")
    return edges.join(cut, ["src", "dst"], "left_anti")


def girvan_newman(edges: DataFrame) -> DataFrame:
    """(id, community): the partition of the highest modularity on the way from the whole graph to single vertices, the first of equals."""
    original = written(edges.select("src", "dst"), "graph")
    everyone = written(vertices(original), "vertices")

    def named(current: DataFrame) -> DataFrame:
        return written(everyone.join(components(current), "id", "left").select("id", F.coalesce("community", "id").alias("community")), "partition")

    current, best = original, named(original)
    best_q = modularity(original, current, best).first().q
    while not current.isEmpty():
        current = written(without_heaviest(current, edge_betweenness(current)), "graph")
        partition = named(current)
        q = modularity(original, current, partition).first().q
        if q > best_q + 1e-12:
            best, best_q = partition, q
    return best
