"""The step that co-occurrence and item similarity share, against loops over small tables."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lodespark.operators import cf, graph, partners


@pytest.mark.parametrize("chunk", [3, 256])
def test_every_two_rows_of_a_group_meet_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(partners, "CHUNK", chunk)
    random.seed(4)
    rows = [(g, k, float(random.randrange(9))) for g in (1, 2, None) for k in (*random.choices("abcdefghij", k=12), None)]
    df = spark.createDataFrame(rows, "g int, k string, v double").withColumn("t", F.coalesce(F.col("k") < "e", F.lit(False)))
    got = partners.partners(df, "g", "k", "v").select("k", "v", F.explode(F.arrays_zip("ks", "vs")).alias("o")).collect()
    want = [(k, v, j, w) for (g, k, v), (h, j, w) in product(rows, rows) if g and g == h and k and j and k < j]
    assert sorted((r.k, r.v, r.o.ks, r.o.vs) for r in got) == sorted(want)
    aimed = partners.partners(df, "g", "k", None, "t").select("k", "both", F.explode("ks").alias("j")).collect()
    want = [(k, j < "e", j) for (g, k, _), (h, j, _) in product(rows, rows) if g and g == h and k and j and k < "e" and (k < j if j < "e" else True)]
    assert sorted((r.k, r.both, r.j) for r in aimed) == sorted(want)


def test_edges_count_shared_items(spark):
    random.seed(8)
    rows = [(random.randrange(12), random.randrange(9)) for _ in range(90)] * 2 + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "u int, i int")
    held = {(u, i) for u, i in rows if u is not None and i is not None}
    for least in (1, 2, 4):
        want = {(a, b): n for a, b in product(range(12), range(12)) if a < b and (n := sum((a, i) in held and (b, i) in held for i in range(9))) >= least}
        assert {(r.src, r.dst): r.n for r in graph.cooccurrence(df, "u", "i", least).collect()} == want
    assert graph.cooccurrence(df.limit(0), "u", "i", 1).collect() == []


def test_pairs_of_targets_are_those_of_all(spark):
    random.seed(5)
    r = {(u, b): float(random.randint(1, 5)) for u in range(20) for b in range(9) if random.random() < 0.7}
    df = spark.createDataFrame([(*k, s) for k, s in r.items()] + [(None, 3, 2.0), (3, None, 1.0)], "u int, b int, stars double")
    found = {(p.b, p.j): (p.common, p.similarity) for p in cf.item_pairs(df).collect()}
    assert all(found[j, b][0] == n and math.isclose(found[j, b][1], s) for (b, j), (n, s) in found.items()) and len(found) > 30
    assert all(n == sum((u, b) in r and (u, j) in r for u in range(20)) for (b, j), (n, _) in found.items())
    aimed = {(p.b, p.j): p.similarity for p in cf.item_pairs(df, targets=spark.createDataFrame([(1,), (4,), (77,)], "b int")).collect()}
    assert aimed == {k: pytest.approx(s) for k, (_, s) in found.items() if k[0] in (1, 4)}


def test_a_shared_item_is_one_row_in_the_shuffle(spark):
    """Sixty nodes share one item: a join of the table with itself deals 1770 pairs, the lists 59 rows."""
    df = spark.createDataFrame([(n, 0) for n in range(60)], "u int, i int")
    assert partners.partners(df, "i", "u").count() == 59 and graph.cooccurrence(df, "u", "i", 1).count() == 1770
    assert cf.item_pairs(df.select(F.col("i").alias("u"), F.col("u").alias("b"), (F.col("u") % 5).cast("double").alias("stars")), cf.CFParams(min_common=1)).count() > 0


def test_edges_are_made_once(spark):
    """What is made of edges goes over them once, however long they are in the making."""
    made = spark.sparkContext.accumulator(0)
    rows = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (6, 7), (2, 6), (5, 6)]

    def seen(frames):
        for f in frames:
            made.add(len(f))
            yield f

    for make in (graph.vertices, graph.mirrored, graph.degrees, graph.label_propagation, graph.components, graph.edge_betweenness, graph.shortest_paths):
        edges = spark.createDataFrame(rows, "src int, dst int").repartition(2).mapInPandas(seen, "src int, dst int")
        made.value = 0
        assert make(edges).count() > 0
        assert made.value == len(rows), make.__name__
