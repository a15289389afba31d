import random

from lodespark.operators.components import connected_components


def test_components_against_union_find(spark):
    random.seed(3)
    edges = [(random.randrange(120), random.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(400, 440)] + [(900, i) for i in range(1000, 1400)] + [(i, 901) for i in range(1390, 1700)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)
    assert connected_components(spark.createDataFrame([], "src int, dst int")).collect() == []
