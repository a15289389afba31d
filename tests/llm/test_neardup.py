import random

import numpy as np
import pyarrow as pa
import pytest

from lodespark.llm import neardup as N

random.seed(11)
VOC = [f"v{i}" for i in range(900)]


def words(n):
    return [random.choice(VOC) for _ in range(n)]


def edited(w, k):
    w = list(w)
    for i in random.sample(range(len(w)), k):
        w[i] = random.choice(VOC)
    return w


def corpus():
    rows, i = [], 0
    for n in (30, 60, 200, 400):
        base = words(n)
        rows.append(" ".join(base))
        for k in (0, 1, 1, 2, 3, n // 30, n // 10, n // 4):
            rows.append(" ".join(edited(base, k)))
    chain = words(300)
    for _ in range(12):  # each close to the last one, the ends far apart
        rows.append(" ".join(chain))
        chain = edited(chain, 5)
    rows += [" ".join(words(80)) for _ in range(25)] + [None, "", " \n", "a b", "a b", "a  b", "b a", "x"]
    return rows


def classes_by_brute_force(rows):
    idf_rows = list(N._frequency_rows([pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})]))[0].to_pydict()
    found = dict(zip(idf_rows["bucket"], idf_rows["n"]))
    idf = np.log((found[-1] + 1) / (np.array([found.get(b, 0) for b in range(N.BUCKETS)]) + 1)) + 1
    vectors = []
    for t in rows:
        s, w, _ = N.weighted_shingles(pa.array([t], pa.string()), idf)
        vectors.append(dict(zip(s.tolist(), w.tolist())))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a and b:
                top = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
                if top / (sum(a.values()) + sum(b.values()) - top) >= N.SIMILAR:
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("small", [N.SMALL, 2])
def test_classes_equal_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", 2 if small == 2 else N.BLOCK)
    rows = corpus()
    want = classes_by_brute_force(rows)
    assert len(set(want)) < len(want) - 25
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(rows)], "doc_id bigint, text string, node string").repartition(3)
    got = {r.doc_id: r for r in N.near_duplicates(docs).collect()}
    assert [got[i].class_id for i in range(len(rows))] == want
    assert all(got[i].class_size == want.count(want[i]) for i in range(len(rows)))
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_odd_rows(spark):
    t = " ".join(words(40))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None), (2, ""), (None, "solo text"), (3, "solo text x")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in N.near_duplicates(docs).collect())
    assert got == sorted([("1", "1", 3)] * 2 + [("None", "1", 3), ("2", "2", 1), ("2", "2", 1), ("None", "None", 1), ("3", "3", 1)])
    assert len(N.one_of_each(docs).collect()) == 5
    assert N.near_duplicates(docs.limit(0)).collect() == [] and N.one_of_each(docs.limit(0)).collect() == []


def test_unrelated_texts_under_one_id(spark):
    """Classes are told apart where their least id is the same or null."""
    a, b, c, d, e = (" ".join(words(40)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (None, e), (9, e), (7, e + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r.text for r in N.one_of_each(docs).collect()]
    assert sorted(kept) == sorted([a, b, c, d, e])
    found = N.near_duplicates(docs).collect()
    assert len({r.component for r in found}) == 5 and None not in {r.component for r in found}
    assert sorted((str(r.class_id), r.class_size) for r in found) == sorted([("None", 1), ("None", 2), ("None", 2), ("7", 1), ("7", 1), ("7", 3), ("7", 3), ("7", 3)])


def test_draws_meet_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(1, 1 << 63, 4000).astype(np.uint64))
    w = rng.uniform(0.5, 8, len(s)).astype(np.float32)
    a, b = np.arange(0, 3000), np.arange(600, len(s))
    wb = w * rng.uniform(0.8, 1.25, len(s)).astype(np.float32)
    J = N.similarity(s[a].tobytes(), w[a].tobytes(), s[b].tobytes(), wb[b].astype(np.float32).tobytes())
    n = 1500
    x = N.draws(s[a], w[a], np.zeros(len(a), np.int64), n)[:, 0]
    y = N.draws(s[b], wb[b], np.zeros(len(b), np.int64), n)[:, 0]
    assert abs((x == y).mean() - J) < 4 * (J * (1 - J) / n) ** 0.5


def test_recall_by_band_of_similarity():
    """Of pairs in each band of weighted similarity at the threshold and above, at least so many meet in a bucket."""
    rng = random.Random(12)
    voc = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(3000)]
    left, right = [], []
    for _ in range(1500):
        words = rng.choices(voc, k=rng.randint(60, 220))
        other = list(words)
        for _ in range(rng.randint(0, max(1, len(words) // 45))):
            other[rng.randrange(len(other))] = rng.choice(voc)
        left.append(" ".join(words))
        right.append(" ".join(other))
    idf = np.random.default_rng(3).uniform(1, 8, N.BUCKETS)
    sides = [N.weighted_shingles(pa.array(t), idf) for t in (left, right)]
    (s1, w1, d1), (s2, w2, d2) = sides
    draws = [N.draws(s, w, d, N.BANDS * N.ROWS) for s, w, d in sides]
    met = (draws[0] == draws[1]).reshape(N.BANDS, N.ROWS, -1).all(1).any(0)
    near = np.array([N.similarity(s1[d1 == i].tobytes(), w1[d1 == i].tobytes(), s2[d2 == i].tobytes(), w2[d2 == i].tobytes()) for i in range(len(left))])
    for low, high, least in ((0.8, 0.85, 0.97), (0.85, 0.9, 0.99), (0.9, 1.01, 0.999)):
        inside = (near >= low) & (near < high)
        assert inside.sum() > 60 and met[inside].mean() >= least
    # one draw agrees as often as the texts are similar
    assert abs((draws[0] == draws[1]).mean(0) - near).mean() < 0.08 and abs((draws[0] == draws[1]).mean() - near.mean()) < 0.01
