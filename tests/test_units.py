"""Hand-made rows for semantics that the generated tables don't hold: nulls, ties, blanks, empty tables, files."""

import json
import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark.functions import scalars as S
from lodespark.operators import bfr, cf, eda, graph, itemsets, lsh, sketches, stack
from lodespark.operators import features as X
from lodespark.sources import readers, writers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    L = F.lit
    r = one(
        spark, S.make_float(L("x"), 2.5).alias("a"), S.make_float(L("3")).alias("b"), S.log1p_plus(L(-1.0)).alias("c"), S.clip(L(9.0)).alias("d"), S.winsor(L(-3.0), 1.6).alias("e"),
        S.parse_bool(L(" Yes ")).alias("f"), S.parse_bool(L(None).cast("string")).alias("g"), S.noise_level(L("Very_Loud ")).alias("h"), S.noise_level(L(None).cast("string")).alias("i"),
        S.count_items(L("2015, ,2016")).alias("j"), S.count_items(L("None")).alias("k"), S.count_items(L(None).cast("string")).alias("l"), S.geo_bin(L(33.7)).alias("m"),
        S.date_ordinal(L("2018-01-02")).alias("n"), S.date_ordinal(L("2018-01-02 10:00:00")).alias("o"), S.decay(L(180)).alias("p"), S.decay(L(-1)).alias("q"), S.half_even(L(2.5)).alias("s"),
        S.text_modulo(L("4JNXUYY8wbaaDmk3BPzlWw")).alias("t"), S.text_modulo(L("")).alias("u"), S.trailing_zeros(L(0)).alias("v"), S.trailing_zeros(L(40)).alias("w"),
        S.signed_weight(L(-0.5)).alias("x"), S.signed_weight(L(0.004)).alias("y"), S.impute(L(None).cast("double"), L(4.5), L(3.0)).alias("z"),
        S.pair_bucket(L("u"), L("b"), "s").alias("aa"), S.crc_partition(L(None).cast("string"), 7).alias("ab"), S.jaccard_distance(L(1), L(2), L(2)).alias("ac"),
        S.harmonic_reliance(L(0.0), L(0.0), 6.0, 6.0, 0.38, 0.62).alias("ad"), S.map_total(F.create_map(L("a"), L("2"), L("b"), L("x"))).alias("ae"),
    )
    import hashlib

    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k, r.l, r.m) == (2.5, 3.0, 0.0, 5.0, -1.6, 1.0, 0.0, 3.0, 1.0, 2, 0, 0, 33.5)
    assert (r.n, r.o, round(r.p, 9), r.q, r.s, r.u, r.v, r.w) == (date(2018, 1, 2).toordinal(), None, 0.5, 0.0, 2, 0, 32, 3)
    assert r.t == int("4JNXUYY8wbaaDmk3BPzlWw".encode().hex(), 16) % S.BLOOM_PRIME and r.y == 0.0 and r.z == 4.5
    assert r.x == pytest.approx(-(0.495**1.25)) and r.aa == int(hashlib.md5(b"u||b||s").hexdigest()[:8], 16) % 1000
    assert r.ab == 0 and r.ac == pytest.approx(2 / 3) and r.ad == 0.38 and r.ae == 2.0


def test_tip_sentiment_takes_phrase_words_out(spark):
    got = {t: one(spark, S.tip_sentiment(F.lit(t)).alias("s")).s for t in ("Must try, GREAT place! good", "not worth it", "", "bad bad", "don't waste time here")}
    assert got["Must try, GREAT place! good"].sentiment == pytest.approx(5 / 6) and got[""].n_words == 0
    # "not worth" counts against, "worth it" for: both phrases hit, their words count no more
    assert got["not worth it"].sentiment == 0.0 and got["bad bad"].sentiment == pytest.approx(-2 / 3) and got["don't waste time here"].sentiment == pytest.approx(-4 / 5)


def test_null_keys_in_exploration(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, None), ("b", 3.0)], "k string, v double")
    assert tuple(eda.counts(df, "k", F.col("v") > 1).first()) == (4, 2, 3)
    dims = spark.createDataFrame([("a", "X"), (None, None)], "k string, city string")
    assert [tuple(r) for r in eda.average_by_group(df, dims, "k", "v", "city").collect()] == [("", 1.0), ("X", 1.0)]
    assert [tuple(r) for r in eda.top_k(df, "k", 2).collect()] == [(None, 2), ("a", 1)]
    assert sorted(map(tuple, eda.partition_stats(df.limit(0), "k", 3).collect())) == [(0, 0), (1, 0), (2, 0)]
    assert eda.dealt_by_crc(df, "k", 5).rdd.getNumPartitions() == 5 and eda.rmse(df.limit(0), "v", "v").first().rmse is None


def test_itemsets_by_enumeration_and_fpgrowth(spark):
    from itertools import combinations

    random.seed(1)
    held = {k: {i for i in "abcdefg" if random.random() < 0.55} for k in range(40)}
    rows = [(k, i) for k, s in held.items() for i in s] * 2
    df = spark.createDataFrame(rows, "k int, i string")
    want = {c: n for r in range(1, 8) for c in combinations("abcdefg", r) if (n := sum(set(c) <= s for s in held.values())) >= 9}
    assert {tuple(r["items"]): r["n"] for r in itemsets.frequent_itemsets(df, "k", "i", 9).collect()} == want
    assert {tuple(r["items"]): r["n"] for r in itemsets.fp_growth(df, "k", "i", 9).collect()} == want
    assert itemsets.local_support(10, 3, 9) == 4 and itemsets.frequent_itemsets(df.limit(0), "k", "i", 1).collect() == []


def test_lsh_results_are_among_the_exact_ones(spark):
    random.seed(6)
    sets = [set(random.sample(range(60), 20)) for _ in range(15)]
    sets += [s - set(random.sample(sorted(s), 2)) for s in sets]
    df = spark.createDataFrame([(d, m) for d, s in enumerate(sets) for m in s], "d int, m int")
    exact = {(r.id1, r.id2): round(r.similarity, 9) for r in lsh.exact_join(df, "d", "m").collect()}
    got = {(r.id1, r.id2): round(r.similarity, 9) for r in lsh.lsh_join(df, "d", "m").collect()}
    assert got.items() <= exact.items() and len(got) >= 0.97 * len(exact)


def test_betweenness_sums_to_distances(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (6, 7)]
    e = spark.createDataFrame(edges, "src int, dst int")
    got = {(r.src, r.dst): round(r.betweenness, 6) for r in graph.edge_betweenness(e).collect()}
    assert got == {(1, 2): 2.5, (2, 3): 2.5, (3, 4): 3.5, (1, 4): 3.5, (4, 5): 4.0, (6, 7): 1.0}
    total = graph.shortest_paths(e).where("s < t").agg(F.sum("d")).first()[0]
    assert round(sum(got.values()), 6) == total
    assert {(r.src, r.dst) for r in graph.without_heaviest(e, graph.edge_betweenness(e)).collect()} == {tuple(sorted(x)) if tuple(sorted(x)) in edges else x for x in edges} - {(4, 5)}


def test_stream_sketches_against_loops(spark):
    random.seed(3)
    keys = [str(random.randrange(80)) for _ in range(450)]
    df = spark.createDataFrame(list(enumerate(keys)), "at int, k string")
    stream = sketches.numbered(df, ["at"], 100)
    assert [r.seq for r in stream.orderBy("at").collect()] == list(range(1, 451))
    bits, seen, want = set(), set(), {}
    for i, k in enumerate(keys):
        fp, tn = want.setdefault(i // 100, [0, 0])
        x = int(k.encode().hex(), 16) % S.BLOOM_PRIME
        mine = {(a * x + b) % S.BLOOM_PRIME % S.BLOOM_BITS for a, b in S.BLOOM_PARAMS}
        if k not in seen:
            want[i // 100][0 if mine <= bits else 1] += 1
        bits |= mine
        seen.add(k)
    assert {r.batch: [r.fp, r.tn] for r in sketches.bloom_fpr(stream, "k").collect()} == want
    taken = {r.seq: (r.slot, r.key) for r in sketches.accepted(stream, "k", 100).collect()}
    slots, ends = {}, {}
    for n in range(1, 451):
        if n in taken:
            slots[taken[n][0]] = taken[n][1]
        if n % 100 == 0 or n == 450:
            ends[n] = {s: slots[s] for s in (0, 20, 40, 60, 80)}
    got = {}
    for r in sketches.reservoir(stream, "k").collect():
        got.setdefault(r.seqnum, {})[r.slot] = r.key
    assert got == ends
    fm = sketches.flajolet_martin(stream, "k").collect()
    assert all(r.truth == len(set(keys[100 * r.batch : 100 * r.batch + 100])) for r in fm) and 0.2 <= sum(r.estimate for r in fm) / sum(r.truth for r in fm) <= 5


def test_cf_by_hand(spark):
    random.seed(9)
    r = {(u, b): random.randint(1, 5) for u in range(14) for b in range(8) if random.random() < 0.8}
    train = spark.createDataFrame([(u, b, float(s)) for (u, b), s in r.items()], "u int, b int, stars double")
    mu = sum(r.values()) / len(r)
    damped = lambda i, k, beta: (sum(s for p, s in r.items() if p[i] == k) + beta * mu) / (sum(p[i] == k for p in r) + beta)
    u, b = 3, 5
    near = []
    for j in {p[1] for p in r if p[0] == u and p[1] != b}:
        common = [x for x in range(14) if (x, b) in r and (x, j) in r]
        d = [(r[x, b] - damped(1, b, 12), r[x, j] - damped(1, j, 12)) for x in common]
        if len(common) >= 5:
            near.append((sum(p * q for p, q in d) / math.sqrt(sum(p * p for p, _ in d) * sum(q * q for _, q in d)), j))
    w = [(math.copysign(max(abs(s) - 0.005, 0) ** 1.25, s), j) for s, j in near]
    base = damped(0, u, 5) + damped(1, b, 12) - mu
    want = base + sum(x * (r[u, j] - (damped(0, u, 5) + damped(1, j, 12) - mu)) for x, j in w) / sum(abs(x) for x, _ in w)
    pairs = spark.createDataFrame([(u, b), (99, b), (u, 99), (99, 99)], "u int, b int")
    got = {(p.u, p.b): p.prediction for p in cf.predict(pairs, train).collect()}
    assert got[u, b] == pytest.approx(min(5, max(1, want)))
    assert got[99, b] == pytest.approx(damped(1, b, 12)) and got[u, 99] == pytest.approx(damped(0, u, 5)) and got[99, 99] == pytest.approx(mu)


def test_ridge_and_solver(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(60, 3))
    y = a @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([(*map(float, x), float(t)) for x, t in zip(a, y)], "p double, q double, r double, y double")
    one_ = np.column_stack([np.ones(60), a])
    want = np.linalg.solve(one_.T @ one_ + np.diag([0, 0.14, 0.14, 0.14]), one_.T @ y)
    assert np.allclose(stack.fit_ridge(df, ["p", "q", "r"], "y"), want)
    assert np.allclose(stack.solve(np.array([[0.0, 2.0, 0], [4.0, 0, 0], [0, 0, 0]]), np.array([2.0, 8.0, 0])), [2, 1, 0])


def test_pairs_without_a_prediction_fall_back_to_the_base(spark):
    by_cf = spark.createDataFrame([(1, 1, 4.0, 3, 0.5)], "u int, b int, prediction double, k_used int, strength double")
    by_boost = spark.createDataFrame([(1, 1, 3.0, 0.5, 3.5, 2.0, 3.0), (2, 1, 3.0, 0.5, 2.5, 0.0, 3.0), (3, 1, 3.0, 0.5, 9.0, 0.0, 3.0)], "u int, b int, prediction double, reliance double, base double, u_n double, b_n double")
    w = np.array([0.25] + [0.0] * len(stack.META))
    got = {r.u: r.prediction for r in stack.with_fallback(stack.meta_rows(by_cf, by_boost, "right"), w).collect()}
    assert got == {1: 3.75, 2: 2.5, 3: 5.0} and stack.meta_rows(by_cf, by_boost).count() == 1


def test_scratch_belongs_to_the_application(spark):
    import os

    from lodespark import session

    path = session.scratch_path(spark, "x")
    assert spark.sparkContext.applicationId in path
    session.written(spark.range(3).toDF("v"), "x")
    other = os.path.join(session.checkpoint_dir(spark).removeprefix("file://").removeprefix("file:"), "lodespark", "other-application")
    os.makedirs(other, exist_ok=True)
    own = os.path.dirname(path).removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(own) and os.path.isdir(other)
    os.rmdir(other)


def test_feature_aggregates(spark):
    ratings = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0)], "u int, b int, stars double")
    assert X.count_percentile(spark.createDataFrame([(i,) for i in range(15)], "n int"), "n", 0.9).first().value == 12
    rows = {(r.u, r.b): r for r in X.feature_rows(spark.createDataFrame([(1, 1), (7, 8)], "u int, b int"), ratings).collect()}
    assert rows[7, 8].base == pytest.approx(11 / 3) and rows[7, 8].u_new == 1.0 and rows[1, 1].u_n == 2.0
    tips = spark.createDataFrame([("x", "2018-01-01", "good"), ("x", "2017-01-01", "bad"), (None, "2018-01-01", "good")], "business_id string, date string, text string")
    t = X.tip_features(tips, "business_id").first()
    assert (t.tip_count, t.tip_sentiment, t.tip_recent) == (2.0, 0.0, 2.0) and t.tip_decayed == pytest.approx(0.5 - 0.5 * 0.5 ** (365 / 180))


def test_bfr_finds_separate_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal([0, 40, 80][i % 3], 1, 3)]) for i in range(300)] + [(999, [500.0, -500.0, 900.0])]
    labels, rounds = bfr.cluster(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 3)
    got = {r.point: r.cluster for r in labels.collect()}
    assert len(got) == 301 and got[999] == -1
    pure = [{got[i] for i in range(300) if i % 3 == k and got[i] >= 0} for k in range(3)]
    assert all(len(p) == 1 for p in pure) and len(set.union(*pure)) == 3
    last = rounds.orderBy("round").collect()[-1]
    assert last.n_ds + last.in_cs + last.n_rs == 301


def test_sources_and_sinks(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text("user_id,business_id,stars\n u1 ,b1,4.0\nu2,,3\nu3,b3,x\nuser_id,business_id,stars\nu4,b4,5\n")
    assert sorted(map(tuple, readers.ratings(spark, str(f)).collect())) == [("u1", "b1", 4.0), ("u4", "b4", 5.0)]
    assert readers.csv_columns(spark, str(f), ["user_id", "business_id"], None).count() == 3
    t = tmp_path / "t.csv"
    t.write_text('"TRANSACTION_DT","CUSTOMER_ID","AGE","PIN","SUB","PRODUCT_ID"\n"11/1/2000","00046855","D","E","1","0004710085120468"\n"11/1/2000","1","D","E","1","00A"\n')
    assert sorted(map(tuple, readers.transactions(spark, str(t)).collect())) == [("11/1/2000-00046855", "4710085120468"), ("11/1/2000-1", "00A")]
    p = tmp_path / "p.txt"
    p.write_text("1,0,0.5,2\n\n2,1\n3,0,1,1\n")
    assert sorted(map(tuple, readers.points(spark, str(p)).collect())) == [(1, [0.5, 2.0]), (3, [1.0, 1.0])]
    j = tmp_path / "b.json"
    j.write_text(json.dumps({"business_id": "b", "city": "C", "attributes": {"NoiseLevel": "loud"}, "hours": {"Mon": "1"}, "latitude": 1.3}) + "\n{}\n")
    rows = X.business_features(readers.json_lines(spark, str(j), readers.BUSINESS)).collect()
    assert len(rows) == 1 and rows[0].b_noise_level == 2.0 and rows[0].b_hours_n == 1.0 and rows[0].b_stars == 0.0 and rows[0].b_lat_bin == 1.0
    assert readers.json_lines(spark, str(tmp_path / "none.json"), readers.TIP).count() == 0
    sets = spark.createDataFrame([(["a"],), (["b"],), (["a", "b"],)], "items array<string>")
    writers.itemset_report(sets, sets.limit(0), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()[0] == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n"
    b = spark.createDataFrame([("u", "v", 0.5), ("a", "b", 2.0)], "src string, dst string, betweenness double")
    assert [r.value for r in writers.betweenness_lines(b).collect()] == ["('a', 'b'), 2.00000", "('u', 'v'), 0.50000"]


def test_paths_and_streams(spark, tmp_path):
    from lodespark.streaming import live

    assert [readers.as_uri(x) for x in ("/a b", "file:///a", "hdfs://h/x")] == ["file:///a%20b", "file:///a", "hdfs://h/x"]
    rows = [(i, f"2020-01-01 0{i % 5}:30:00", i % 7, "k") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string").selectExpr("event_id", "cast(t as timestamp_ntz) ts", "user_id", "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = live.event_stream(spark, str(tmp_path / "events.parquet"), "*.parquet")
    assert sorted((r.start.hour, r.n) for r in live.live_windows(stream).collect()) == [(h, 8) for h in range(5)]
    kept = live.drained(stream.groupBy("event_type").count(), "complete").collect()
    assert [(r.event_type, r["count"]) for r in kept] == [("k", 40)]
    assert live.drained(stream.select("event_id"), "append").count() == 40


def test_minhash_coefficients():
    params = S.minhash_params()
    assert len(set(params)) == 60 and all(0 < a < S.MINHASH_PRIME and 0 <= b < S.MINHASH_PRIME for a, b in params) and params[:6] == S.minhash_params(6)


def test_registered_models_have_production_parameters(spark, monkeypatch):
    from lodespark.plans import catalogue

    seen = []
    monkeypatch.setattr(catalogue, "held_out", lambda *_: (None, None))
    monkeypatch.setattr(stack, "boosted_residuals", lambda a, b, p, **k: seen.append(p) or spark.range(0).selectExpr("id AS u", "id AS b", "id AS prediction"))
    monkeypatch.setattr(stack, "stacked", lambda a, b, p: seen.append(p))
    catalogue.QUERIES["gbt_predict"](spark, "")
    catalogue.QUERIES["stack_predict"](spark, "")
    assert seen == [stack.FIRST, stack.SECOND]
