import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodespark.llm import langid as L
from lodespark.llm.catalogue import table


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    p = L._init(3, rng)
    x = rng.integers(97, 101, (7, 5))
    x[5:, 1] = L.PAD
    x[1:, 3] = L.PAD
    y = np.array([0, 1, 2, 1, 0])
    _, g = L.loss_and_gradient(p, x, y)
    for k in p:
        for at in [tuple(rng.integers(0, n) for n in p[k].shape) if k[0] != "W" else (98, rng.integers(0, 24)) for _ in range(6)]:
            keep = p[k][at]
            p[k][at] = keep + 1e-5
            up = L.loss_and_gradient(p, x, y)[0]
            p[k][at] = keep - 1e-5
            down = L.loss_and_gradient(p, x, y)[0]
            p[k][at] = keep
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_reader_equals_the_trained_network_and_covers_whole_texts():
    rng = np.random.default_rng(4)
    p = L._init(3, rng)
    texts = ["abc déf " * 90, "", None, "x", "y" * L.WINDOW]
    got = L.Reader(p).documents(pa.array(texts), rows=3)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        total = np.zeros(3)
        for lo in range(0, len(data), L.WINDOW):
            x = np.array(list(data[lo : lo + L.WINDOW]))[:, None]
            keep = np.ones(x.shape)
            f = L._side(p["Wf"], p["Uf"], x, keep)[0]
            b = L._side(p["Wb"], p["Ub"], x[::-1], keep)[0][::-1]
            for s, r in zip(f, b, strict=True):
                o = np.exp(s @ p["Vf"] + r @ p["Vb"] + p["c"])[0]
                total += o / o.sum()
        assert np.allclose(got[i], total / max(len(data), 1), atol=1e-5)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "123 !!", "fr"), (None, "the of and", None)], "doc_id bigint, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd)
    got = L.identify(both).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == 1004
    held = [r for r in got if r.held_out and r.lang]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (-1, -2, -3)] == [("und", 0.0)] * 3 and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    none = L.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert L.identify(both.limit(0)).collect() == []


def test_the_sample_is_bounded_whatever_ids_repeat(spark):
    """20,000 labelled rows under one null id, clashing columns, and equal rows: at most so many rows a language, each text once."""
    rows = [(None, f"text number {i % 7000} of many", "en" if i % 2 else "fr", i, 0.5) for i in range(20_000)] + [(5, "seul", "es", 1, 0.1)] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, place int, score double").repartition(7)
    texts, labels, names = L.sample(docs, F.lit(True), 60)
    assert names == ["en", "es", "fr"] and [labels.count(k) for k in range(3)] == [60, 1, 60]
    assert len({(t, k) for t, k in zip(texts, labels)}) == 121
    again = L.sample(docs.repartition(3), F.lit(True), 60)
    assert again == (texts, labels, names)
    got = L.identify(docs).where("doc_id IS NULL").limit(5).collect()
    assert all(r.lang_pred in names and r.held_out is False for r in got)


def test_training_sees_whole_texts():
    """Only the far ends of the texts tell the two languages apart."""
    texts = ["x" * 6400 + "abab" * 1600, "x" * 6400 + "cdcd" * 1600]
    p = L.train(texts * 3, [0, 1] * 3, 2, steps=120)
    q = L.Reader(p).documents(pa.array(["abab" * 60, "cdcd" * 60]))
    assert q[0, 0] > 0.9 and q[1, 1] > 0.9
