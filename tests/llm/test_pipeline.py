import hashlib

import sentencepiece

import corpus_pipeline
from lodespark.llm import decontaminate, neardup, quality, secretscan
from lodespark.llm.catalogue import table, vocabulary
from lodespark.session import written

D = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    """Each stage against its operator's own verdicts (which have brute-force tests) and the library's ids."""
    docs = table(spark, D, "documents")
    start = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.quality_rules(docs, table(spark, D, "labels")).where("kept").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, D)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept and 0 < len(kept) < len(start)
    one = written(one, "one")
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(one).collect()}
    two = written(corpus_pipeline.near_duplicates(spark, one, D), "stage")
    assert {r.doc_id for r in two.collect()} == set(classes.values()) and len(set(classes.values())) < len(classes)
    hits = {r.doc_id for r in decontaminate.contaminated(two, table(spark, D, "benchmark")).collect()}
    three = written(corpus_pipeline.decontamination(spark, two, D), "stage")
    assert {r.doc_id for r in three.collect()} == set(classes.values()) - hits
    four = written(corpus_pipeline.secret_scans(spark, three, D), "stage")
    clean = {r.doc_id: r.text for r in four.collect()}
    assert not [r for r in secretscan.secret_report(four).collect() if r.spans]
    spans = {r.doc_id for r in secretscan.secret_report(three).collect() if r.spans}
    assert {i for i, t in clean.items() if t != start[i].text} == spans
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = {}
    for i, t in clean.items():
        ids = library.encode(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, D).collect()} == want


def test_clean_texts_stay_beside_a_hit(spark):
    """A hit removes its own text, not all that stands under its id."""
    passage = next(r.text for r in table(spark, D, "benchmark").orderBy("item_id").collect() if r.text and len(r.text.split()) > 20)
    clean = [" ".join(f"{w}{i}" for i in range(30)) for w in "abc"]
    rows = [(None, clean[0]), (None, "So: " + passage), (5, clean[1]), (5, passage + " end"), (None, None), (5, None), (6, clean[2]), (7, passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.decontamination(spark, docs, D)
    assert kept.columns == docs.columns
    want = [(None, clean[0]), (5, clean[1]), (None, None), (5, None), (6, clean[2])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = table(spark, D, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).collect() == []


def test_odd_rows_in_every_stage(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, ids of several texts, clashing names."""
    prose = " ".join(f"word{i % 97} of{i % 31} the{i % 53}" for i in range(60))
    long = " ".join(f"{w}{i}" for i in range(40_000) for w in ("alpha", "beta"))
    texts = [None, "", " \n\t", prose, prose, prose + " more", long, "password = hunter2hunter2hunter2 " + prose[::-1], prose[::-1]]
    rows = [(i if i % 4 else None, t, None if i % 3 else "en", None, None, "x", 0, True) for i, t in enumerate(texts)] + [(3, prose, "en", "s", 1, "y", 1, False)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, h int, kept boolean").repartition(3)
    n, text = len(rows), lambda df: sorted((r.text or "" for r in df.collect()))
    one = corpus_pipeline.quality_rules(spark, docs, D)
    assert one.columns == corpus_pipeline.COLUMNS and set(text(one)) <= {t or "" for t in texts} and "" not in text(one)
    two = corpus_pipeline.near_duplicates(spark, docs, D)
    assert two.columns == corpus_pipeline.COLUMNS and {t for t in text(two) if t.strip()} == {prose, long, texts[8]} and len(text(two)) == 6
    three = corpus_pipeline.decontamination(spark, docs, D)
    assert three.columns == corpus_pipeline.COLUMNS and len(text(three)) == n
    four = corpus_pipeline.secret_scans(spark, docs, D)
    assert four.columns == corpus_pipeline.COLUMNS and len(text(four)) == n and not any("hunter2hunter2" in t for t in text(four))
    five = corpus_pipeline.sentencepiece(spark, docs, D)
    assert five.count() == n and five.where("n_tokens = 0").count() == 2
