import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodespark.llm import ctw

TEXTS = ["the cat sat on the mat.", "The CAT ran; 42 cats!", "été à la plage", "", None, "aaaaaaaaaabbbbbbbb", "tab\there\nnew line", "the then this that these", "日本 the cat", "zz top the cat sat"]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def lowered(t):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")


def decisions(t):
    """(context, latest byte first; the bits decided so far; the next bit) of every binary decision, from the definition."""
    seen = [ctw.EDGE] * ctw.DEPTH
    for b in [*lowered(t).encode(), ctw.EDGE]:
        for k in range(8):
            yield tuple(reversed(seen[-ctw.DEPTH :])), (k, b >> (8 - k)), b >> (7 - k) & 1
        seen.append(b)


def brute_score(train, texts):
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in train:
        for ctx, node, bit in decisions(t):
            for d in range(ctw.DEPTH + 1):
                counts[node, ctx[:d]][bit] += 1
                if d < ctw.DEPTH:
                    children[node, ctx[:d]].add(ctx[: d + 1])
    memo = {}

    def log_kt(node, ctx):
        a, b = counts.get((node, ctx), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_w(node, ctx, leaf):
        """The mixture at a node of the tree that ends at depth `leaf`."""
        if len(ctx) == leaf:
            return log_kt(node, ctx)
        if (node, ctx, leaf) not in memo:
            memo[node, ctx, leaf] = np.logaddexp(log_kt(node, ctx), sum(log_w(node, k, leaf) for k in children[node, ctx])) - math.log(2)
        return memo[node, ctx, leaf]

    def p_one(node, ctx, d=0):
        a, b = counts.get((node, ctx[:d]), (0, 0))
        kt = (b + 0.5) / (a + b + 1)
        if d == ctw.DEPTH or ctx[: d + 1] not in children.get((node, ctx[:d]), ()):
            return kt
        w = math.exp(log_kt(node, ctx[:d]) - math.log(2) - log_w(node, ctx[:d], ctw.OUTER if d < ctw.OUTER else ctw.DEPTH))
        return w * kt + (1 - w) * p_one(node, ctx, d + 1)

    return [sum(math.log10(p if bit else 1 - p) for ctx, node, bit in decisions(t) for p in [p_one(node, ctx)]) for t in texts]


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_scores_equal_the_definition(spark, monkeypatch, block):
    """In one block and in many, whose windows cut through texts."""
    monkeypatch.setattr(ctw, "BLOCK", block)
    monkeypatch.setattr(ctw, "WINDOW", min(block, ctw.WINDOW))
    rows = list(enumerate(TEXTS)) + [(1, TEXTS[1]), (None, "null id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, row int").repartition(3)
    got = sorted(ctw.score(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    train = [t for i, t in rows if i is None or not held(i)]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [None]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    assert any(r.held_out for r in got) and not all(r.held_out for r in got)
    for (i, t), r, s in zip(rows, got, brute_score(train, [t for _, t in rows]), strict=True):
        w = words(t)
        assert (r.doc_id, r.held_out) == (i, i is not None and held(i))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs=1e-8)
        # an answer has steps of 1/1024
        assert r.score == pytest.approx(s, abs=(len((t or "").encode()) + 1) / ctw.SCALE / 2)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / max(1, len((t or "").encode())))


def test_logs_equal_the_definition_closely():
    data, offsets = ctw.grams.flat(pa.array(TEXTS))
    trained = np.array([i % 3 > 0 for i in range(len(TEXTS))])
    keys, counts = ctw.block_pairs(data, offsets, trained)
    three = defaultdict(lambda: np.zeros((1, 256), np.int64))
    for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
        if n:
            three[k >> 40][0, k & 255] += n
    two = sorted({k >> 8 for k in three})
    rows = [[v for k, v in three.items() if k >> 8 == t] for t in two]
    outer = ctw.Outer(np.array(two), np.array([sum(r)[0] for r in rows]), np.array([sum(ctw.log_kt(*ctw.decisions(x)) for x in r)[0] for r in rows]))
    logs = dict(zip(keys.tolist(), ctw.pair_logs(keys, counts, outer).tolist(), strict=True))
    flat, symbol, starts = ctw.padded(data, offsets)
    at, key = next(ctw.windows_of_keys(flat, symbol))
    got = np.bincount(np.searchsorted(starts, at, "right") - 1, [logs[k] for k in key.tolist()], len(TEXTS))
    want = brute_score([t for t, x in zip(TEXTS, trained, strict=True) if x], TEXTS)
    assert np.allclose(got, want, atol=2e-5)  # the outer rows are in single precision


def test_every_context_gives_a_distribution():
    """The probabilities of all 256 symbols after one context add up to one, met or not."""
    data, offsets = ctw.grams.flat(pa.array(TEXTS))
    keys, counts = ctw.block_pairs(data, offsets, np.ones(len(TEXTS), bool))
    outer = ctw.Outer(np.array([0x6874]), np.full((1, 256), 3), np.full((1, 255), -9.0))
    for context in (keys[5] >> np.uint64(8), np.uint64(0x20616161616161), np.uint64(0x68742020202020)):
        more = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        k, n = ctw._merged([(keys, counts), (more, np.zeros(256, np.int64))])
        logs = ctw.pair_logs(k, n, outer)[np.searchsorted(k, more)]
        assert abs((10.0**logs).sum() - 1) < 1e-5
    assert np.allclose(ctw.log_gamma(np.array([0.5, 1, 3.5, 200])), [math.lgamma(x) for x in (0.5, 1, 3.5, 200)])
    assert np.allclose(ctw.log_kt(np.array([0, 3, 40_000]), np.array([0, 1, 9])), [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in ((0, 0), (3, 1), (40_000, 9))])


def test_what_training_never_met_and_copies_of_a_text(spark):
    """Held-out copies of learned texts have shorter codes on the mean than other texts of the same words; without training every bit costs one."""
    import random

    rng = random.Random(4)
    voc = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choices(voc, k=80)) for _ in range(160)]
    ids = [i for i in range(2000) if held(i)][:20], [i for i in range(2000) if not held(i)][:160]
    rows = list(zip(ids[1], texts, strict=True)) + [(i, texts[k] if k < 10 else " ".join(rng.choices(voc, k=80))) for k, i in enumerate(ids[0])]
    got = {r.doc_id: r.bits_per_byte for r in ctw.score(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()}
    copies, others = [got[i] for i in ids[0][:10]], [got[i] for i in ids[0][10:]]
    assert np.mean(copies) < np.mean(others) - 0.03
    alone = ctw.score(spark.createDataFrame([(ids[0][0], "abc", 1)], "doc_id bigint, text string, score int")).first()
    assert alone.score == pytest.approx(4 * 8 * math.log10(0.5), abs=4 / ctw.SCALE) and (alone.n_known, alone.train_tokens) == (0, 0)


def test_empty_table_and_string_ids(spark):
    assert ctw.score(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    r = ctw.score(spark.createDataFrame([("a", "x" * 70_000, 1), ("b", "\x00\x01 x", 1)], "doc_id string, text string, logs int").repartition(2)).collect()
    assert sorted(x.doc_id for x in r) == ["a", "b"] and all(x.score < 0 for x in r)


def plain_pairs(data, offsets, trained):
    flat, symbol, starts = ctw.padded(data, offsets)
    key, whose = (np.concatenate(x) for x in zip(*[(k, np.searchsorted(starts, at, "right") - 1) for at, k in ctw.windows_of_keys(flat, symbol)], strict=True))
    keys = np.unique(key)
    return keys, np.bincount(np.searchsorted(keys, key[trained[whose]]), minlength=len(keys))


@pytest.mark.parametrize("window", [5, 300, ctw.WINDOW])
def test_pairs_by_ranges_of_bytes_equal_those_of_the_whole_block(monkeypatch, window):
    """Texts with every byte of UTF-8, of one byte only, shorter than a context, and none at all."""
    monkeypatch.setattr(ctw, "WINDOW", window)
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(1, 0x2000, 400))), "x" * 900, "", "a", None, "".join(map(chr, rng.integers(97, 105, 900)))]
    for some in (texts, ["", None], ["x" * 50] * 4, texts[::-1]):
        data, offsets = ctw.grams.flat(pa.array(some, pa.string()))
        for trained in (rng.random(len(some)) < 0.5, np.ones(len(some), bool), np.zeros(len(some), bool)):
            keys, counts = ctw.block_pairs(data, offsets, trained)
            want, n = plain_pairs(data, offsets, trained)
            assert np.array_equal(keys, want) and np.array_equal(counts, n)
            assert np.array_equal(ctw.bucket_of(ctw.PAIRS, keys, 37), [int(ctw.grams.mix(np.array([(k >> 40) + 1], np.uint64))[0] % np.uint64(37)) for k in keys.tolist()])


def test_a_block_of_distinct_contexts_takes_little_memory():
    """A block's pairs and their buckets, for bytes that never repeat a context, in bytes of arrays for each byte of text: 70 and 40 before."""
    data = np.random.default_rng(6).integers(32, 127, 4 << 20).astype(np.uint8)
    offsets = np.arange(0, len(data) + 1, 4096)
    trained = np.arange(len(offsets) - 1) % 5 != 1
    tracemalloc.start()
    try:
        keys, _ = ctw.block_pairs(data, offsets, trained)
        pairs = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        ctw.bucket_of(ctw.PAIRS, keys, 200)
        buckets = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(keys) > 0.99 * len(data)
    assert pairs < 52 * len(data) and buckets < 34 * len(data), (pairs / len(data), buckets / len(data))
