import math
import re
from collections import Counter

import pytest
import xxhash

from lodespark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
B = 64


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return signed(seed) % B


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return words, (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def brute(rows, labels, threshold):
    trusted = {i for i, _ in labels if i is not None and {q for j, q in labels if j == i and q is not None} == {1}}
    raw, target = [1] * B, [1] * B
    for i, text in rows:
        w = base(text)[0]
        for g in [hashed(x) for x in w] + [hashed(a, b) for a, b in zip(w, w[1:])]:
            raw[g] += 1
            target[g] += i in trusted
    any_trusted = sum(target) > B
    ws = [round(math.log(t / sum(target)) - math.log(r / sum(raw)), 6) if any_trusted else 0.0 for t, r in zip(target, raw)]
    out = []
    for i, text in rows:
        w, counts = base(text)
        g = [hashed(x) for x in w] + [hashed(a, b) for a, b in zip(w, w[1:])]
        score = sum(ws[x] for x in g) / len(g) if g else 0.0
        out.append((i, *counts, score, not counts[-1] and score >= threshold))
    return out


CLEAN = " ".join(f"w{i % 37}x{i * i % 11}" for i in range(120))
ROWS = [
    (1, CLEAN), (2, "a b c a b c"), (3, ""), (4, None), (None, "x\ty\x0bz\n\n \nx\n x\nx"), (5, "### $$ <b> é日本 " * 30),
    (6, CLEAN + "\nend\nend"), (1, "same id " + CLEAN), (7, "word"), (8, "a b"), (9, "lone space kept " * 60), (10, "z " * 5000), (11, " \t\r\n"),
]
LABELS = [(1, 1), (1, 1), (5, 0), (6, 1), (6, 0), (None, 1), (10, None), (99, 1), (9, 1)]


@pytest.mark.parametrize("labels", [LABELS, []])
def test_against_brute_force(spark, labels):
    docs = spark.createDataFrame([(i, t, "z") for i, t in ROWS], "doc_id bigint, text string, words string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality.quality_rules(docs, lab, threshold=-0.05, buckets=B).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    got = sorted([tuple(r[n] for n in names) for r in got], key=key)
    want = sorted(brute(ROWS, labels, -0.05), key=key)
    assert [g[:7] + g[8:] for g in got] == [w[:7] + w[8:] for w in want]
    assert [g[7] for g in got] == pytest.approx([w[7] for w in want], abs=2e-6)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.quality_rules(docs, spark.createDataFrame([], "doc_id bigint, quality int"), buckets=B).collect() == []
