import random
import re

from lodespark.llm import decontaminate as D
from lodespark.llm import grams

random.seed(5)
VOC = [f"w{i}" for i in range(400)]


def text(n, punct=True):
    return " ".join(random.choice(VOC) + (random.choice(",.") if punct and random.random() < 0.1 else "") for _ in range(n))


def tokens(t):
    return [x for x in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if x]


def brute(docs, items):
    """Every diagonal of every pair that some mask hits."""
    out = {}
    for i, t in docs:
        a = tokens(t)
        for j, s in items:
            b = tokens(s)
            diagonals = set()
            for m in D.MASKS:
                p = D.positions(m)
                for x in range(len(a) - p[-1]):
                    for y in range(len(b) - p[-1]):
                        if all(a[x + k] == b[y + k] for k in p):
                            diagonals.add(x - y)
            if 0 < len(b) < 8:
                hits = [x for x in range(len(a) - len(b) + 1) if a[x : x + len(b)] == b]
                if hits and (len(b) >= D.SHORT or len(a) == len(b)):
                    out[i, j] = (len(b), len(b))
                continue
            need = D.LEAST if len(b) > D.LEAST else len(b) - len(b) // 5
            for d in diagonals:
                lo, hi = max(0, -d), min(len(b), len(a) - d)
                best = (-1, 0, 0, 0)
                for s0 in range(lo, hi):
                    score = n = 0
                    for e0 in range(s0, hi):
                        same = a[e0 + d] == b[e0]
                        score, n = score + (1 if same else -2), n + same
                        if (score, -(e0 + 1 - s0), 0) > (best[0], -best[1], 0):
                            best = (score, e0 + 1 - s0, n, s0 + d)
                if best[2] >= need and best[2] >= D.SHARE * best[1]:
                    out[i, j] = max(out.get((i, j), (0, 0)), (best[2], best[1]))
    return {(i, j, *v) for (i, j), v in out.items()}


def test_against_brute_force(spark):
    items = [(1, text(20)), (2, text(40)), (3, "too short here"), (4, None), (5, text(9, False)), (None, text(16))]
    swap = lambda t, k: " ".join("zzz" if i % k == k - 1 else w for i, w in enumerate(t.split()))
    docs = [(10, text(50)), (11, text(20) + " " + items[0][1].upper() + " " + text(5)), (12, swap(items[1][1], 7) + "\n" + text(30)), (13, None), (14, ""), (15, items[4][1])]
    items += [(6, "What is the capital of France?"), (7, "only whole"), (8, text(7, False)), (9, "a b c d e"), (9, "same id but seven other words here")]
    docs += [(20, "what is the CAPITAL of france"), (21, text(9) + " What is the capital -- of France " + text(3)), (22, "only, whole!"), (23, "not only whole"), (24, "what is the capital of spain"), (25, items[8][1] + " " + items[8][1]), (26, "seven other same id but seven other words here")]
    docs += [(16, swap(items[0][1], 3)), (None, items[5][1]), (17, " ".join(items[1][1].split()[10:26])), (17, items[0][1]), (18, (items[0][1] + " ") * 3)]
    a = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.n_equal, r.n_words) for r in D.contaminated(a, b).collect()}
    assert got == brute(docs, items)
    assert {(r[0], r[1]) for r in got} >= {(11, 1), (12, 2), (15, 5), (17, 2), (17, 1), (18, 1), (None, None)}
    assert {(r[0], r[1]) for r in got} >= {(20, 6), (21, 6), (22, 7), (25, 8), (26, 9)}
    assert not [r for r in got if r[0] in (10, 13, 14, 23, 24)]
    assert D.contaminated(a.limit(0), b).collect() == [] and D.contaminated(a, b.limit(0)).collect() == []


def test_windows_stay_inside_documents():
    import pyarrow as pa

    h, doc, first = grams.word_hashes(pa.array(["a b c", None, "", "a b c d", "x"]))
    assert first.tolist() == [0, 3, 3, 3, 7, 8] and h[0] == h[3] and h[2] == h[5] and len(set(h.tolist())) == 5
    s, at = grams.windows(h, doc, first, [0, 1, 2], whole=True)
    assert at.tolist() == [0, 3, 4, 7] and s[0] == s[1]


def test_a_repetitive_text_and_string_ids(spark):
    """Places of a hash multiply in no table: 60,000 equal words against 400."""
    a = spark.createDataFrame([("x", "again " * 60_000), ("y", text(60_000)), ("y", "one two three four five six seven eight nine")], "doc_id string, text string")
    b = spark.createDataFrame([("i", "again " * 400), ("j", "one two three four five six seven eight")], "item_id string, text string")
    assert {(r.doc_id, r.item_id, r.n_equal, r.doc_word) for r in D.contaminated(a, b).collect()} == {("x", "i", 400, 0), ("y", "j", 8, 0)}
