import hashlib
import random

import pytest
import sentencepiece

from lodespark.llm import pieces
from lodespark.llm.catalogue import vocabulary
from lodespark.llm.memory import ENTRY_BYTES, Generations

PATH = vocabulary("piece_bpe_32k.model")
random.seed(8)
ODD = [
    "", " ", "    ", "a", " a", "a ", "Hello, World!", "two  spaces   three", "tab\tand\nnew\r\nline", "▁ already marked ▁▁x", "naïve ÉTÉ Straße İ ﬁ", "日本語のテキスト、句読点。",
    "नमस्ते दुनिया", "👩‍👩‍👧‍👦 emoji 🏳️‍🌈", "\u0000\u0001\x7f", "�﻿", "<s></s><unk>", "x" * 41, "ab" * 60 + " " + "aa" * 45, "=" * 200, "1234567890" * 9, "ẛ̣ é", "\xa0nbsp em", "aaaaaaa aaaa aaa", "the " * 300,
]
ALPHABET = list("abcdefghijklmnoprstuvwxyz     éèßñ.,'-0189\n▁") + ["日", "本", "ж", "👍", "́", "\t"]
TEXTS = ODD + ["".join(random.choices(ALPHABET, k=random.randint(1, 120))) for _ in range(400)]


@pytest.fixture(scope="module")
def judge():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_whole_texts_equal_the_library(judge):
    """Both forms of the agenda, unit by unit and over whole texts, with ties between equal pairs."""
    m = pieces.merge_model(PATH)
    for t in TEXTS:
        want = judge.encode(t)
        assert m.encode(t) == want, t
        assert [i for u in m.units(t) for i in m.agenda(u)] == want, t
        whole = m.normalized(t)
        assert m.agenda(whole) == want, t
        assert m.decode(want) == judge.decode(want), t
    for _ in range(300):  # ids that no text gives
        ids = random.choices(range(3, len(m.text)), k=20) + random.choices([m.bytes[b] for b in range(256)], k=6)
        random.shuffle(ids)
        assert m.decode(ids) == judge.decode(ids)


def test_spaces_that_encoding_did_not_add_are_kept(judge):
    """Ids that begin with a byte, unknown or control piece, and bytes that spell a space mark."""
    m = pieces.merge_model(PATH)
    mark, word, unknown = m.ids["▁"], judge.encode("the cat"), m.unknown
    space, spelled, control = m.bytes[32], [m.bytes[b] for b in "▁".encode()], [i for i, k in enumerate(m.kind) if k == pieces.CONTROL]
    for ids in ([space, *word], [space], [unknown, *word], [mark, mark, *word], [mark], [mark, space, *word], spelled, [*spelled, *word], [*word, *spelled], [*control, *word], [*control, mark], [*control, space, mark], control, []):
        assert m.decode(ids) == judge.decode(ids), ids


def test_query_over_odd_rows(spark, judge):
    rows = [(i if i % 7 else None, t, i, "x", [1]) for i, t in enumerate(TEXTS)] + [(3, None, 0, "x", None), (3, TEXTS[6], 0, "x", None), (3, TEXTS[6], 0, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, ids_sha256 string, ids array<int>").repartition(3)
    got = pieces.encode(df, PATH, keep_ids=True, keep_text=True).collect()
    want = []
    for i, t, *_ in rows:
        ids = judge.encode(t or "")
        text = judge.decode(ids)
        want.append((i is not None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids), r.decoded) for r in got) == sorted(want)
    assert pieces.encode(df.limit(0), PATH).collect() == []


def test_a_very_long_text(spark, judge):
    text = " ".join("".join(random.choices("abcdeéo", k=random.randint(1, 9))) for _ in range(150_000)) + "y" * 30_000
    r = pieces.encode(spark.createDataFrame([("k", text)], "doc_id string, text string"), PATH).first()
    ids = judge.encode(text)
    assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(judge.decode(ids).encode()).hexdigest()


def test_a_wrong_agenda_stops_the_job():
    memory = pieces.Memory(PATH)
    memory.model = type("Wrong", (), {"prefix": True, "side_by_side": lambda self, units: [[5]] * len(units), "decimal": [], "decode_unit": str})()
    with pytest.raises(ValueError, match="disagree"):
        memory.learn({"▁hello"})


def test_memory_keeps_what_is_met_again():
    g = Generations(2, limit=10 * (ENTRY_BYTES + 6))
    for k in range(200):
        want = {"often", f"w{k}", f"w{max(0, k - 1)}"}
        new = g.missing(want)
        assert "often" not in new or k == 0
        g.add(new, [w.upper() for w in new], [w[::-1] for w in new])
        assert all(g.recent[0][w] == w.upper() and g.recent[1][w] == w[::-1] for w in want)
        assert len(g.recent[0]) + len(g.old[0]) < 30
