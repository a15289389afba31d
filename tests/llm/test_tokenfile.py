import io
import json
import random
import zlib

import numpy as np
import pytest
import zstandard

from lodespark.llm import tokenfile
from lodespark.llm.catalogue import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World! it's 42", "ÉTÉ naïve\tx\x0by   z", "a" * 3000, "<|endoftext|> x<|y", "don'T I'LL 'S ''s", "日本語 Ωσς", "word " * 5000, "\x1c\x1d a\x85b", "İSTANBUL ﬁ", "A\r\nB", "Ŀ·ŀ ŉ µ² ½x ªº Å Å ÷×¿ ß SS ſt İ\xa0x <3", "L'ÉTÉ'S ÀÉ\u0301 Ǆ"]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_words_equal_whole_texts():
    got = tokenfile.words_of(PATH).encode([t or "" for t in TEXTS], 2)
    for text, ids in zip(TEXTS, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole(text)


@pytest.mark.parametrize("frame_ids", [1, 7, 1 << 16])
def test_file_round_trip_reads_single_documents(frame_ids):
    docs = [(i if i != 3 else None, np.arange(n, dtype="<u4")) for i, n in enumerate([0, 5, 100, 1, 0, 33])]
    sink = io.BytesIO()
    w = tokenfile.Writer(sink, frame_ids)
    for i, ids in docs:
        w.add(i, ids.tobytes())
    w.close()
    f = tokenfile.TokenFile(io.BytesIO(sink.getvalue()))
    assert [(i, np.frombuffer(b, "<u4").tolist()) for i, _, b in f.scan()] == [(i, d.tolist()) for i, d in docs]
    assert f.find(2)[0].tolist() == list(range(100)) and f.find(0)[0].tolist() == [] and f.find(9) == []
    out, d = b"", zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
    out = d.decompress(sink.getvalue())
    assert out.startswith(docs[1][1].tobytes())


def test_a_flipped_bit_is_found():
    sink = io.BytesIO()
    w = tokenfile.Writer(sink)
    w.add(1, np.arange(1000, dtype="<u4").tobytes())
    w.close()
    raw = bytearray(sink.getvalue())
    raw[40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.TokenFile(io.BytesIO(bytes(raw))).ids(0)


def test_query_over_odd_rows(spark):
    rows = [(i % 9 if i else None, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    got = tokenfile.write_and_read(df, PATH, 2, keep_ids=True).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert sorted(tuple(r["ids"]) for r in got) == sorted(tuple(whole(t)) for t in TEXTS)
    assert tokenfile.write_and_read(df.limit(0), PATH, 2).collect() == []


def test_new_parts_reach_the_library_in_few_strings():
    """Thousands of new words are a string or two; ids are the library's for each part, also where ends can't be told from the vocabulary."""
    words = tokenfile.Words(PATH)
    library, sent = words.tokenizer, []

    class Counting:
        def encode_batch_fast(self, strings, add_special_tokens):
            sent.extend(strings)
            return library.encode_batch_fast(strings, add_special_tokens=add_special_tokens)

    draw = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyzéßñœſ'ıŉ"
    made = {"".join(draw.choices(letters, k=draw.randint(1, 12))) + draw.choice(["", "", ",", "!'", "''s", "42", "¼!", "İ", "'S", "\xad"]) for _ in range(6000)}
    assert not any(tokenfile.UNSETTLED.fullmatch(w) for w in made)
    want = {w: library.encode(w, add_special_tokens=False).ids for w in made}
    words.tokenizer = Counting()
    text = " ".join(made)
    assert np.frombuffer(words.encode([text], None)[0], "<u4").tolist() == [i for w in text.split(" ") for i in want[w]]
    assert len(sent) <= 3
    parts = sorted(set(tokenfile.PARTS.findall(text.lower())) - {"\n"})
    each = words._library(parts)
    assert words._side_by_side(parts) == each and words._side_by_side([]) == []
    words.ends = None
    assert words._side_by_side(parts) == each
    words.ends = np.ones(60_000, bool)  # ends that don't fit
    assert words._side_by_side(parts) == each


@pytest.mark.parametrize("change", [{"end_of_word_suffix": None}, {"unk_token": "a"}, {"dropout": 0.1}, {"merges": [["a</w>", "b"]]}, {"merges": ["</ w>"]}, {"vocab": {"a": 0, "a</w>": 1}}])
def test_ends_of_parts_need_a_vocabulary_that_marks_them(tmp_path, change):
    words = tokenfile.Words(PATH)
    assert words.ends is not None
    with open(PATH, "rb") as f:
        model = json.load(f)["model"]
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps({"model": model | change}))
    assert words._ends(str(path)) is None
