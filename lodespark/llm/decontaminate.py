"""Benchmark decontamination by spaced seeds.

A mask looks at some of the words in a window and ignores the others, so a
window still matches after words at the ignored places were replaced. Each mask's
hash is taken at every word of every benchmark item and of every document; equal
hashes are joined, which gives pairs of a document and an item. A pair's hits give
diagonals (document place - item place); on each the item is laid over the
document word by word, and the best stretch that holds up against substitutions
is kept.

Words are lower-case for A-Z and without ASCII punctuation. A stretch counts +1
for an equal word and -2 for another; the one with the highest sum is taken, and
it is an overlap when it has at least `least` equal words (all but a fifth of a
shorter item) and equal words make up at least `share` of it.

Items too short for every mask are sought word for word, by a hash of all their
words: those of SHORT words and more at every word of every document, still
shorter ones only as whole texts, since such words stand in many clean texts.

A fixed set of 2**24 bits with the benchmark's hashes goes to all tasks and keeps
most places of the documents from the shuffle; it is a filter only, and the join
is exact whatever its fill. A document and a hash are joined once, however often
the hash stands in it.

Cases: null and empty texts have no words and match nothing; a null document or
item id is met by null-safe joins, and ids may have any type; documents with the
same id are told apart by their texts' MD5 and laid under each item one by one:
`overlaps` gives a row for each text, `contaminated` one for the id; of items with
one id each is sought; empty tables give an empty result; extra columns are left
out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm import grams

MASKS = ("11101011", "1101100111", "110100110101")
LEAST, SHARE, SHORT = 12, 0.75, 5
BITS = 24


def positions(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(h: np.ndarray, doc: np.ndarray, first: np.ndarray, masks: tuple[str, ...], short: tuple[int, ...] = (), items: bool = False):
    """(hash, index of a word) for every mask at every word; for each short length, of items of that length and of all documents."""
    for k, mask in enumerate(masks):
        s, at = grams.windows(h, doc, first, positions(mask), whole=False)
        yield grams.mix(s + np.uint64(k)), at
    words = np.diff(first)
    for n in short:
        s, at = grams.windows(h, doc, first, list(range(n)), whole=False)
        if items or n < SHORT:
            own = words[doc[at]] == n
            s, at = s[own], at[own]
        yield grams.mix(s + np.uint64(100 + n)), at


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return grams.word_hashes(column, grams.PUNCTUATION, lower=True)


def _least_span(masks: tuple[str, ...]) -> int:
    return min(map(len, masks))


def _length_rows(below: int):
    def run(batches):
        for batch in batches:
            for part in grams.slices(batch, 0):
                n = np.diff(_hashes(part.column(0))[2])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[(n > 0) & (n < below)]).astype(np.int32))], ["n"])

    return run


def _seed_rows(masks: tuple[str, ...], short: tuple[int, ...], bits: np.ndarray | None):
    """Each hash once for each document."""

    def run(batches):
        for batch in batches:
            for part in grams.slices(batch, 1):
                keys = [part.column(0), *part.columns[2:]]
                words = _hashes(part.column(1))
                for h, index in seeds(*words, masks, short, bits is None):
                    if bits is not None:
                        at = (h >> np.uint64(64 - BITS)).astype(np.int64)
                        on = np.flatnonzero((bits[at >> 3] >> (at & 7)) & 1)
                        h, index = h[on], index[on]
                    doc = words[1][index]
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                    whose = pa.array(doc[new])
                    yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), *[k.take(whose) for k in keys]], ["h", "id", "digest"][: 1 + len(keys)])

    return run


def diagonals(a: np.ndarray, b: np.ndarray, masks: tuple[str, ...]) -> np.ndarray:
    """Document place less item place of every hit of a mask, each once; memory in proportion to the words of both."""
    met = np.zeros(len(a) + len(b) + 1, bool)
    one = [(x, np.zeros(len(x), np.int64), np.array([0, len(x)])) for x in (a, b)]
    for (s, at), (r, by) in zip(*[seeds(*x, masks) for x in one], strict=True):
        order = np.argsort(s, kind="stable")
        s, at = s[order], at[order]
        low, high = np.searchsorted(s, r, "left"), np.searchsorted(s, r, "right")
        for y, lo, hi in zip(by[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            met[at[lo:hi] - y + len(b)] = True
    return np.flatnonzero(met) - len(b)


def bit_set(item_seeds: DataFrame) -> np.ndarray:
    """Bits of the leading part of every hash, 2 MB at most, put together before they reach the driver."""
    place = F.shiftrightunsigned("h", 64 - BITS)
    size = 4096 * 8
    rows = item_seeds.select(F.floor(place / size).cast("int").alias("part"), (place % size).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("set")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for part, bits in rows:
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch with the highest sum of +1 and -2; the first and shortest of equals."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1]) if end else 0
    return start, end, int(equal[start:end].sum())


def overlap(a: np.ndarray, b: np.ndarray, masks: tuple[str, ...], least: int, share: float) -> tuple[int, int, int, int] | None:
    """(equal words, -place in the document, words, place in the item) of the best overlap of a document and an item."""
    if len(b) < _least_span(masks):
        if len(b) < SHORT:
            return (len(b), 0, len(b), 0) if len(a) == len(b) and (a == b).all() else None
        s, at = grams.windows(a, np.zeros(len(a), np.int64), np.array([0, len(a)]), list(range(len(b))), whole=False)
        want = grams.windows(b, np.zeros(len(b), np.int64), np.array([0, len(b)]), list(range(len(b))), whole=False)[0]
        hit = at[s == want[0]]
        return (len(b), -int(hit[0]), len(b), 0) if len(hit) else None
    need = least if len(b) > least else len(b) - len(b) // 5
    best = None
    for d in diagonals(a, b, masks).tolist():
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        s, e, n = best_stretch(a[lo + d : hi + d] == b[lo:hi])
        if n >= need and n >= share * (e - s):
            found = (n, -(lo + d + s), e - s, lo + s)
            best = found if best is None or found > best else best
    return best


def _verify(masks: tuple[str, ...], least: int, share: float):
    def run(batches):
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            doc_id, digest, texts, item_id, items = batch.columns
            keep, rows = [], []
            last, a = None, None
            for i, key in enumerate(digest.to_pylist()):
                if key != last:
                    last, a = key, _hashes(texts.slice(i, 1))[0]
                item = items[i].as_py()
                b = known.get(item)
                if b is None:
                    if len(known) >= 4096:
                        known.clear()
                    b = known[item] = _hashes(pa.array([item], pa.string()))[0]
                best = overlap(a, b, masks, least, share)
                if best is not None:
                    keep.append(i)
                    rows.append((best[0], best[2], -best[1], best[3], len(b)))
            at = pa.array(keep, pa.int64())
            numbers = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([digest.take(at), doc_id.take(at), item_id.take(at), *[pa.array(c, pa.int64()) for c in numbers]], ["text_md5", *NAMES])

    return run


NAMES = ["doc_id", "item_id", "n_equal", "n_words", "doc_word", "item_word", "item_words"]


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """text_md5 and the columns of NAMES: a row for every text and benchmark item that overlap; equal texts under one id give equal rows."""
    texts = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_md5"))
    items = benchmark.select("item_id", F.col("text").alias("item"))
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    below = _least_span(masks)
    short = tuple(sorted(r.n for r in items.select("item").mapInArrow(_length_rows(below), "n int").distinct().collect()))  # fewer than `below` numbers
    item_seeds = items.mapInArrow(_seed_rows(masks, short, None), f"h bigint, id {item_kind}").withColumnRenamed("id", "_item")
    doc_seeds = texts.mapInArrow(_seed_rows(masks, short, bit_set(item_seeds)), f"h bigint, id {doc_kind}, digest binary")
    pairs = doc_seeds.join(item_seeds, "h").select("id", "digest", "_item").distinct()
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("text_md5"))
    laid = pairs.join(texts.hint("merge"), same).join(items, F.col("_item").eqNullSafe(F.col("item_id")))
    schema = f"text_md5 binary, doc_id {doc_kind}, item_id {item_kind}, " + ", ".join(f"{n} bigint" for n in NAMES[2:])
    return laid.select("doc_id", "text_md5", "text", "item_id", "item").mapInArrow(_verify(masks, least, share), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """One row for every document id and benchmark item that overlap, with the longest overlap in words."""
    found = overlaps(docs, benchmark, masks, least, share)
    best = F.max_by(F.struct(*NAMES[2:]), F.struct("n_equal", -F.col("doc_word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
