"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash at a byte sums a table value of each of the last 16 bytes, shifted
by its distance. A chunk begins at the lowest hash, the leftmost of equals, of any
WINDOW bytes in a row. Whatever stands in both of two texts over SURE bytes has two
such windows apart from each other whose hashes are the same in both, so two cuts at
least, all cuts between them, and a whole chunk are the same: none is missed, and
over fifty words are SURE bytes or more. Chunks are 22 bytes on average and begin at
a character. A chunk's digest takes in the LEAD bytes before it, so that a short
chunk isn't repeated by chance.

Chunks are compared by a 64-bit digest over the whole corpus. A chunk is repeated
when it also stands in an earlier document (the least id, then the hash of the
text). Neighbouring repeated chunks make a run. From its first and its last chunk
a run is extended byte by byte as far as the earlier documents with these chunks
agree, and it is reported when it then has over `most_words` whole words. The first
shared chunk begins within BEFORE bytes of a passage's start and the last one ends
within AFTER bytes of its end; runs that can't have enough words even so are left out
before any text is looked at, which loses nothing. Passages under SURE bytes, which
only a lower `most_words` asks for, are found where they share a chunk.

A task first settles the chunks of its own block of documents: of each digest only
the block's earliest document goes on to the shuffle, the others are repeated
whatever comes. So the most frequent chunk is one row for each block there. Texts
are shuffled once, narrowed to what stands around the ends of runs.

Cases: null and empty texts have no chunks; rows with the same id and the same
text count once; a null id sorts first; repeats inside one text are not reported;
empty tables give an empty result; extra columns are left out. Positions count
code points, the end is exclusive. Which of several earlier documents is named can
depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.llm import grams
from lodespark.session import written

REACH = 12
LEAD, WINDOW = 15, 43
SURE = LEAD + 2 * WINDOW
#: A cut stands up to LEAD + WINDOW - 1 bytes after a passage's start, and up to three more, on the next character.
BEFORE, AFTER = 64, 48
MOST_WORDS = 50
#: Chunks of a block, some 30 MB of text.
BLOCK = 1 << 20
GEAR = (grams.LETTER >> np.uint64(32)).astype(np.uint32)
_PAD = 64


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash over the last 16 bytes at every byte, by doubling the window."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def _least_of(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values from a place on."""
    out, have = h, 1
    while have < n:
        step = min(have, n - have)
        nxt = out.copy()
        np.minimum(out[:-step], out[step:], out=nxt[:-step])
        out, have = nxt, have + step
    return out


def cuts(data: np.ndarray) -> np.ndarray:
    """Places whose hash is below those of the REACH bytes before and not above those of the REACH bytes after. They can be any distance apart."""
    h = gear(data)
    least = _least_of(h, REACH)
    at = np.arange(REACH, max(REACH, len(h) - REACH))
    return at[(h[at] < least[at - REACH]) & (h[at] <= least[at + 1])]


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """Places whose hash is the lowest of some WINDOW in a row, the leftmost of equals; WINDOW or less apart."""
    h, step, found = gear(data), 1 << 20, []
    for lo in range(0, max(1, len(h) - WINDOW + 1), step):
        some = h[lo : lo + step + WINDOW - 1].astype(np.uint64) << np.uint64(32)
        some |= np.arange(lo, lo + len(some), dtype=np.uint64)
        at = (_least_of(some, WINDOW)[: max(1, len(some) - WINDOW + 1)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        found.append(at[np.concatenate([[True], at[1:] != at[:-1]])])
    return np.unique(np.concatenate(found))


def chunks(column: pa.Array, rule=cuts, lead: int = 0) -> tuple[np.ndarray, ...]:
    """(document, number in the document, digest, start, end in code points, bytes, first byte in the column) of every chunk.

    Digests take in up to `lead` bytes of the text before the chunk.
    """
    data, offsets = grams.flat(column)
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    if not len(full):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 4
    spaced = np.zeros(len(data) + _PAD * (len(full) + 1), np.uint8)  # a gap before each text, so that none sees another
    shift = _PAD * np.arange(1, len(full) + 1)
    for k, d in enumerate(full.tolist()):
        a, b = int(offsets[d]), int(offsets[d + 1])
        spaced[a + shift[k] : b + shift[k]] = data[a:b]
    found = rule(spaced)
    which = np.searchsorted(offsets[full] + shift, found, "right") - 1
    inside = which >= 0
    found, which = found[inside], which[inside]
    place = found - shift[which]
    ok = (place > offsets[full][which]) & (place < offsets[full + 1][which])
    heads = (data & 0xC0) != 0x80
    letters = np.flatnonzero(heads)
    moved = np.searchsorted(letters, place[ok])
    moved = np.append(letters, len(data))[moved]  # on to the next character
    begin = np.unique(np.concatenate([offsets[full], moved[moved < len(data)]]))
    end = np.append(begin[1:], len(data))
    doc = np.searchsorted(offsets, begin, "right") - 1
    digest = grams.hashes(data, np.maximum(begin - lead, offsets[doc]), end)
    points = np.concatenate([[0], np.cumsum(heads)])
    base = points[offsets[doc]]
    first = np.searchsorted(doc, doc)
    return doc, np.arange(len(doc)) - first, digest, points[begin] - base, points[end] - base, end - begin, begin


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Word beginnings before each byte of the column, and in all."""
    w = grams.BLANKS[data]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    head = offsets[:-1][np.diff(offsets) > 0]
    begin[head] = w[head]
    return np.concatenate([[0], np.cumsum(begin)])


def shared_chunks(column: pa.Array) -> tuple[np.ndarray, ...]:
    """The chunks that documents are compared by."""
    return chunks(column, sure_cuts, LEAD)


def _around(begin: np.ndarray, size: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every chunk: BEFORE bytes before it and AFTER bytes after it, within its document."""
    return np.maximum(begin - BEFORE, offsets[doc]), np.minimum(begin + size + AFTER, offsets[doc + 1])


def _first_in_block(part: pa.RecordBatch, doc: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """For every chunk the place of its digest's first chunk in the block's earliest document that has it."""
    key = pa.table([part.column(0), part.column(1)], ["id", "t"])
    order = pc.sort_indices(key, [("id", "ascending"), ("t", "ascending")], null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort((np.arange(len(doc)), rank[doc], digest))
    new = np.concatenate([[True], digest[by][1:] != digest[by][:-1]])
    first = np.empty(len(doc), np.int64)
    first[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first


def _chunk_rows(batches):
    """key, of_block, doc_id, tn, words, ref_id, ref_tn: the digest where the chunk is in its block's earliest document, else what it repeats there."""

    def settle(part: pa.RecordBatch):
        doc, number, digest, words = [], [], [], []
        at = 0
        for piece in grams.slices(part, 2):
            d, n, h, _, _, size, begin = shared_chunks(piece.column(2))
            data, offsets = grams.flat(piece.column(2))
            starts = word_starts(data, offsets)
            lo, hi = _around(begin, size, d, offsets)
            base = starts[offsets[d]]
            words.append(((starts[lo] - base) << 32) | (starts[hi] - base))
            doc.append(d + at)
            number.append(n)
            digest.append(h)
            at += piece.num_rows
        doc, number, digest, words = (np.concatenate(x) for x in (doc, number, digest, words))
        if not len(doc):
            return
        first = _first_in_block(part, doc, digest)
        t = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        same_id = part.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        own = (doc == doc[first]) | ((t[doc] == t[doc[first]]) & (same_id[doc] == same_id[doc[first]]))
        tn = (t[doc] << 32) | number
        key = np.where(own, digest, grams.mix(digest + grams.mix(tn.astype(np.uint64)))).view(np.int64)
        ids, gone = part.column(0), pa.array(own)
        ref = pc.if_else(gone, pa.scalar(None, ids.type), ids.take(pa.array(doc[first])))
        columns = [pa.array(key), gone, ids.take(pa.array(doc)), pa.array(tn), pa.array(words), ref, pa.array(np.where(own, 0, tn[first]))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "of_block", "doc_id", "tn", "words", "ref_id", "ref_tn"])

    for batch in batches:
        for part in grams.slices(batch, 2, BLOCK * 25):
            yield from settle(part)


def _context_rows(batches):
    """What stands before ("L") or after ("R") the wanted chunks, with the edge in code points and the word beginnings before it."""
    for batch in batches:
        out: list[tuple] = []
        whose: list[int] = []
        for i in range(batch.num_rows):
            text = batch.column(2).slice(i, 1)
            data, offsets = grams.flat(text)
            doc, _, _, start, end, size, begin = shared_chunks(text)
            starts = word_starts(data, offsets)
            lo, hi = _around(begin, size, doc, offsets)
            for want in batch.column(3)[i].as_py():
                k = want["number"]
                if want["left"]:
                    a, b, point = int(lo[k]), int(begin[k]), int(start[k])
                    edge = b
                else:  # with the last byte of the chunk
                    edge, b, point = int(begin[k] + size[k]), int(hi[k]), int(end[k])
                    a = edge - 1
                out.append((k, want["left"], data[a:b].tobytes(), point, int(starts[edge]), a == 0 if want["left"] else b == len(data)))
                whose.append(i)
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        rows = pa.array(whose, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "t", *CONTEXT])


CONTEXT = ["number", "left", "bytes", "point", "starts", "edge"]


def _points(b: bytes) -> int:
    return len(b) - sum(0x80 <= x < 0xC0 for x in b)


def _begins(b: bytes, blank_before: bool) -> int:
    """Words that begin in b."""
    return len(b.split()) - (b[:1].strip() != b"" and not blank_before)


def extension(left: bytes, left_ref: bytes, at_start: bool, right: bytes, right_ref: bytes, at_end: bool) -> tuple[int, int, int]:
    """(code points to the left, to the right, whole words gained) by which a run grows; right begins with the run's last byte."""
    n = len(os.path.commonprefix([left[::-1], left_ref[::-1]]))
    while n and 0x80 <= left[len(left) - n] < 0xC0:
        n -= 1
    m = len(os.path.commonprefix([right, right_ref]))
    while 1 < m < len(right) and 0x80 <= right[m] < 0xC0:
        m -= 1
    split = len(left) - n
    before, after = left[split:], right[1:m]
    gained = _begins(before, left[split - 1 : split].strip() == b"" if split else at_start) + _begins(after, right[:1].strip() == b"")
    cut = right[m - 1 : m].strip() != b"" and (right[m : m + 1].strip() != b"" if m < len(right) else not at_end)
    return _points(before), _points(after), gained - cut


def _grown_rows(most: int):
    def run(batches):
        for batch in batches:
            found = []
            for i, (a, b, starts, *around) in enumerate(zip(*[c.to_pylist() for c in batch.columns[3:]], strict=True)):
                x, y, gained = extension(*around)
                if starts + gained > most:
                    found.append((i, a - x, b + y, starts + gained))
            rows, *numbers = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[:3]], *numbers], ["doc_id", "t", "first_doc_id", "start", "end", "n_words"])

    return run


def _repeated_chunks(texts: DataFrame, kind: str) -> DataFrame:
    """(doc_id, t, number, words, ref_id, ref_t, ref_number): each chunk that an earlier document has, with such a document's first one."""
    schema = f"key bigint, of_block boolean, doc_id {kind}, tn bigint, words bigint, ref_id {kind}, ref_tn bigint"
    rows = texts.mapInArrow(_chunk_rows, schema).repartition("key")
    first = F.first(F.struct("doc_id", "tn")).over(Window.partitionBy("key", "of_block").orderBy("doc_id", "tn"))
    known = rows.withColumn("f", first).withColumn("ref_id", F.when(F.col("of_block"), F.col("f.doc_id")).otherwise(F.col("ref_id")))
    known = known.withColumn("ref_tn", F.when(F.col("of_block"), F.col("f.tn")).otherwise(F.col("ref_tn")))
    later = known.where(~F.col("of_block") | ~(F.col("doc_id").eqNullSafe(F.col("ref_id")) & (F.shiftright("tn", 32) == F.shiftright("ref_tn", 32))))
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    high = lambda c: F.shiftright(c, 32).cast("int")
    return later.select("doc_id", high("tn").alias("t"), low("tn").alias("number"), "words", "ref_id", high("ref_tn").alias("ref_t"), low("ref_tn").alias("ref_number"))


def _runs(later: DataFrame, most: int) -> DataFrame:
    """Neighbouring repeated chunks that may have over `most` words: doc_id, t, first, last and what these two repeat."""
    once = later.repartition("doc_id", "t").groupBy("doc_id", "t", "number").agg(F.min(F.struct("ref_id", "ref_t", "ref_number", "words")).alias("c"))
    by_doc = Window.partitionBy("doc_id", "t").orderBy("number")
    runs = once.withColumn("run", F.col("number") - F.row_number().over(by_doc)).groupBy("doc_id", "t", "run")
    ends = runs.agg(F.min_by("c", "number").alias("a"), F.max_by("c", "number").alias("b"), F.min("number").alias("first"), F.max("number").alias("last"))
    room = F.col("b.words").bitwiseAND(F.lit(0xFFFFFFFF)) - F.shiftright("a.words", 32)
    return ends.where(room > most).drop("run")


def repeated_runs(docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, n_chunks, first_doc_id, t): passages of over `most_words` words that an earlier document has.

    first_doc_id is an earlier document with the passage's first chunk; t tells texts under one id apart.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.hash("text").alias("t"), "text").where("text != ''")
    runs = written(_runs(_repeated_chunks(texts, kind), most_words), "runs", release=True)
    ends = [("doc_id", "t", "first", True), ("doc_id", "t", "last", False), ("a.ref_id", "a.ref_t", "a.ref_number", True), ("b.ref_id", "b.ref_t", "b.ref_number", False)]
    ends = [[F.col(i).alias("doc_id"), F.col(t).alias("t"), F.col(n).alias("number"), F.lit(side).alias("left")] for i, t, n, side in ends]
    wanted = runs.select(F.explode(F.array(*[F.struct(*e) for e in ends])).alias("e")).select("e.*").distinct()
    wanted = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("number", "left")).alias("wanted")).withColumnsRenamed({"doc_id": "_id", "t": "_t"})
    laid = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("doc_id", "t", "text", "wanted")
    schema = f"doc_id {kind}, t int, number int, left boolean, bytes binary, point bigint, starts bigint, edge boolean"
    around = written(laid.dropDuplicates(["doc_id", "t"]).mapInArrow(_context_rows, schema), "around", release=True)

    def with_end(df: DataFrame, name: str, doc: str, t: str, number: str, left: bool) -> DataFrame:
        end = around.where(F.col("left") == left).select(F.struct("doc_id", "t", "number").alias("_k"), F.struct("bytes", "point", "starts", "edge").alias(name))
        key = F.struct(F.col(doc).alias("doc_id"), F.col(t).alias("t"), F.col(number).alias("number"))
        return df.withColumn("_w", key).join(end.hint("merge"), F.col("_w").eqNullSafe(F.col("_k"))).drop("_w", "_k")

    full = with_end(with_end(runs, "l", "doc_id", "t", "first", True), "r", "doc_id", "t", "last", False)
    full = with_end(with_end(full, "lr", "a.ref_id", "a.ref_t", "a.ref_number", True), "rr", "b.ref_id", "b.ref_t", "b.ref_number", False)
    full = full.withColumn("place", F.struct("t", (F.col("last") - F.col("first") + 1).alias("n")))
    columns = ["l.point", "r.point", "l.bytes", "lr.bytes", "l.edge", "r.bytes", "rr.bytes", "r.edge"]
    rows = full.select("doc_id", "place", F.col("a.ref_id").alias("first_doc_id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns[:2])], (F.col("r.starts") - F.col("l.starts")).alias("s"), *[F.col(c).alias(f"d{k}") for k, c in enumerate(columns[2:])])
    grown = rows.mapInArrow(_grown_rows(most_words), f"doc_id {kind}, t struct<t:int,n:int>, first_doc_id {kind}, start bigint, end bigint, n_words bigint")
    return grown.select("doc_id", "start", "end", "n_words", F.col("t.n").cast("bigint").alias("n_chunks"), "first_doc_id", F.col("t.t").alias("t"))


def without_repeats(docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The documents with every reported passage cut out."""
    spans = repeated_runs(docs, most_words).groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")).withColumnsRenamed({"doc_id": "_id", "t": "_t"})
    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.hash("text") == F.col("_t")), "left")
    piece = lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], s["start"])).alias("out"))
    cut = F.aggregate("_spans", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length("text"))))
    return rows.withColumn("text", F.when(F.col("_spans").isNotNull(), cut).otherwise(F.col("text"))).select(*docs.columns)
