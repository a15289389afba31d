"""LM scoring by context-tree weighting over bytes.

Texts are read as bytes, A-Z in lower case. Each byte, and the end of the text, is
coded by eight binary decisions; the contexts of a decision are the last 0 to DEPTH
bytes (EDGE before the start), so every decision has a context tree of its own. At
each node a Krichevsky-Trofimov estimate stands for all contexts below it, and
weighting mixes the estimates of all depths along a path by the probability that
each gave to the training data: Pw = 1/2 Pkt + 1/2 product of the children's Pw. A
context or a decision that training never met leaves the word to the longest one
it did meet.

The tree is weighted in two parts. The outer one has the depths 0 to 3; below each
context of three bytes hangs an inner one of the depths 3 to DEPTH. What the outer
tree gives its leaf is handed on to the leaf's inner tree.

All that training gathers grows with the corpus and stays distributed. Texts are
dealt into blocks. A block is known by its distinct (context, byte) pairs, sorted
and coded by differences, with their counts in training texts; each goes to the
bucket of its three-byte context. A bucket adds up its blocks' counts, builds its
trees and answers every block with one number a pair, in the same order. The block
then reads its texts again and adds the numbers up. Only the outer tree's rows, 4 KB
for each of at most 2**16 contexts of two bytes, reach the driver and the tasks.
Words take the same way for the base score: a bucket answers with their counts.

A context of three bytes is one bucket's; what it costs there is its distinct
longer contexts in each block, coded in about a byte and a half each.

Cases: a null or empty text is the end symbol alone; a null id counts as training
with remainder 0; repeated rows are each scored and each trained on; without
training documents all words are unknown and every decision has probability 1/2;
an empty table gives an empty result; extra columns are left out. Texts longer than
a block are a block of their own and are worked on in windows of WINDOW bytes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm import grams
from lodespark.session import scratch_path, written

DEPTH, OUTER = 7, 3
EDGE = 0xFF  # stands in no UTF-8 text: before the start and at the end
END_WORD = 0x656E64
BLOCK, WINDOW = 10 << 20, 512 << 10
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 8192
#: Steps of an answer: 1/1024 in log10.
SCALE = 1024
PAIRS, WORDS = 0, 1
_SYM = np.uint64(0xFF)


# --- coding ----------------------------------------------------------------------


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return _pack(np.diff(keys, prepend=np.uint64(0))), _pack(counts.astype(np.uint32))


def unpack_keys(keys: bytes) -> np.ndarray:
    return np.cumsum(_unpack(keys, np.uint64), dtype=np.uint64)


# --- reading ---------------------------------------------------------------------


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with DEPTH edges before and one after each text, where a symbol stands, where each text's symbols begin)."""
    n, extra = len(offsets) - 1, DEPTH + 1
    out = np.full(len(data) + n * extra, EDGE, np.uint8)
    starts = offsets[:-1] + extra * np.arange(n) + DEPTH
    symbol = np.ones(len(out), bool)
    for j in range(1, DEPTH + 1):
        symbol[starts - j] = False
    text = symbol.copy()
    text[offsets[1:] + extra * np.arange(1, n + 1) - 1] = False
    out[text] = grams.LOWER[data]
    return out, symbol, starts


def windows_of_keys(data: np.ndarray, symbol: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of symbols, their keys): the last byte on top, then the one before it, at the bottom the symbol."""
    for lo in range(0, len(data), WINDOW):
        at = lo + np.flatnonzero(symbol[lo : lo + WINDOW])
        a = max(0, lo - DEPTH)
        piece = data[a : lo + WINDOW].astype(np.uint64)
        key = piece.copy()
        for j in range(1, DEPTH + 1):
            key[j:] |= piece[:-j] << np.uint64(64 - 8 * j)
        yield at, key[at - a]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their counts."""
    k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[begin], (np.add.reduceat(n, begin) if len(k) else n)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _counted(k: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often they are there, or 0; sorts k in its place."""
    k.sort()
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if not counted:
        k = k[new]
        return k, np.zeros(len(k), np.uint32)
    begin = np.flatnonzero(new)
    return k[begin], np.diff(begin, append=len(k)).astype(np.uint32)


def _by_last_byte(data: np.ndarray, symbol: np.ndarray) -> Iterator[Iterator[np.ndarray]]:
    """Places of symbols, two WINDOWs or a few more at a time, by ranges of the byte before them, which is on top of their keys.

    A range has two WINDOWs of places if no byte has more by itself.
    """
    before = data[:-1][symbol[1:]] if len(data) else data  # the first byte is an edge, never a symbol
    group = (np.cumsum(np.bincount(before, minlength=256)) - 1) // (2 * WINDOW)
    del before
    byte = 0
    while byte < 256:
        after = int(np.searchsorted(group, group[byte], "right")) if group[byte] >= 0 else byte + 1
        inside = np.zeros(256, bool)
        inside[byte:after] = True

        def places(inside=inside):
            held, size = [], 0
            for lo in range(1, len(data), WINDOW):
                hi = min(lo + WINDOW, len(data))
                at = lo + np.flatnonzero(symbol[lo:hi] & inside[data[lo - 1 : hi - 1]])
                held.append(at)
                size += len(at)
                if size >= 2 * WINDOW or hi == len(data):
                    yield np.concatenate(held)
                    held, size = [], 0

        yield places()
        byte = after


def keys_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys of symbols at these places."""
    key = data[at].astype(np.uint64)
    for j in range(1, DEPTH + 1):
        more = data[at - j].astype(np.uint64)
        more <<= np.uint64(64 - 8 * j)
        key |= more
    return key


def block_pairs(data: np.ndarray, offsets: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct keys and how often training texts have them, worked out for a range of last bytes at a time."""
    flat, symbol, _ = padded(data, offsets)
    learned = np.repeat(trained, np.diff(offsets) + DEPTH + 1)
    found: list = []
    for places in _by_last_byte(flat, symbol):
        parts: list = []
        for at in places:
            learn = learned[at]
            for some, counted in ((at[learn], True), (at[~learn], False)):
                if len(some):
                    parts.append(_counted(keys_at(flat, some), counted))
            if len(parts) >= 4:
                parts = [_merged(parts)]
        if parts:
            found.append(_merged(parts))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([k for k, _ in found]), np.concatenate([n.astype(np.int64) for _, n in found])


def block_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The block's distinct keys alone."""
    flat, symbol, _ = padded(data, offsets)
    parts: list = []
    for _, key in windows_of_keys(flat, symbol):
        parts.append(_distinct(key))
        if len(parts) >= 6:
            parts = [_distinct(np.concatenate(parts))]
    return _distinct(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def word_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word and of every document's end."""
    h, doc, _ = grams.word_hashes(column, lower=True)
    n = len(column)
    return np.append(h, np.full(n, END_WORD, np.uint64)), np.append(doc, np.arange(n))


def block_words(column: pa.Array, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts: list = []
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    at = 0
    for part in grams.slices(batch, 0, WINDOW):
        h, doc = word_keys(part.column(0))
        learn = trained[at + doc]
        parts.append(np.unique(h[learn], return_counts=True))
        other = _distinct(h[~learn])
        parts.append((other, np.zeros(len(other), np.int64)))
        at += part.num_rows
        if len(parts) >= 8:
            parts = [_merged(parts)]
    return _merged(parts) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of keys in order; those of pairs are worked out once for each context of three bytes."""
    if kind == WORDS:
        return (grams.mix(keys + np.uint64(1)) % np.uint64(buckets)).astype(np.uint16)
    whole = keys >> np.uint64(64 - 8 * OUTER)
    new = np.ones(len(keys), bool)
    new[1:] = whole[1:] != whole[:-1]
    begin = np.flatnonzero(new)
    return np.repeat((grams.mix(whole[begin] + np.uint64(1)) % np.uint64(buckets)).astype(np.uint16), np.diff(begin, append=len(keys)))


# --- trees -----------------------------------------------------------------------

_SMALL = 1 << 14


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for positive x: Stirling's series after a shift by eight."""
    x = np.asarray(x, float)
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_HALVES, _WHOLES = log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)


def _lookup(table: np.ndarray, n: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1)]
    large = n >= _SMALL
    if large.any():
        out[large] = log_gamma(n[large] + add)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones; 0 for none."""
    return _lookup(_HALVES, zeros, 0.5) + _lookup(_HALVES, ones, 0.5) - _lookup(_WHOLES, zeros + ones, 1.0) - math.log(math.pi)


class Level:
    """The (context of d bytes, symbol) pairs of one depth, and for a number of decided bits the nodes of that decision."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def above(self, depth: int) -> Level:
        """The level of `depth` bytes; self.up says where each pair went."""
        mask = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * depth)) - 1)) if depth else np.uint64(0)
        keys, self.up = np.unique((self.keys & mask) | (self.keys & _SYM), return_inverse=True)
        return Level(keys, np.bincount(self.up, self.counts, len(keys)).astype(np.int64))

    def decide(self, j: int) -> None:
        """Groups by context and the first j bits: first pair, node of each pair, zeros and ones."""
        prefix = self.keys >> np.uint64(8 - j)
        new = np.ones(len(prefix), bool)
        new[1:] = prefix[1:] != prefix[:-1]
        self.begin = np.flatnonzero(new)
        self.node = np.cumsum(new) - 1
        bit = ((self.keys >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
        self.ones = np.add.reduceat(self.counts * bit, self.begin)
        self.all = np.add.reduceat(self.counts, self.begin)
        self.kt = (self.ones + 0.5) / (self.all + 1.0)
        self.log = log_kt(self.all - self.ones, self.ones)

    def parents(self, above: Level) -> np.ndarray:
        return above.node[self.up[self.begin]]


def _share(level: Level, below: np.ndarray) -> np.ndarray:
    """The weight of a node's own estimate against its children's, whose logs add up to `below`; level.log becomes the mixture's."""
    mixed = np.logaddexp(level.log, below) - math.log(2)
    share = np.exp(np.minimum(level.log - math.log(2) - mixed, 0))
    level.log = mixed
    return share


class Outer:
    """The outer tree, laid out by contexts of two bytes: p = part + rest * (what the inner tree says), or `own` where that knows nothing."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, below: np.ndarray):
        """contexts: of two bytes, in order; counts: a row of symbol counts for each; below: for each decision the children's logs added up."""
        rows = {2: (contexts, counts, below)}
        for d in (1, 0):
            c, n, _ = rows[d + 1]
            up = c >> 8
            there, inverse = np.unique(up, return_inverse=True)
            total = np.zeros((len(there), 256), np.int64)
            np.add.at(total, inverse, n)
            rows[d] = (there, total, None)
        if not len(contexts):
            rows[0] = (np.zeros(1, np.int64), np.zeros((1, 256), np.int64), None)
        kt, share, seen, log = {}, {}, {}, None
        for d in (2, 1, 0):
            c, n, s = rows[d]
            zeros, ones = decisions(n)
            if d < 2:
                s = np.zeros(zeros.shape)
                if len(rows[d + 1][0]):
                    np.add.at(s, np.searchsorted(c, rows[d + 1][0] >> 8), log)
            own = log_kt(zeros, ones)
            log = np.logaddexp(own, s) - math.log(2)
            share[d] = np.exp(np.minimum(own - math.log(2) - log, 0))
            kt[d], seen[d] = (ones + 0.5) / (zeros + ones + 1.0), zeros + ones > 0
        part, rest, own = np.zeros((1, 255)), np.ones((1, 255)), kt[0]
        parts, rests, owns = [part + share[0] * kt[0]], [rest * (1 - share[0])], [own]
        self.row_of = np.zeros(1 << 16, np.int32)
        first = 1
        for d in (1, 2):
            c = rows[d][0]
            up = np.searchsorted(rows[d - 1][0], c >> 8)
            known = seen[d]
            part, rest, own = parts[-1][up], rests[-1][up], owns[-1][up]
            owns.append(np.where(known, part + rest * kt[d], own))
            parts.append(np.where(known, part + rest * share[d] * kt[d], own))
            rests.append(np.where(known, rest * (1 - share[d]), 0.0))
            at = (first + np.arange(len(c), dtype=np.int32))
            if d == 1:
                self.row_of.reshape(256, 256)[c] = at[:, None]
            else:
                self.row_of[c] = at
            first += len(c)
        # a row that ends above depth 2 has nothing below it
        for d in (0, 1):
            parts[d], rests[d] = owns[d], np.zeros_like(rests[d])
        self.part, self.rest, self.own = (np.concatenate(x).astype(np.float32) for x in (parts, rests, owns))


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) at the 255 decisions of rows of symbol counts: decision 2**j - 1 + (first j bits)."""
    zeros, ones = [], []
    for j in range(8):
        halves = counts.reshape(len(counts), 1 << j, 2, 128 >> j).sum(3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def pair_logs(keys: np.ndarray, counts: np.ndarray, outer: Outer) -> np.ndarray:
    """log10 probability of every pair; keys in order, whole contexts of three bytes."""
    levels = {DEPTH: Level(keys, counts)}
    for d in range(DEPTH - 1, OUTER - 1, -1):
        levels[d] = levels[d + 1].above(d)
    two = outer.row_of[(keys >> np.uint64(48)).astype(np.int64)]
    out = np.zeros(len(keys))
    for j in range(8):
        share = {}
        for d in range(DEPTH, OUTER - 1, -1):
            levels[d].decide(j)
        for d in range(DEPTH - 1, OUTER - 1, -1):
            levels[d + 1].parent = levels[d + 1].parents(levels[d])
            share[d] = _share(levels[d], np.bincount(levels[d + 1].parent, levels[d + 1].log, len(levels[d].log)))
        # from the deepest node up: a child that training never met leaves the word to its parent
        at = np.arange(len(levels[DEPTH].kt))
        q, met = levels[DEPTH].kt.copy(), levels[DEPTH].all > 0
        for d in range(DEPTH - 1, OUTER - 1, -1):
            at = levels[d + 1].parent[at]
            w, own = share[d][at], levels[d].kt[at]
            q = np.where(met, w * own + (1 - w) * q, own)
            met = levels[d].all[at] > 0
        node, deepest = (1 << j) - 1 + (keys & _SYM).astype(np.int64) // (1 << (8 - j)), levels[DEPTH].node
        q, met = q[deepest], met[deepest]
        p = np.where(met, outer.part[two, node] + outer.rest[two, node] * q, outer.own[two, node])
        bit = (keys >> np.uint64(7 - j)) & np.uint64(1)
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


# --- jobs ------------------------------------------------------------------------

BLOCKS = "kind int, bucket int, block string, keys binary, counts binary"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _save(folder: str, rows: pa.RecordBatch) -> str:
    """A block's texts as a file of the shared folder; a repeated task writes another that only its own rows name."""
    fs, root = _fs(folder)
    path = f"{root}/block-{uuid.uuid4().hex}.arrow"
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(path, compression=None) as sink, pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return path


def _load(folder: str, path: str) -> pa.RecordBatch:
    fs, _ = _fs(folder)
    with fs.open_input_stream(path, compression=None) as source, pa.ipc.open_stream(source) as reader:
        return reader.read_next_batch()


def _block_rows(folder: str, buckets: int):
    def settle(rows: pa.RecordBatch):
        path = _save(folder, rows)
        trained = ~rows.column(1).to_numpy(zero_copy_only=False)
        text = rows.column(2)
        for kind, (keys, counts) in ((PAIRS, block_pairs(*grams.flat(text), trained)), (WORDS, block_words(text, trained))):
            bucket = bucket_of(kind, keys, buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
            there = np.flatnonzero(np.diff(cut))
            for lo in range(0, len(there), 256):
                some = there[lo : lo + 256].tolist()
                coded = [pack_keys(keys[i], counts[i]) for i in (order[cut[b] : cut[b + 1]] for b in some)]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([path] * len(some)), pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.binary())], ["kind", "bucket", "block", "keys", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in grams.slices(batch, 2, BLOCK):
                n = len(grams.flat(part.column(2))[0])
                if held and size + n > BLOCK:
                    yield from settle(_joined(held))
                    held, size = [], 0
                held.append(part)
                size += n
        if held:
            yield from settle(_joined(held))

    return run


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _three_rows(batches):
    """(two, key, n): counts of contexts of three bytes and symbols, key without the two bytes on top."""
    parts: list = []

    def rows():
        k, n = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(16)).astype(np.int32)), pa.array((k & np.uint64(0xFFFF)).astype(np.int32)), pa.array(n)], ["two", "key", "n"])

    for batch in batches:
        for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k, n = unpack_keys(keys), _unpack(counts, np.uint32).astype(np.int64)
            short = ((k >> np.uint64(40)) << np.uint64(8)) | (k & _SYM)
            parts.append(_merged([(short[n > 0], n[n > 0])]))
            if sum(len(p[0]) for p in parts) > 1 << 20:
                parts[:] = [_merged(parts)]
                if len(parts[0][0]) > 1 << 20:
                    yield rows()
                    parts.clear()
    if parts:
        yield rows()


def _outer_rows(batches):
    """(two, counts, below) for each context of two bytes; rows come in its order."""

    def one(two: int, key: np.ndarray, n: np.ndarray):
        there, inverse = np.unique(key >> 8, return_inverse=True)
        counts = np.zeros((len(there), 256), np.int64)
        np.add.at(counts, (inverse, key & 255), n)
        return two, counts.sum(0).tobytes(), log_kt(*decisions(counts)).sum(0).tobytes()

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["two", "counts", "below"])

    rest = None
    for batch in batches:
        two, key, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        if rest is not None:
            two, key, n = (np.concatenate(x) for x in zip(rest, (two, key, n), strict=True))
        if not len(two):
            continue
        begin = np.flatnonzero(np.concatenate([[True], two[1:] != two[:-1]]))
        cut = begin[-1]
        found = [one(int(two[a]), key[a:b], n[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        rest = (two[cut:], key[cut:], n[cut:])
        if found:
            yield out(found)
    if rest is not None and len(rest[0]):
        yield out([one(int(rest[0][0]), rest[1], rest[2])])


def outer_tree(blocks: DataFrame) -> Outer:
    counted = blocks.where(F.col("kind") == PAIRS).select("keys", "counts").mapInArrow(_three_rows, "two int, key int, n bigint")
    summed = counted.repartition("two").groupBy("two", "key").agg(F.sum("n").alias("n")).sortWithinPartitions("two")
    rows = sorted(summed.mapInArrow(_outer_rows, "two int, counts binary, below binary").collect())
    two = np.array([r.two & 0xFFFF for r in rows], np.int64)
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in rows], np.int64).reshape(-1, 256)
    below = np.array([np.frombuffer(r.below) for r in rows], float).reshape(-1, 255)
    return Outer(two, counts, below)


def _in_buckets(answer):
    """Runs over blocks' rows in the order of (kind, bucket): adds each bucket up and answers its blocks."""

    def close(kind, held):
        parts: list = []
        size = base = 0
        for _, keys, counts in held:
            k = unpack_keys(keys)
            parts.append((k, _unpack(counts, np.uint32).astype(np.int64)))
            size += len(k)
            if size > max(1 << 20, 2 * base):  # merging costs no more than what came in
                parts = [_merged(parts)]
                size = base = len(parts[0][0])
        keys, counts = _merged(parts)
        values = answer(kind, keys, counts)
        for lo in range(0, len(held), 64):
            yield [(block, _pack(values[np.searchsorted(keys, unpack_keys(own))])) for block, own, _ in held[lo : lo + 64]]

    def run(batches):
        now, held = None, []
        for batch in batches:
            for kind, bucket, block, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (kind, bucket) != now:
                    if held:
                        for rows in close(now[0], held):
                            yield _answers(now, rows)
                    now, held = (kind, bucket), []
                held.append((block, keys, counts))
        if held:
            for rows in close(now[0], held):
                yield _answers(now, rows)

    return run


def _answers(of, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([of[0]] * len(rows), pa.int32()), pa.array([of[1]] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["kind", "bucket", "block", "answer"])


def _pair_answers(shared):
    def values(kind: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.minimum(np.rint(-SCALE * pair_logs(keys, counts, shared.value)), 65535).astype(np.uint16)

    return lambda batches: _in_buckets(values)(batches)


def _word_answers(batches):
    """Every word's count in training; and, in a row without a block, a task's tokens and distinct words."""
    tokens = distinct = 0

    def count(kind, keys, counts):
        nonlocal tokens, distinct
        tokens, distinct = tokens + int(counts.sum()), distinct + int((counts > 0).sum())
        return counts.astype(np.uint32)

    yield from _in_buckets(count)(batches)
    yield _answers((WORDS, -1), [(None, np.array([tokens, distinct], np.int64).tobytes())])


def _score_rows(folder: str, buckets: int):
    def close(block, answers):
        rows = _load(folder, block)
        text, n = rows.column(2), rows.num_rows
        data, offsets = grams.flat(text)
        flat, symbol, starts = padded(data, offsets)

        def answered(kind: int, keys: np.ndarray) -> np.ndarray:
            whole = np.uint16 if kind == PAIRS else np.uint32
            bucket = bucket_of(kind, keys, buckets)
            values = np.empty(len(keys), whole)
            values[np.argsort(bucket, kind="stable")] = np.concatenate([_unpack(answers[kind, b], whole) for b in np.flatnonzero(np.bincount(bucket)).tolist()])
            return values

        keys = block_keys(data, offsets)
        values = answered(PAIRS, keys)
        edges, total = np.append(starts, len(flat) + 1), np.zeros(n)
        for at, key in windows_of_keys(flat, symbol):
            order = np.argsort(key)
            place = np.searchsorted(keys, key[order])
            total += np.bincount(np.searchsorted(edges, at[order], "right") - 1, values[place], n)
        keys = block_words(text, np.zeros(n, bool))[0]
        values = answered(WORDS, keys)
        tokens, known, logs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        first = 0
        for part in grams.slices(pa.RecordBatch.from_arrays([text], ["text"]), 0, WINDOW):
            h, doc = word_keys(part.column(0))
            c, doc = values[np.searchsorted(keys, h)], doc + first
            tokens += np.bincount(doc, minlength=n)
            known += np.bincount(doc[c > 0], minlength=n)
            logs += np.bincount(doc, np.log10(c + 0.5), n)
            first += part.num_rows
        score = total / -SCALE
        bits = -score * math.log2(10) / np.maximum(np.diff(offsets), 1)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(tokens), pa.array(known), pa.array(logs), pa.array(score), pa.array(bits)], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "bits_per_byte"])

    def run(batches):
        now, answers = None, {}
        for batch in batches:
            for kind, bucket, block, answer in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block != now:
                    if answers:
                        yield close(now, answers)
                    now, answers = block, {}
                answers[kind, bucket] = answer
        if answers:
            yield close(now, answers)

    return run


def score(docs: DataFrame, fold: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (the code length) for every document.

    Learns from the documents whose crc32(id as text) modulo `fold` isn't `held`.
    """
    spark = docs.sparkSession
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold, F.lit(0))
    texts = docs.select("doc_id", (rest == held).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(16, size // BUCKET_BYTES))
    folder = scratch_path(spark, "texts")
    blocks = written(texts.mapInArrow(_block_rows(folder, buckets), BLOCKS), "blocks")
    outer = spark.sparkContext.broadcast(outer_tree(blocks))
    dealt = lambda kind: blocks.where(F.col("kind") == kind).repartition("bucket").sortWithinPartitions("bucket")
    columns = "kind int, bucket int, block string, answer binary"
    words = written(dealt(WORDS).mapInArrow(_word_answers, columns), "words", release=True)
    sums = [np.frombuffer(r.answer, np.int64) for r in words.where("block IS NULL").select("answer").collect()]  # a row a task
    tokens, distinct = (int(x) for x in np.sum(sums, 0)) if sums else (0, 0)
    answers = dealt(PAIRS).mapInArrow(_pair_answers(outer), columns).unionByName(words.where("block IS NOT NULL"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, bits_per_byte double"
    scored = answers.repartition("block").sortWithinPartitions("block").mapInArrow(_score_rows(folder, buckets), schema)
    base = F.col("logs") - F.col("n_tokens") * math.log10(tokens + 0.5 * (distinct + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", "bits_per_byte")
