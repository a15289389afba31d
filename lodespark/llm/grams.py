"""Words and word windows of Arrow text columns as arrays: no Python object for each word.

A word's hash is a polynomial over its bytes modulo 2**64, taken as a difference
of running sums, then mixed. Memory is a constant times the bytes of one slice;
`slices` cuts a batch so that only a single longer text exceeds its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers = {BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}
SLICE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; changes x."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        size = max(n, SLICE + 1)
        out = np.empty(size, np.uint64)
        out[0], done, step = 1, 1, base
        while done < size:  # doubles what is there
            more = min(done, size - done)
            out[done : done + more] = out[:more] * np.uint64(step)
            done += more
            step = step * step & _MASK
        _powers[base] = have = out
    return have[:n]


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to `limit` bytes of text each, or one longer text."""
    lengths = np.diff(_flat(batch.column(text))[1])
    at, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if column.null_count:
        column = column.fill_null("")
    kind = "<i8" if pa.types.is_large_string(column.type) else "<i4"
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null is empty."""
    return _flat(column)


def separators(more: bytes = b"") -> np.ndarray:
    """True for bytes that belong to words: all but the six ASCII blanks and `more`."""
    table = np.ones(256, bool)
    table[list(b" \t\n\x0b\x0c\r" + more)] = False
    return table


BLANKS = separators()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PUNCTUATION = separators(bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; a word never spans two documents."""
    w = inside[data]
    begin, final = w.copy(), w.copy()
    begin[1:] &= ~w[:-1]
    final[:-1] &= ~w[1:]
    full = np.flatnonzero(np.diff(offsets))
    first, last = offsets[full], offsets[full + 1] - 1
    begin[first], final[last] = w[first], w[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(final) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * powers(BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * powers(_INVERSE, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64))


def word_hashes(column: pa.Array, inside: np.ndarray = BLANKS, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document) of every word of a text column, and for each document where its words begin."""
    data, offsets = flat(column)
    if lower:
        data = LOWER[data]
    start, end, doc = words(data, offsets, inside)
    return hashes(data, start, end), doc, np.searchsorted(doc, np.arange(len(offsets)))


def _odd(j: int) -> np.uint64:
    return np.uint64(((j + 1) * 0xC2B2AE3D27D4EB4F) & _MASK | 1)


def windows(h: np.ndarray, doc: np.ndarray, first: np.ndarray, positions: list[int], whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of word windows that take these positions after their first word.

    whole: a document with fewer words than the window has one window of all its words.
    """
    span, n = positions[-1] + 1, len(h)
    counts = np.diff(first)
    left = first[doc + 1] - np.arange(n)  # words from here to the end of the document
    ok = left >= span
    if whole:
        short = np.flatnonzero((counts > 0) & (counts < span))
        ok[first[short]] = True
    at = np.flatnonzero(ok)
    padded = np.concatenate([h, np.zeros(span, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for j, p in enumerate(positions):
        x = padded[at + p]
        if whole:
            x = np.where(left[at] > p, x, np.uint64(0))
        out += x * _odd(j)
    return mix(out), at
