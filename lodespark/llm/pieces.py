"""SentencePiece merges: a score-ordered agenda of adjacent symbol pairs.

The model file is read directly (its wire format is public); the library is
only the judge: every unit that this module segments is also encoded by it, in
batches, and the two are compared.

Merges never cross from a visible character into a following space mark when
no piece of the vocabulary does, so a text falls into units (a run of space
marks and the visible characters after it) that can be segmented apart and
remembered. A vocabulary without that property is segmented whole.

Cases: a null or empty text has no ids and decodes to the empty text; texts of
any length are segmented whole; repeated rows and ids give one row each; extra
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.memory import Generations

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Units up to this many symbols are merged side by side in arrays; longer ones use the heap.
WIDE = 40


def _fields(data: bytes):
    """(field number, value) pairs of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            at += 8
            yield key >> 3, data[at - 8 : at]
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        elif kind == 5:
            at += 4
            yield key >> 3, data[at - 4 : at]
        else:
            raise ValueError("not a SentencePiece model")


class MergeModel:
    """Vocabulary, scores and merge table of a merge-type SentencePiece model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.path, self.text, self.score, self.kind = path, [], [], []
        trainer, normalizer = {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.text.append(piece[1].decode())
                self.score.append(struct.unpack("<f", piece[2])[0])
                self.kind.append(piece[3])
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("the model isn't of the merge type")
        if normalizer.get(1) != b"identity" or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that keep the text as it is are read here")
        if any(k in (USER, UNUSED) for k in self.kind):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.unknown = self.kind.index(UNKNOWN)
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.splits = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        self.scores = np.array(self.score, np.float32)
        self.shown = [t.replace(SPACE, " ") if k == NORMAL else None for t, k in zip(self.text, self.kind, strict=True)]
        self.decimal = [str(i) for i in range(len(self.text))]
        self._table()

    def _table(self) -> None:
        """Open addressing from (left id, right id) to the merged id."""
        n = len(self.text)
        pairs = {}
        for t, i in self.ids.items():
            for cut in range(1, len(t)):
                left, right = self.ids.get(t[:cut]), self.ids.get(t[cut:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
        self.size = 1 << max(4, (len(pairs) * 6).bit_length())
        self.keys, self.merged = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int32)
        for key, i in pairs.items():
            at = self._slot(key)
            while self.keys[at] >= 0:
                at = (at + 1) & (self.size - 1)
            self.keys[at], self.merged[at] = key, i

    def _slot(self, key):
        return ((key * 0x9E3779B1) >> 7) & (self.size - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs of symbols, -1 where they don't merge or one is missing."""
        key = left.astype(np.int64) * len(self.text) + right
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.merged[at], -1).astype(np.int32)
        far = np.flatnonzero((there != key) & (there >= 0))
        while len(far):
            at_far = (at[far] + 1) & (self.size - 1)
            at[far] = at_far
            there = self.keys[at_far]
            hit = there == key[far]
            out[far[hit]] = self.merged[at_far[hit]]
            far = far[~hit & (there >= 0)]
        out[(left < 0) | (right < 0)] = -1
        return out

    def agenda(self, unit: str) -> list[int]:
        """One unit by a heap: the best score first, the leftmost of equals; any vocabulary, any length."""
        sym: list[str | None] = list(unit)
        before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(both := sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, both))

        for i in range(1, len(sym)):
            offer(i - 1, i)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or sym[a] + sym[b] != both or after[a] != b:
                continue
            sym[a], sym[b] = both, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        for s in sym:
            if s is not None:
                out.extend(self._emit(s))
        return out

    def _emit(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def side_by_side(self, units: list[str]) -> list[list[int]]:
        """The same agenda for many short units at once, one merge in each of them a round.

        In every round each unit makes its best-scored merge, the leftmost of
        equals, which is what its own agenda would pop next.
        """
        out: list = [None] * len(units)
        order = sorted((i for i in range(len(units)) if len(units[i]) <= WIDE), key=lambda i: len(units[i]))
        for i, u in enumerate(units):
            if len(u) > WIDE:
                out[i] = self.agenda(u)
        for lo in range(0, len(order), 4096):
            some = order[lo : lo + 4096]
            self._rounds(units, some, out)
        return out

    def _rounds(self, units: list[str], some: list[int], out: list) -> None:
        lengths = np.array([len(units[i]) for i in some])
        codes = np.frombuffer("".join([units[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen, back = np.unique(codes, return_inverse=True)
        # a character outside the vocabulary merges with nothing; it is kept below -1 for the bytes
        first = np.array([self.ids.get(chr(c), -2 - int(c)) for c in seen], np.int32)
        wide = int(lengths.max())
        sym = np.full((len(some), wide), -1, np.int32)
        sym[np.arange(wide) < lengths[:, None]] = first[back]
        merged = self.lookup(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(some), wide - 1)
        best = np.where(merged >= 0, self.scores[merged], -np.inf).astype(np.float32)
        who = np.array(some)
        while wide > 1:
            at, here = best.argmax(1), np.arange(len(who))
            on = best[here, at] > -np.inf
            if not on.all():
                self._retire(who[~on], sym[~on], lengths[~on], out)
                who, sym, merged, best, lengths, at = who[on], sym[on], merged[on], best[on], lengths[on], at[on]
                here = here[: len(who)]
            if not len(who):
                return
            sym[here, at] = merged[here, at]
            left_out, n = np.arange(wide) != (at + 1)[:, None], len(who)
            pairs_left = left_out[:, 1:]  # the pair at `at` goes, the one after it takes its place
            sym, merged, best = sym[left_out].reshape(n, wide - 1), merged[pairs_left].reshape(n, wide - 2), best[pairs_left].reshape(n, wide - 2)
            wide, lengths = wide - 1, lengths - 1
            for c in (at - 1, at):
                ok = (c >= 0) & (c < wide - 1)
                r, c = here[ok], c[ok]
                got = self.lookup(sym[r, c], sym[r, c + 1])
                merged[r, c] = got
                best[r, c] = np.where(got >= 0, self.scores[got], -np.inf)
        self._retire(who, sym, lengths, out)

    def _retire(self, who: np.ndarray, sym: np.ndarray, lengths: np.ndarray, out: list) -> None:
        plain = ((sym >= 0) | (np.arange(sym.shape[1]) >= lengths[:, None])).all(1)
        for i, row, n, easy in zip(who.tolist(), sym.tolist(), lengths.tolist(), plain.tolist(), strict=True):
            out[i] = row[:n] if easy else [y for x in row[:n] for y in ((x,) if x >= 0 else self._emit(chr(-2 - x)))]

    def normalized(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def units(self, text: str) -> list[str]:
        text = self.normalized(text)
        return UNIT.findall(text) if self.splits else [text] * bool(text)

    def decode_unit(self, ids: list[int]) -> str:
        """Pieces to text; byte pieces form runs that are read as UTF-8, each bad byte as U+FFFD."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # a piece that isn't text by itself
            pass
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if self.kind[i] == NORMAL:
                out.append(self.shown[i])
            elif self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
        if run:
            out.append(_lenient(bytes(run)))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.side_by_side(self.units(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """All ids to text; only a space mark at the head of the first piece was added by encoding, a space from a byte or unknown piece was not."""
        text, first = self.decode_unit(ids), next((i for i in ids if self.kind[i] != CONTROL), self.unknown)
        return text[1:] if self.prefix and self.kind[first] == NORMAL and text.startswith(" ") else text


UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _lenient(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def merge_model(path: str) -> MergeModel:
    return MergeModel(path)


@lru_cache(maxsize=2)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Memory:
    """For each unit its ids joined by commas and its decoded text; learns the missing units of a batch at once."""

    def __init__(self, path: str):
        self.model, self.judge = merge_model(path), library(path)
        self.known = Generations(2)

    def learn(self, units: set[str]) -> None:
        new = self.known.missing(units)
        found = self.model.side_by_side(new)
        self._check(new, found)
        decimal, decode = self.model.decimal, self.model.decode_unit
        self.known.add(new, [",".join([decimal[i] for i in ids]) for ids in found], list(map(decode, found)))

    def _check(self, units: list[str], found: list[list[int]]) -> None:
        """The library adds the first space mark itself, so a unit is handed over without it."""
        cut = 1 if self.model.prefix else 0
        if not all(len(u) > cut and (not cut or u[0] == SPACE) for u in units):
            fit = [i for i, u in enumerate(units) if len(u) > cut and (not cut or u[0] == SPACE)]
            units, found = [units[i] for i in fit], [found[i] for i in fit]
        if self.judge.encode([u[cut:] for u in units], num_threads=1) != found:
            raise ValueError("the agenda and the sentencepiece library disagree")


_memory: dict[str, Memory] = {}


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encoder(path: str, keep_ids: bool, keep_text: bool):
    """A mapInArrow function over (id, text)."""

    def run(batches):
        if path not in _memory:
            _memory[path] = Memory(path)
        memory = _memory[path]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = _texts(part.column(1))
                units = [memory.model.units(t) for t in texts]
                memory.learn(set().union(*units))
                n, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
                ids_of, text_of = (known.__getitem__ for known in memory.known.recent)
                for doc in units:
                    ids = ",".join(map(ids_of, doc))
                    text = "".join(map(text_of, doc))
                    if memory.model.prefix and text.startswith(" "):
                        text = text[1:]
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        ids_out.append([int(x) for x in ids.split(",")] if ids else [])
                    if keep_text:
                        text_out.append(text)
                columns = {"id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                if keep_ids:
                    columns["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
                if keep_text:
                    columns["decoded"] = pa.array(text_out, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Encodes and decodes every text: id, n_tokens, digests, and on request ids and decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(encoder(model_path, keep_ids, keep_text), schema).withColumnRenamed("id", id_col)
