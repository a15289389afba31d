"""Token ids in seekable files: independent zstandard frames, a checksum for each, a seek table at the end.

One file holds the documents of one range of ids, in ascending order:

    data frames       little-endian unsigned 32-bit ids, `frame_ids` in a frame
    directory frames  for each document its id, whether the id is there, its number of ids
    skippable frame   magic 0x184D2A50: format mark, version, documents, data frames
    seek table        skippable frame 0x184D2A5E of the public zstandard seekable
                      format: compressed size, size and low 32 bits of XXH64 for every
                      frame, then the number of frames, a flag byte and 0x8F92EAB1

Any zstandard decoder reads the whole file; `TokenFile` reads the seek table and
the directory, then decompresses only the frames that hold the wanted documents.

Tokens come from the tokenizers library. Its normaliser and splitter never join
what white space separates, so words are encoded apart and remembered; a word of
European letters is first cut by the vocabulary's own split pattern, which leaves
fewer strings to encode. Tests hold this against encoding whole texts.

Cases: a null or empty text has the end id alone; rows with the same id are all
kept, ordered by a hash of their text; a null id sorts first; texts of any length
are whole, over as many frames as they need; an empty table gives no files and no
rows; extra columns are left out.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.llm.memory import Generations
from lodespark.session import scratch_path

FRAME_IDS = 65_536
SEEK_MAGIC, OWN_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
MARK = b"LODETOK1"
ENTRY = np.dtype([("doc_id", "<i8"), ("there", "u1"), ("n_ids", "<i8")])


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_ids * 4
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.pending: list[bytes] = []
        self.held = 0
        self.entries: list[tuple[int, int, int]] = []
        self.total = 0

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.compressor.compress(data)
        self.sink.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.entries.append((0 if doc_id is None else doc_id, doc_id is not None, len(ids) // 4))
        self.total += len(ids) // 4
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            data = b"".join(self.pending)
            whole = len(data) - len(data) % self.frame_bytes
            for at in range(0, whole, self.frame_bytes):
                self._frame(data[at : at + self.frame_bytes])
            self.pending, self.held = [data[whole:]], len(data) - whole

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.pending))
        data_frames = len(self.table)
        directory = np.array(self.entries, ENTRY).tobytes()
        for at in range(0, len(directory), self.frame_bytes):
            self._frame(directory[at : at + self.frame_bytes])
        own = MARK + struct.pack("<QQ", len(self.entries), data_frames)
        self.sink.write(struct.pack("<II", OWN_MAGIC, len(own)) + own)
        table = b"".join(struct.pack("<III", *x) for x in self.table)
        table += struct.pack("<IBI", len(self.table), 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class TokenFile:
    """Random access to one file; `source` can seek."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("not a seekable file with checksums")
        head = end - 9 - 12 * n - 8
        raw = self._at(head, 8 + 12 * n)
        if struct.unpack_from("<II", raw) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("broken seek table")
        table = np.frombuffer(raw, "<u4", offset=8).reshape(n, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.packed_at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.at = np.concatenate([[0], np.cumsum(table[:, 1])])
        own = self._at(int(self.packed_at[-1]), 8 + 24)
        if struct.unpack_from("<I", own)[0] != OWN_MAGIC or own[8:16] != MARK:
            raise ValueError("not a token file")
        docs, self.data_frames = struct.unpack_from("<QQ", own, 16)
        directory = b"".join(self._frame(i) for i in range(self.data_frames, n))
        self.directory = np.frombuffer(directory, ENTRY)
        if len(self.directory) != docs:
            raise ValueError("broken directory")
        self.starts = np.concatenate([[0], np.cumsum(self.directory["n_ids"])])

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _frame(self, i: int) -> bytes:
        import xxhash
        import zstandard

        packed = self._at(int(self.packed_at[i]), int(self.packed_at[i + 1] - self.packed_at[i]))
        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.at[i + 1] - self.at[i]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"checksum of frame {i}")
        return data

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in this row of the directory, from its own frames alone."""
        lo, hi = int(self.starts[row]) * 4, int(self.starts[row + 1]) * 4
        first, last = np.searchsorted(self.at, [lo, hi - 1], "right") - 1 if hi > lo else (0, -1)
        data = b"".join(self._frame(i) for i in range(first, last + 1))
        base = int(self.at[first])
        return np.frombuffer(data[lo - base : hi - base], "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        rows = np.flatnonzero((self.directory["doc_id"] == doc_id) & (self.directory["there"] == 1))
        return [self.ids(int(r)) for r in rows]

    def scan(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start in this file, ids as bytes) of every document; each frame is read once."""
        data, base, frame = b"", 0, 0
        for (doc_id, there, _), lo, hi in zip(self.directory.tolist(), (self.starts[:-1] * 4).tolist(), (self.starts[1:] * 4).tolist(), strict=True):
            if hi > base + len(data):
                parts = [data[lo - base :]]
                base, have = lo, len(parts[0])
                while hi > base + have:
                    parts.append(self._frame(frame))
                    have += len(parts[-1])
                    frame += 1
                data = b"".join(parts)
            yield (doc_id if there else None), lo // 4, data[lo - base : hi - base]


#: The split pattern of the vocabulary (a fixed value of its file), and the characters of its classes up to U+017F and in their small letters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = ("".join(regex.findall(rf"\p{{{k}}}", "".join(map(chr, [*range(0x80, 0x180), 0x307])))) for k in "LN")
PARTS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z{_LETTERS}]+|[0-9{_NUMBERS}]|[^\sa-zA-Z{_LETTERS}0-9{_NUMBERS}]+")
#: Words of other characters than these go whole to the library. Words of these are cut here: they are stable under NFC, and their case and classes are settled.
UNSETTLED = re.compile("[^\n]*[^\n!-;=-~\xa1-\u017f][^\n]*")
_END_OF_WORD = b"\xff\xff\xff\xff"


class Words:
    """White-space-free strings to their ids as bytes, by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = Generations(1), Generations(1, 48 << 20)
        self.ends = self._ends(path)

    def _ends(self, path: str) -> np.ndarray | None:
        """Which ids end a part; None if the vocabulary doesn't say.

        It does if every byte has a symbol with the suffix of a part's end, and
        merges make a symbol with that suffix from one that has it and from no other.
        """
        with open(path, "rb") as f:
            model = json.load(f)["model"]
        suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
        if not suffix or model.get("unk_token") or model.get("dropout") or sum(len(t) == 1 and t + suffix in vocabulary for t in vocabulary) < 256:
            return None
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if left.endswith(suffix) or (left + right).endswith(suffix) != right.endswith(suffix):
                return None
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return ends

    def _library(self, strings: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [struct.pack(f"<{len(i)}I", *i) for i in (e.ids for e in found)]

    def _side_by_side(self, parts: list[str]) -> list[bytes]:
        """Parts of settled words, which the splitter leaves whole: many in one string, taken apart where an id ends a part."""
        out: list[bytes] = []
        for lo in range(0, len(parts), 4096):
            some = parts[lo : lo + 4096]
            if self.ends is not None:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(some) and last[-1] == len(ids) - 1:
                    data, cut = ids.tobytes(), (4 * last + 4).tolist()
                    out += [data[a:b] for a, b in zip([0, *cut], cut, strict=False)]
                    continue
            out += self._library(some)
        return out

    def _cut(self, words: list[str]) -> list[bytes]:
        """Settled words by their parts: one search over all of them, in which a line is a word."""
        parts = PARTS.findall("\n".join(words).lower())
        new = self.parts.missing(set(parts))
        if "\n" in new:
            new.remove("\n")
            self.parts.add(["\n"], [_END_OF_WORD])
        self.parts.add(new, self._side_by_side(new))
        ids = b"".join(map(self.parts.recent[0].__getitem__, parts))
        ends = (4 * np.flatnonzero(np.frombuffer(ids, "<u4") == 0xFFFFFFFF)).tolist()
        return [ids[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(ids)], strict=True)]

    def learn(self, words: set[str]) -> None:
        words.discard("")
        new = self.words.missing(words)
        whole = set(UNSETTLED.findall("\n".join(new)))
        settled = [w for w in new if w not in whole] if whole else new
        if settled:
            self.words.add(settled, self._cut(settled))
        if whole:
            whole = list(whole)
            self.words.add(whole, self._library(whole))

    def encode(self, texts: list[str], end_id: int | None) -> list[bytes]:
        docs = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*docs))
        known, end = self.words.recent[0], b"" if end_id is None else struct.pack("<I", end_id)
        known[""] = b""
        word = known.__getitem__
        return [b"".join(map(word, d)) + end for d in docs]


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


MANIFEST = "part int, path string, n_docs bigint, n_ids bigint"


def _write_part(tokenizer: str, folder: str, end_id: int | None, frame_ids: int):
    def run(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        sink = writer = None
        words = words_of(tokenizer)
        fs, root = _fs(folder)
        name = f"{root}/tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(texts, end_id), strict=True):
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        sink = fs.open_output_stream(name, compression=None)
                        writer = Writer(sink, frame_ids)
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            sink.close()
            row = {"part": [TaskContext.get().partitionId()], "path": [name], "n_docs": [len(writer.entries)], "n_ids": [writer.total]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS) -> list:
    """Writes the documents in ascending id order, a file for each range of ids; returns the manifest's rows in order.

    A file is named in the manifest only by the attempt that finished it, so
    retried, lost and speculative tasks leave nothing that is ever read. The
    manifest has a row for each file and is all that reaches the driver.
    """
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    ranged = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted(ranged.mapInArrow(_write_part(tokenizer, folder, end_id, frame_ids), MANIFEST).collect())


def _read_part(folder: str, keep_ids: bool, id_col: str):
    def run(batches: Iterable[pa.RecordBatch]):
        fs, _ = _fs(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    rows: list[tuple] = []
                    for doc_id, start, ids in TokenFile(source).scan():
                        rows.append((doc_id, base + start, len(ids) // 4, zlib.crc32(ids), ids if keep_ids else None))
                        if len(rows) == 4096:
                            yield _rows(rows, keep_ids, id_col)
                            rows = []
                    if rows:
                        yield _rows(rows, keep_ids, id_col)

    return run


def _rows(rows: list[tuple], keep_ids: bool, id_col: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    out = {n: pa.array(c, pa.int64()) for n, c in zip((id_col, "start", "n_tokens", "ids_crc32"), columns, strict=False)}
    if keep_ids:
        out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in columns[4]], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(out)


def read(spark: SparkSession, folder: str, manifest: list, keep_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files with its start among all ids, its number of ids and their crc32."""
    rows, base = [], 0
    for row in manifest:
        rows.append((row["path"], base))
        base += row["n_ids"]
    schema = f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    files = spark.createDataFrame(rows, "path string, base bigint")
    if len(rows) > 1:
        files = files.repartition(min(len(rows), 8192), "path")
    return files.mapInArrow(_read_part(folder, keep_ids, id_col), schema)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, keep_ids: bool = False) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    return read(spark, folder, write(docs, folder, tokenizer, end_id), keep_ids)
