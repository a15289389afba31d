"""Language identification by a bidirectional gated recurrent network over bytes.

Two networks of HIDDEN gated units read each window of a text, one from its
start, one from its end; from both states every byte gets a probability for each
language, and the document's probabilities are the mean over all its bytes.
Windows of WINDOW bytes cover the whole text. The network is trained here, in
numpy, by backpropagation through time on the labels of single positions.

Training takes at most PER_LANGUAGE labelled documents of each language, those
with the least hashes of id and text; equal rows count once. That bound on rows is
the same at every corpus size and holds whatever ids repeat: of rows whose hash is
low enough, every task keeps its own least ones, and these are brought together. Chosen texts are
learned from over their whole length; a step of training draws its windows from
all of theirs, each document alike. Prediction sees the text alone.

Cases: a null text, or one without any letter, is `und` with score 0; so is every
text when no labelled document can be learned from; a null id counts as remainder
0; ties go to the language that sorts first; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.llm import grams

HIDDEN, WINDOW = 8, 160
PER_LANGUAGE = 400
STEPS, BATCH, TRAIN_WINDOW, RATE = 260, 256, 64, 0.02
PAD = 256
_LETTER = regex.compile(r"\p{L}")


def _init(n_langs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for side in "fb":
        p["W" + side] = rng.normal(0, 0.3, (PAD + 1, 3 * HIDDEN))
        p["U" + side] = rng.normal(0, 0.35, (HIDDEN, 3 * HIDDEN))
        p["V" + side] = rng.normal(0, 0.3, (HIDDEN, n_langs))
    p["c"] = np.zeros(n_langs)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _side(W, U, x: np.ndarray, keep: np.ndarray):
    """States (time, row, unit) of one reading direction, with what backpropagation needs; x: (time, row)."""
    H, h, trace, states = HIDDEN, np.zeros((x.shape[1], HIDDEN)), [], []
    for t in range(len(x)):
        a, b = W[x[t]], h @ U
        zr = _sigmoid(a[:, : 2 * H] + b[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(a[:, 2 * H :] + r * b[:, 2 * H :])
        new = (n + z * (h - n)) * keep[t][:, None]
        trace.append((h, z, r, n, b[:, 2 * H :]))
        states.append(new)
        h = new
    return states, trace


def _side_back(W, U, x, keep, trace, d_states):
    H, dW, dU = HIDDEN, np.zeros_like(W), np.zeros_like(U)
    dh = np.zeros_like(trace[0][0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, bn = trace[t]
        d = (dh + d_states[t]) * keep[t][:, None]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * bn * r * (1 - r)
        da = np.concatenate([dz, dr, dn], 1)
        db = np.concatenate([dz, dr, dn * r], 1)
        for k in range(3 * H):
            dW[:, k] += np.bincount(x[t], da[:, k], PAD + 1)
        dU += h.T @ db
        dh = d * z + db @ U.T
    return dW, dU


def loss_and_gradient(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over all real positions; x: (time, row) of bytes or PAD, y: a language for each row."""
    keep = (x != PAD).astype(float)
    fs, ft = _side(p["Wf"], p["Uf"], x, keep)
    bs, bt = _side(p["Wb"], p["Ub"], x[::-1], keep[::-1])
    bs = bs[::-1]
    n = keep.sum()
    loss, g = 0.0, {k: np.zeros_like(v) for k, v in p.items()}
    df, db = [], []
    for t in range(len(x)):
        o = fs[t] @ p["Vf"] + bs[t] @ p["Vb"] + p["c"]
        e = np.exp(o - o.max(1, keepdims=True))
        q = e / e.sum(1, keepdims=True)
        rows = np.arange(len(y))
        loss -= float((np.log(q[rows, y] + 1e-12) * keep[t]).sum()) / n
        q[rows, y] -= 1
        q *= (keep[t] / n)[:, None]
        g["Vf"] += fs[t].T @ q
        g["Vb"] += bs[t].T @ q
        g["c"] += q.sum(0)
        df.append(q @ p["Vf"].T)
        db.append(q @ p["Vb"].T)
    g["Wf"], g["Uf"] = _side_back(p["Wf"], p["Uf"], x, keep, ft, df)
    g["Wb"], g["Ub"] = _side_back(p["Wb"], p["Ub"], x[::-1], keep[::-1], bt, db[::-1])
    return loss, g


def windows_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """((window, byte) padded with PAD, document of each window): windows that cover every text."""
    n = -(-np.diff(offsets) // size)
    doc = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[doc] + nth * size
    at = begin[:, None] + np.arange(size)
    inside = at < offsets[doc + 1][:, None]
    wide = np.append(data.astype(np.int16), np.int16(PAD))
    return wide[np.where(inside, at, len(data))], doc


def train(texts: list[str], labels: list[int], n_langs: int, steps: int = STEPS, seed: int = 17) -> dict[str, np.ndarray]:
    """Adam on windows of the texts: languages in equal parts, then documents, then any window of the whole document."""
    rng = np.random.default_rng(seed)
    data, offsets = grams.flat(pa.array(texts, pa.string()))
    sizes, y = np.diff(offsets), np.array(labels)
    padded = np.append(data.astype(np.int16), np.int16(PAD))
    by = [np.flatnonzero((y == k) & (sizes > 0)) for k in range(n_langs)]
    by = [b for b in by if len(b)]
    p = _init(n_langs, rng)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    each = max(1, BATCH // max(1, len(by)))
    for step in range(1, steps + 1):
        pick = np.concatenate([b[rng.integers(0, len(b), each)] for b in by])
        nth = (rng.random(len(pick)) * -(-sizes[pick] // TRAIN_WINDOW)).astype(np.int64)
        at = (offsets[pick] + nth * TRAIN_WINDOW)[:, None] + np.arange(TRAIN_WINDOW)
        x = padded[np.where(at < offsets[pick + 1][:, None], at, len(data))]
        _, g = loss_and_gradient(p, np.ascontiguousarray(x.T), y[pick])
        rate = RATE * (1 - 0.9 * step / steps)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


class Reader:
    """The trained network laid out for reading: float32, with the halves of the sigmoids folded into the weights."""

    def __init__(self, p: dict[str, np.ndarray]):
        half = np.ones(3 * HIDDEN)
        half[: 2 * HIDDEN] = 0.5
        self.sides = []
        for side in "fb":
            W = p["W" + side] * half
            W[PAD] = 0
            W[PAD, :HIDDEN] = 40  # the update gate stays shut, so a state passes through the padding
            self.sides.append((W.astype(np.float32), (p["U" + side] * half).astype(np.float32), p["V" + side].astype(np.float32)))
        self.c = p["c"].astype(np.float32)

    def _states(self, side: int, x: np.ndarray) -> np.ndarray:
        W, U, _ = self.sides[side]
        H, rows = HIDDEN, x.shape[1]
        out = np.empty((len(x), rows, H), np.float32)
        h, b, n = np.zeros((rows, H), np.float32), np.empty((rows, 3 * H), np.float32), np.empty((rows, H), np.float32)
        for t in range(len(x)) if side == 0 else range(len(x) - 1, -1, -1):
            a = W.take(x[t], 0)
            np.matmul(h, U, out=b)
            gates = b[:, : 2 * H]
            gates += a[:, : 2 * H]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[:, H:], b[:, 2 * H :], out=n)
            n += a[:, 2 * H :]
            np.tanh(n, out=n)
            h -= n
            h *= gates[:, :H]
            h += n
            out[t] = h
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(time, row, language) probabilities; x: (time, row)."""
        o = self._states(0, x) @ self.sides[0][2]
        o += self._states(1, x) @ self.sides[1][2]
        o += self.c
        o -= o.max(2, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(2, keepdims=True)
        return o

    def documents(self, column: pa.Array, rows: int = 2048) -> np.ndarray:
        """(document, language): the mean over all bytes; zeros for an empty text."""
        data, offsets = grams.flat(column)
        x, doc = windows_of(data, offsets, WINDOW)
        total = np.zeros((len(column), len(self.c)))
        for lo in range(0, len(x), rows):
            some = np.ascontiguousarray(x[lo : lo + rows].T)
            q = self.positions(some)
            q *= (some != PAD)[:, :, None]
            np.add.at(total, doc[lo : lo + rows], q.sum(0))
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def _least_rows(per_language: int):
    """A task's rows with the least places of each language; equal texts of a language once."""

    def run(batches):
        held: dict[str, dict[int, str]] = {}
        worst: dict[str, int] = {}
        for batch in batches:
            for i, (lang, place) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if place >= worst.get(lang, 1 << 63):
                    continue
                own = held.setdefault(lang, {})
                own[place] = batch.column(2)[i].as_py()
                if len(own) > per_language:
                    del own[max(own)]
                if len(own) == per_language:
                    worst[lang] = max(own)
        rows = [(lang, place, text) for lang, own in held.items() for place, text in own.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["lang", "place", "text"])

    return run


def sample(docs: DataFrame, learn, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[int], list[str]]:
    """(texts, their languages, names of the languages) of at most `per_language` labelled rows of each language."""
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    placed = rows.select("lang", F.xxhash64("doc_id", "text").alias("place"), "text")
    # some twice as many as wanted lie below this place, so that what meets in one task stays small however many tasks there are
    different = {r.lang: r.n for r in placed.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()}
    if not different:
        return [], [], []
    below = {k: -(1 << 63) + min((1 << 64) - 1, (2 * per_language + 200) * (1 << 64) // n) for k, n in different.items()}
    top = F.element_at(F.create_map(*[F.lit(x) for k, v in below.items() for x in (k, v)]), F.col("lang"))
    few = placed.where(F.col("place") <= top).mapInArrow(_least_rows(per_language), "lang string, place bigint, text string")
    best = Window.partitionBy("lang").orderBy("place")
    got = few.dropDuplicates(["lang", "place"]).withColumn("n", F.row_number().over(best)).where(F.col("n") <= per_language).orderBy("lang", "place").collect()
    names = sorted({r.lang for r in got})
    return [r.text for r in got], [names.index(r.lang) for r in got], names


def _predict_rows(shared):
    def run(batches):
        reader, names = shared.value
        for batch in batches:
            for part in grams.slices(batch, 2, 1 << 20):
                letters = [t is not None and _LETTER.search(t) is not None for t in part.column(2).to_pylist()]
                q = reader.documents(part.column(2)) if names else np.zeros((part.num_rows, 1))
                best = q.argmax(1)
                known = [bool(names) and a for a in letters]
                langs = [names[k] if a else "und" for k, a in zip(best.tolist(), known, strict=True)]
                score = np.where(known, np.clip(q[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns where crc32(id as text) modulo `fold` isn't `held`."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False))
    texts, labels, names = sample(docs, ~out)
    model = (Reader(train(texts, labels, len(names))) if names else None, names)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    return rows.mapInArrow(_predict_rows(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
