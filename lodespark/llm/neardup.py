"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle is five words in a row (all words of a shorter text). Its weight in a
text is the number of times it occurs times the mean inverse document frequency
of its words. Frequencies are counted over all documents, by word in a fixed
number of hash buckets: a frequency of the shingle itself would be the size of
the copy group it stands in, and would take the weight from what the copies
share, so that large groups fall apart.

Improved consistent weighted sampling draws one (shingle, level) for each of
BANDS * ROWS hash functions; two texts draw the same with the probability of
their weighted Jaccard similarity. ROWS draws make a band; texts that agree on a
band meet in a bucket. With 10 bands of 3 a pair of similarity 0.8 meets with
probability 0.999.

Links between different texts come from two rounds. First each text of a bucket
is compared with the bucket's least text. Links make classes. Where a bucket
still holds more than one class, the texts outside its largest class are compared
with every text of another class in it: in a bucket of up to SMALL texts as pairs,
in a larger one block by block, where a task keeps the classes it has joined,
passes over pairs of one class and returns only the links that joined two. So
each pair of texts that met is either compared or already in one class, and the
classes are those that all pairs would give, but no group's pairs are ever
listed. Every link is verified by its exact weighted Jaccard similarity.

Texts are known by their MD5, so copies are one node. Nothing but the fixed table
of word frequencies (BUCKETS numbers) reaches the driver.

Cases: texts without words (null, empty, blank) are alone, class id their own id;
rows with the same id stand for their own texts; a class takes the least id in it,
null only when it has no other; classes that share an id have the same class id
and are told apart by component, the least MD5 among their texts (null for a text
without words); ties in sampling go to the first shingle of the sorted ones; empty
tables give an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm import grams
from lodespark.operators.components import connected_components
from lodespark.session import written

WORDS = 5
BANDS, ROWS = 10, 3
SIMILAR = 0.8
BUCKETS = 1 << 14
SLICE = 512 << 10
#: Texts of a bucket whose pairs are listed; the mean number of texts in a block of a larger bucket.
SMALL, BLOCK = 32, 96


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 14)).astype(np.int64)


def _frequency_rows(batches):
    total, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for part in grams.slices(batch, 0, SLICE):
            h, doc, _ = grams.word_hashes(part.column(0))
            pairs = np.unique(doc * BUCKETS + _bucket(h))
            total += np.bincount(pairs & (BUCKETS - 1), minlength=BUCKETS)
            docs += len(np.unique(doc))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1).astype(np.int32)), pa.array(np.append(total[there], docs))], ["bucket", "n"])


def word_idf(texts: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of each bucket of words, at least 1."""
    counted = texts.select("text").mapInArrow(_frequency_rows, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = dict(map(tuple, counted.collect()))
    df = np.array([found.get(b, 0) for b in range(BUCKETS)], float)
    return np.log((found.get(-1, 0) + 1) / (df + 1)) + 1


def weighted_shingles(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, document), sorted by document and shingle, each shingle once in a document."""
    h, doc, first = grams.word_hashes(column)
    s, at = grams.windows(h, doc, first, list(range(WORDS)), whole=True)
    run = np.concatenate([[0.0], np.cumsum(idf[_bucket(h)])])
    end = np.minimum(at + WORDS, first[doc[at] + 1])
    mean = (run[end] - run[at]) / (end - at)
    d = doc[at]
    order = np.lexsort((s, d))
    s, d, mean = s[order], d[order], mean[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    tf = np.diff(np.append(begin, len(s)))
    # the mean comes from the first place after a stable sort; windows with equal words have equal means up to rounding
    return s[begin], np.round(tf * mean[begin], 4).astype(np.float32), d[begin]


def _uniform(k: int) -> np.ndarray:
    x = grams.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(2 * k + 1) + np.uint64(k << 40))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


#: Gamma(2, 1) variates by 16 bits of a shingle's hash.
GAMMA_R = (-np.log(_uniform(1)) - np.log(_uniform(2))).astype(np.float32)
LOG_C = np.log(-np.log(_uniform(3)) - np.log(_uniform(4))).astype(np.float32)


def draws(s: np.ndarray, w: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """n draws (hashes of shingle and level) for each document in d; documents in ascending order."""
    begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    row = np.cumsum(np.concatenate([[False], d[1:] != d[:-1]]))
    log_w = np.log(w)
    out = np.empty((n, len(begin)), np.uint64)
    for k in range(n):
        z = grams.mix(s + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = GAMMA_R[z & np.uint64(0xFFFF)]
        c = LOG_C[(z >> np.uint64(16)) & np.uint64(0xFFFF)]
        beta = (z >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        log_a = c - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, begin)
        at = np.flatnonzero(log_a == least[row])
        at = at[np.concatenate([[True], row[at][1:] != row[at][:-1]])]
        out[k] = grams.mix(s[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return out


def _signature_rows(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in grams.slices(batch, 1, SLICE):
                n = part.num_rows
                bands, total = np.zeros((n, BANDS), np.uint64), np.zeros(n, np.float64)
                s, w, d = weighted_shingles(part.column(1), idf)
                if len(s):
                    whose = np.unique(d)
                    drawn = draws(s, w, d, BANDS * ROWS)
                    for b in range(BANDS):
                        x = np.full(len(whose), b, np.uint64)
                        for j in range(ROWS):
                            x = grams.mix(x * np.uint64(0x9FB21C651E98DF25) + drawn[b * ROWS + j])
                        bands[whose, b] = x
                    total = np.bincount(d, w.astype(np.float64), n)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists, pa.array(total)], ["doc_id", "node", "bands", "total"])

    return run


def _vector_rows(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in grams.slices(batch, 1, SLICE):
                s, w, d = weighted_shingles(part.column(1), idf)
                at = np.searchsorted(d, np.arange(part.num_rows + 1)).tolist()
                cuts = list(zip(at, at[1:], strict=False))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([w[a:b].tobytes() for a, b in cuts], pa.binary())], ["node", "s", "w"])

    return run


def similarity(s1: bytes, w1: bytes, s2: bytes, w2: bytes) -> float:
    """Weighted Jaccard similarity of two sorted shingle vectors."""
    a, b = np.frombuffer(s1, np.uint64), np.frombuffer(s2, np.uint64)
    x, y = np.frombuffer(w1, np.float32).astype(float), np.frombuffer(w2, np.float32).astype(float)
    if len(a) > len(b):
        a, b, x, y = b, a, y, x
    if not len(a):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = b[at] == a
    shared = np.minimum(x[hit], y[at[hit]]).sum()
    return float(shared / (x.sum() + y.sum() - shared))


def _verify_rows(similar: float):
    def run(batches):
        for batch in batches:
            u, v, *vectors = batch.columns
            keep = [similarity(*row) >= similar for row in zip(*[c.to_pylist() for c in vectors], strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])

    return run


def _block_rows(similar: float):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                band, left, right = (c[i].as_py() for c in batch.columns)
                links = joining_links(band, left, right, similar)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["u", "v"])

    return run


def joining_links(band: int, left: list[dict], right: list[dict], similar: float) -> list[tuple[bytes, bytes]]:
    """Links between texts of two blocks that join classes which no earlier link of these blocks joined."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    earlier = np.array([x["bands"][:band] for x in right], np.int64).reshape(len(right), band)
    totals = np.array([x["total"] for x in right])
    links = []
    for a in left:
        met_before = (earlier == np.array(a["bands"][:band], np.int64)).any(1)
        near = np.minimum(totals, a["total"]) >= (similar - 1e-6) * np.maximum(totals, a["total"])
        for k in np.flatnonzero(near & ~met_before).tolist():
            b = right[k]
            x, y = find(a["class"]), find(b["class"])
            if x != y and similarity(a["s"], a["w"], b["s"], b["w"]) >= similar:
                parent[x] = y
                links.append((a["node"], b["node"]))
    return links


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """A row for each document: id, MD5 of the text, bands, total weight (0: no words)."""
    texts = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_signature_rows(idf), f"doc_id {kind}, node binary, bands array<bigint>, total double")


class _Texts:
    """The distinct texts with words, their buckets and, on request, their vectors."""

    def __init__(self, docs: DataFrame, rows: DataFrame, idf: np.ndarray, similar: float):
        self.docs, self.idf, self.similar = docs, idf, similar
        self.nodes = written(rows.where("total > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("total").alias("total")), "texts")
        self.met = self.nodes.select("node", "total", F.posexplode("bands").alias("band", "value"))

    def vectors(self, wanted: DataFrame) -> DataFrame:
        """Vectors of the wanted nodes, each from the text of its least id."""
        which = self.nodes.join(wanted, "node", "left_semi").select(F.col("node").alias("_n"), F.col("least_id").alias("_id"))
        texts = self.docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("node"))
        found = texts.join(which.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_n"))).select("node", "text").dropDuplicates(["node"])
        return written(found.mapInArrow(_vector_rows(self.idf), "node binary, s binary, w binary"), "vectors")

    def first_pairs(self) -> DataFrame:
        """Each text with the least text of each of its buckets."""
        heads = self.met.groupBy("band", "value").agg(F.min(F.struct("node", "total")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
        pairs = self.met.join(heads.hint("merge"), ["band", "value"]).where("node != head.node")
        return self._near_in_weight(pairs.select(F.col("head.node").alias("u"), F.col("node").alias("v"), F.col("head.total").alias("tu"), F.col("total").alias("tv")))

    def unsettled(self, classes: DataFrame) -> DataFrame:
        """(band, value, node, total, class, main, n) in buckets of n texts that hold several classes; main is the largest."""
        named = self.met.join(classes.select("node", "component").hint("merge"), "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
        sizes = named.groupBy("band", "value", "class").agg(F.count("*").alias("n"))
        many = sizes.groupBy("band", "value").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("classes"), F.sum("n").alias("n")).where("classes > 1").drop("classes")
        return written(named.join(many.hint("merge"), ["band", "value"]), "buckets")

    def other_pairs(self, inside: DataFrame, done: DataFrame) -> DataFrame:
        """In small buckets: texts outside the largest class with all texts of other classes."""
        inside = inside.where(F.col("n") <= SMALL)
        outside = inside.where("class != main").select("band", "value", F.col("node").alias("u"), F.col("class").alias("cu"), F.col("total").alias("tu"))
        both = outside.join(inside.hint("merge"), ["band", "value"]).where("class != cu").select("u", F.col("node").alias("v"), "tu", F.col("total").alias("tv"))
        ordered = both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "tu", "tv")
        return self._near_in_weight(ordered).join(done.hint("merge"), ["u", "v"], "left_anti")

    def block_links(self, inside: DataFrame) -> DataFrame:
        """The same in large buckets, block against block; a pair is compared in the first of its bands only."""
        inside = inside.where(F.col("n") > SMALL)
        vectors = self.vectors(inside.select("node").distinct()).join(self.nodes.select("node", "bands").hint("merge"), "node")
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("block")
        laid = inside.select("band", "value", "node", "total", "class", "main", block).join(vectors.hint("merge"), "node")
        member = F.collect_list(F.struct("node", "class", "total", "bands", "s", "w"))
        members = written(laid.groupBy("band", "value", "block").agg(member.alias("right")), "blocks").drop("block")
        outside = written(laid.where("class != main").groupBy("band", "value", "block").agg(member.alias("left")), "blocks").drop("block")
        both = outside.join(members.hint("merge"), ["band", "value"]).select("band", "left", "right")
        return written(both.mapInArrow(_block_rows(self.similar), "u binary, v binary"), "links")

    def _near_in_weight(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose total weights alone don't rule them out."""
        return pairs.where(F.least("tu", "tv") >= F.lit(self.similar - 1e-6) * F.greatest("tu", "tv")).select("u", "v").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        vectors = self.vectors(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct())
        left, right = vectors.toDF("u", "su", "wu"), vectors.toDF("v", "sv", "wv")
        rows = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", "su", "wu", "sv", "wv")
        return written(rows.mapInArrow(_verify_rows(self.similar), "u binary, v binary"), "links")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the least id of the class), class_size, n_texts (different texts), node, component (the class itself), for every row."""
    docs = docs.select("doc_id", "text")
    idf = word_idf(docs)
    rows = written(signatures(docs, idf), "signatures")
    texts = _Texts(docs, rows, idf, similar)
    pairs = written(texts.first_pairs(), "pairs")
    links = texts.verified(pairs)
    classes = connected_components(links, "u", "v")
    inside = texts.unsettled(classes)
    more = written(texts.other_pairs(inside, pairs), "pairs")
    found = links
    if not more.isEmpty():
        found = found.unionByName(texts.verified(more))
    if not inside.where(F.col("n") > SMALL).isEmpty():
        found = found.unionByName(texts.block_links(inside))
    if found is not links:
        classes = connected_components(found, "u", "v")
    named = texts.nodes.select("node", "least_id", "copies").join(classes.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    about = named.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n_texts"))
    by_node = named.select("node", "component").join(about, "component").select("node", "component", "class_id", "class_size", "n_texts")
    alone = rows.where("total = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_texts"), "node", F.lit(None).cast("binary").alias("component"))
    return rows.where("total > 0").select("doc_id", "node").join(by_node.hint("merge"), "node").select("doc_id", "class_id", "class_size", "n_texts", "node", "component").unionByName(alone)


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The documents without all but one of each class: the least id stays, the least text of equals, once."""
    columns = docs.columns
    found = near_duplicates(docs, similar)
    first = found.where("n_texts > 0").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.node").alias("_node"))
    keyed = docs.withColumn("_text", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept = keyed.join(first.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_node"))).dropDuplicates(["_id", "_node"])
    blank = docs.where(F.coalesce(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)) == 0)
    return kept.select(*columns).unionByName(blank.select(*columns))
