"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, and plain base rules.

Every word and every pair of neighbouring words is hashed into `buckets`
buckets. Two multinomials over the buckets are counted, each over all of its
documents: the target over documents that the labels trust (every quality label
of the document is 1), the raw one over the whole corpus, both with one count
added to every bucket. A document's score is the mean over its n-grams of
log(target share / raw share); it is kept when the base rules pass and the score
is at least `threshold`. The rule is the same for every document and every run.

The trusted ids grow with the corpus, so they are joined by a shuffle at every
size. Only the two count vectors, `buckets` numbers each, reach the driver; the
weights go back as one literal. Everything runs in the JVM.

Cases: a null or empty text has no words and fails the base rules; rows with the
same id are judged each on its own text, and all of them are trusted or none;
without trusted documents every score is 0; labels of unknown documents and null
labels are passed over; extra columns are left out.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 65_536
THRESHOLD = -0.06
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """Binds a value once for a lambda body, so that it isn't computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks; none for null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def ngram_buckets(words: Column, buckets: int) -> Column:
    """The buckets of all words and all pairs of neighbours."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = let(words, lambda ws: F.transform(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(F.get(ws, i), w), F.lit(buckets)).cast("int")))
    return F.concat(single, pairs)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, the first one included.

    Windows are compared by a 64-bit hash.
    """

    def counted(ws: Column) -> Column:
        windows = F.transform(F.slice(ws, 3, F.size(ws) - 2), lambda w, i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), w))
        return let(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("bigint")).otherwise(covered(hs)))

    def covered(hs: Column) -> Column:
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda _, i: same(i, i - 1) | same(i, i + 1)), lambda e: e["i"]))

        def spread(at: Column) -> Column:
            steps = F.transform(at, lambda p, j: F.coalesce(F.least(F.get(at, j + 1) - p, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(let(placed, again), spread)

    return let(words, lambda ws: F.when(F.size(ws) >= 3, counted(ws)).otherwise(F.lit(0).cast("bigint")))


def base_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds the counts of the base rules to rows with `text`; the columns in `keep` stay."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    rows = docs.select(*dict.fromkeys([*keep, "text"]), words_of(F.col("text")).alias("words"))
    counted = rows.select(
        *keep, "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.coalesce(F.length(F.translate("text", BLANKS, "")), F.lit(0)).cast("bigint").alias("word_chars"),
        F.coalesce(F.length("text") - F.length(F.translate("text", SYMBOLS, "")), F.lit(0)).cast("bigint").alias("n_symbols"),
        F.coalesce(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").alias("trusted_id"), "quality").where("trusted_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("trusted_id").agg(F.min("quality").alias("worst")).where("worst = 1").select("trusted_id")


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(target share / raw share) of every bucket, from all documents."""
    rows = docs.select("doc_id", "text").join(trusted_ids(labels).hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = rows.select(F.col("trusted_id").isNotNull().cast("bigint").alias("t"), F.explode(ngram_buckets(words_of(F.col("text")), buckets)).alias("b"))
    raw, target = [1] * buckets, [1] * buckets
    for b, n, t in grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("t")).collect():
        raw[b] += n
        target[b] += t
    if sum(target) == buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [round(math.log(t) - math.log(r) + shift, 6) for t, r in zip(target, raw, strict=True)]


def judge(docs: DataFrame, weight: list[float], threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, score and verdict of every row."""
    table = F.from_json(F.lit(json.dumps(weight)), "array<double>")
    grams = ngram_buckets(F.col("words"), len(weight))
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(table, b))
    score = F.when(F.col("n_words") > 0, F.round(total / (2 * F.col("n_words") - 1), 6)).otherwise(F.lit(0.0))
    scored = base_rules(docs, list(keep)).withColumn("score", score).drop("words")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, score and kept for every document."""
    return judge(docs, weights(docs, labels, buckets), threshold)
