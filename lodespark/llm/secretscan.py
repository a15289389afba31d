"""Secret scans over a trigram inverted index.

Every rule's regular expression becomes a Boolean trigram query. `postings` is
the inverted index, a row for each (trigram, document) of the trigrams that the
rules ask for; `candidates` intersects and unites the posting lists as the
queries say; `scan` runs a rule's expression only on its candidates. Rules with
no mandatory trigram read every text. All of it is DataFrame operations.

The lists are intersected by document: each document's postings are folded into
bit sets, combined before the shuffle, so a trigram that most documents hold is
never one task's work.

Cases: a null or empty text has no spans; a null id is met by a null-safe join;
rows with the same id share their postings and are verified each on its own
text; an empty table gives an empty result; extra columns are left out. Positions
count code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.llm import trigrams
from lodespark.llm.quality import let


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("login", r"://[^\s/:@]+:[^\s/:@]+@"),
)
RULES = BASE + ADDED
#: Trigrams in one bit set.
BITS = 62


def wanted(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(trigrams.mentioned(trigrams.query(r.pattern)) for r in rules)))


def _below(text: Column) -> Column:
    """Lower case for A-Z only; the index never needs other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, doc_id)."""
    asked = F.split(F.lit("\n".join(wanted(rules))), "\n")
    held = let(_below(F.col(text_col)), lambda t: F.filter(asked, lambda g: F.contains(t, g)))
    return docs.select(F.explode(held).alias("trigram"), F.col(id_col).alias("doc_id"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document's postings satisfy."""
    asked = wanted(rules)
    place = {g: divmod(i, BITS) for i, g in enumerate(asked)}
    number = F.array_position(F.split(F.lit("\n".join(asked)), "\n"), F.col("trigram")).cast("int") - 1
    sets = [f"s{k}" for k in range((len(asked) + BITS - 1) // BITS)]
    bits = [F.bit_or(F.when(F.floor(number / BITS) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), number % BITS)).otherwise(0)).alias(s) for k, s in enumerate(sets)]

    def holds(q: trigrams.Query) -> Column:
        if isinstance(q, str):
            k, bit = place[q]
            return F.col(sets[k]).bitwiseAND(F.lit(1 << bit)) != 0
        parts = [holds(x) for x in q[1]]
        return reduce((lambda a, b: a & b) if q[0] == "and" else (lambda a, b: a | b), parts)

    queries = [(r, trigrams.query(r.pattern)) for r in rules]
    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(r.kind)) for r, q in queries if q is not True]))
    return index.groupBy("doc_id").agg(*bits).select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end), in code points."""
    pattern = rule.pattern
    if rule == BASE[2]:  # the same spans, found without the short runs
        pattern = f"[0-9a-f]{{{rule.least},}}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def place(m: Column) -> Column:
        pieces = F.zip_with(F.split(text, pattern, -1), m, lambda p, x: F.struct(F.length(p).alias("gap"), F.coalesce(F.length(x), F.lit(0)).alias("n")))
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + x["n"]).alias("end"))
            return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        placed = F.aggregate(F.slice(pieces, 1, F.size(m)), begin, step, lambda acc: acc["out"])
        long_enough = lambda all_spans: F.filter(all_spans, lambda s, i: F.length(F.get(groups, i)) >= rule.least) if rule.group else F.filter(all_spans, lambda s: s["end"] - s["start"] >= rule.least)
        return let(placed, long_enough)

    return let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text, `keep`, found: every rule's spans, sorted by start, then by the order of the rules."""
    full = {r.kind for r in rules if trigrams.query(r.pattern) is True}
    hits = candidates(postings(docs, rules, id_col, text_col), rules).withColumnRenamed("doc_id", "_hit")
    rows = docs.select(*dict.fromkeys([id_col, text_col, *keep])).join(hits.hint("merge"), F.col(id_col).eqNullSafe(F.col("_hit")), "left").drop("_hit")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for k, r in enumerate(rules):
        spans = spans_of(text, r, k)
        each.append(spans if r.kind in full else F.when(F.array_contains("kinds", r.kind), spans).otherwise(none))
    return rows.withColumn("found", F.sort_array(F.concat(*each))).drop("kinds")


def written_spans(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """For every document the number of base spans by kind, a digest of the base spans, and all spans."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written_spans(base, RULES), 256).alias("base_sha256"), written_spans(F.col("found"), RULES).alias("spans"),
    )


def masked(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span, overlapping ones joined, replaced by a mark; n_chars follows the text."""
    columns = docs.columns
    found = scan(docs, keep=tuple(c for c in columns if c not in ("doc_id", "text")))

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("found", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("found") > 0, clean).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def oracle() -> str:
    """The report as DuckDB SQL that runs every rule on every text."""
    lists, names = [], []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        lists.append(
            f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(p{k}[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda x: length(x))), 0)::BIGINT, 'kind': {k}, 'n': length(m{k}[i]), 'g': length(g{k}[i])}}), lambda s: s.g >= {r.least})"
        )
        names.append(f"regexp_extract_all(t, '{pattern}') AS m{k}, regexp_extract_all(t, '{pattern}', {r.group}) AS g{k}, string_split_regex(t, '{pattern}') AS p{k}")
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    shown = f"lambda s: {kinds}[s.kind + 1] || ':' || s.start || ':' || (s.start + s.n)"
    count = lambda k: f"len(list_filter(found, lambda s: s.kind = {k}))::BIGINT"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, {', '.join(names)} FROM texts),
spans AS (SELECT doc_id, list_sort({" || ".join(lists)}) AS found FROM parts)
SELECT doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex,
  sha256(coalesce(array_to_string(list_transform(list_filter(found, lambda s: s.kind < 3), {shown}), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(found, {shown}), ','), '') AS spans
FROM spans"""
