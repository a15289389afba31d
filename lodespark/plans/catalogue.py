"""Registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions import scalars as S
from lodespark.operators import bfr, cf, eda, graph, itemsets, lsh, sketches, stack
from lodespark.operators import features as X
from lodespark.sources.readers import product_id, table
from lodespark.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A set of brands is frequent in this share of the baskets.
SHARE, SHARE3 = 0.0237, 0.0031
#: Parts that two customers share to be joined: in most graph queries, where shortest paths are counted, and where edges are cut one after the other.
EDGES, DENSE, CUT = 3, 5, 8


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- shared inputs ---------------------------------------------------------------

RATINGS = "ratings AS (SELECT o_custkey AS u, l_suppkey AS b, avg(ceil(l_quantity / 10)) AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
SPLIT = "split AS (SELECT u, b, stars, ('0x' || substr(md5(u || '||' || b || '||hold'), 1, 8))::BIGINT % 1000 AS bucket FROM ratings)"
BASKETS = "baskets AS (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey)"
UB = "ub AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
CO = "co AS (SELECT a.u AS src, b.u AS dst, count(*) AS n FROM ub a JOIN ub b ON a.i = b.i AND a.u < b.u GROUP BY 1, 2)"


def edges_sql(threshold: int = EDGES) -> str:
    return f"{UB}, {CO}, edges AS (SELECT src, dst, n FROM co WHERE n >= {threshold})"


TOKENS = "tokens AS (SELECT DISTINCT doc_id AS d, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents)"


def ratings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.ceil(F.col("l_quantity") / 10).alias("stars"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("b")).agg(F.avg("stars").alias("stars"))


def brand_pairs(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("k"), F.col("p_brand").alias("i")).distinct()


def user_items(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i")).distinct()


def edges(spark: SparkSession, d: str, threshold: int = EDGES) -> DataFrame:
    """The customers' graph: those who share at least so many parts."""
    return graph.cooccurrence(user_items(spark, d), "u", "i", threshold)


def tokens(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "documents").select(F.col("doc_id").alias("d"), F.explode(words).alias("t")).distinct()


def held_out(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The ratings to learn from and those held out, written once for the many passes over them."""
    from lodespark.session import written

    split = written(ratings(spark, d).withColumn("bucket", S.pair_bucket("u", "b", "hold")), "split")
    return split.where("bucket >= 100").select("u", "b", "stars"), split.where("bucket < 100").select("u", "b", "stars")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- exploratory -----------------------------------------------------------------


@query("SELECT count(*) AS n, count(*) FILTER (WHERE year(o_orderdate) = 1998) AS n_chosen, count(DISTINCT o_custkey) AS n_users FROM orders")
def eda_counts(spark, d):
    return eda.counts(table(spark, d, "orders").select("o_orderdate", "o_custkey"), "o_custkey", F.year("o_orderdate") == 1998)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def eda_top10_users(spark, d):
    return eda.top_k(table(spark, d, "orders"), "o_custkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def eda_top10_items(spark, d):
    return eda.top_k(table(spark, d, "lineitem"), "l_partkey")


AVG = "SELECT coalesce(c_mktsegment, '') AS c_mktsegment, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def _averages(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return eda.average_by_group(table(spark, d, "orders"), customers, "o_custkey", "o_totalprice", "c_mktsegment")


@query(AVG)
def eda_avg_by_group(spark, d):
    return rounded(_averages(spark, d), "mean", digits=4)


@query("SELECT n_name, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY mean DESC, 1 LIMIT 10")
def eda_avg_top10(spark, d):
    nations = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return rounded(eda.average_by_group(table(spark, d, "orders"), nations, "o_custkey", "o_totalprice", "n_name").limit(10), "mean", digits=4)


CRC = (
    "WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM range(256) r(i))), "
    "k AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), "
    "c AS (SELECT n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(l_partkey::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(t[xor(a, b) % 256 + 1], a // 256)), 4294967295) % 27 AS part FROM k, t) "
)


@query(CRC + "SELECT p.part::INT AS part, coalesce(sum(n), 0)::BIGINT AS n FROM range(27) p(part) LEFT JOIN c ON c.part = p.part GROUP BY 1")
def eda_partition_stats(spark, d):
    return eda.partition_stats(table(spark, d, "lineitem"), "l_partkey", 27)


@query("WITH b AS (SELECT ('0x' || substr(md5(l_partkey::VARCHAR), 1, 8))::BIGINT % 27 AS part FROM lineitem) SELECT p.part::INT AS part, count(b.part) AS n FROM range(27) p(part) LEFT JOIN b ON b.part = p.part GROUP BY 1")
def eda_partition_stats_md5(spark, d):
    part = F.conv(F.substring(F.md5(F.col("l_partkey").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 27
    got = table(spark, d, "lineitem").groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    return spark.range(27).select(F.col("id").alias("part")).join(got, "part", "left").select(F.col("part").cast("int").alias("part"), F.coalesce("n", F.lit(0)).alias("n"))


# --- itemsets --------------------------------------------------------------------


@query(f"WITH {BASKETS} SELECT k, array_to_string(list_sort(list(i)), ',') AS items FROM baskets GROUP BY k HAVING count(*) > 3")
def basket_user_items(spark, d):
    return itemsets.baskets(brand_pairs(spark, d), "k", "i", 3).select("k", F.array_join("items", ",").alias("items"))


@query(f"WITH {BASKETS} SELECT i, len(list(k)) AS n, min(k) AS least FROM baskets GROUP BY i")
def basket_item_users(spark, d):
    return itemsets.baskets(brand_pairs(spark, d), "i", "k").select("i", F.size("items").cast("bigint").alias("n"), F.array_min("items").alias("least"))


def _itemset_sql(sizes: tuple[int, ...]) -> str:
    parts = {
        1: "SELECT i AS items, 1 AS size, count(*) AS n FROM baskets GROUP BY i",
        2: "SELECT a.i || ',' || b.i, 2, count(*) FROM baskets a JOIN baskets b ON a.k = b.k AND a.i < b.i GROUP BY 1",
        3: "SELECT a.i || ',' || b.i || ',' || c.i, 3, count(*) FROM baskets a JOIN baskets b ON a.k = b.k AND a.i < b.i JOIN baskets c ON c.k = b.k AND b.i < c.i GROUP BY 1",
        4: "SELECT a.i || ',' || b.i || ',' || c.i || ',' || e.i, 4, count(*) FROM baskets a JOIN baskets b ON a.k = b.k AND a.i < b.i JOIN baskets c ON c.k = b.k AND b.i < c.i JOIN baskets e ON e.k = c.k AND c.i < e.i GROUP BY 1",
    }
    return f"WITH {BASKETS}, sets(items, size, n) AS ({' UNION ALL '.join(parts[s] for s in sizes)}) SELECT items, size, n FROM sets WHERE n >= {SHARE} * (SELECT count(DISTINCT k) FROM baskets)"


def _sets(spark, d, most=None):
    pairs = brand_pairs(spark, d)
    found = itemsets.frequent_itemsets(pairs, "k", "i", itemsets.association_support(pairs, "k", SHARE), most)
    return found.select(F.array_join("items", ",").alias("items"), "size", "n")


@query(_itemset_sql((1,)))
def itemsets_k1(spark, d):
    return _sets(spark, d, 1)


@query(_itemset_sql((1, 2)))
def itemsets_k2(spark, d):
    return _sets(spark, d, 2)


@query(_itemset_sql((1, 2, 3)))
def itemsets_k3(spark, d):
    return _sets(spark, d, 3)


@query(_itemset_sql((1, 2, 3, 4)))
def itemsets_all(spark, d):
    return _sets(spark, d)


@query(_itemset_sql((1, 2, 3, 4)))
def itemsets_fpgrowth(spark, d):
    pairs = brand_pairs(spark, d)
    support = -int(-itemsets.association_support(pairs, "k", SHARE) // 1)
    return itemsets.fp_growth(pairs, "k", "i", support).select(F.array_join("items", ",").alias("items"), "size", "n")


SON = f"WITH {BASKETS}, p AS (SELECT k % 4 AS part, count(DISTINCT k) AS p FROM baskets GROUP BY 1), need AS (SELECT part, greatest(1, ceil({SHARE} * (SELECT sum(p) FROM p) * p / (SELECT sum(p) FROM p))) AS need FROM p), ones AS (SELECT k % 4 AS part, i FROM baskets JOIN need ON need.part = k % 4 GROUP BY 1, 2 HAVING count(*) >= any_value(need)) "


def _son(spark, d, size):
    pairs = brand_pairs(spark, d)
    return itemsets.son_candidates(pairs.withColumn("part", F.col("k") % 4), "k", "i", "part", itemsets.association_support(pairs, "k", SHARE), size)


@query(SON + "SELECT DISTINCT i AS item FROM ones")
def itemsets_candidates_k1(spark, d):
    return _son(spark, d, 1)


@query(SON + "SELECT DISTINCT item, item2 FROM (SELECT a.k % 4 AS part, a.i AS item, b.i AS item2, count(*) AS n FROM baskets a JOIN baskets b ON a.k = b.k AND a.i < b.i SEMI JOIN ones ON ones.part = a.k % 4 AND ones.i = a.i GROUP BY 1, 2, 3) x JOIN need USING (part) WHERE n >= need AND EXISTS (SELECT 1 FROM ones o WHERE o.part = x.part AND o.i = x.item2)")
def itemsets_candidates_k2(spark, d):
    return _son(spark, d, 2)


SON3 = (
    "p2 AS (SELECT part, item, item2 FROM (SELECT a.k % 4 AS part, a.i AS item, b.i AS item2, count(*) AS n FROM baskets a JOIN baskets b ON a.k = b.k AND a.i < b.i SEMI JOIN ones ON ones.part = a.k % 4 AND ones.i = a.i GROUP BY 1, 2, 3) x JOIN need USING (part) WHERE n >= need AND EXISTS (SELECT 1 FROM ones o WHERE o.part = x.part AND o.i = x.item2)), "
    "p3 AS (SELECT k % 4 AS part, a.i AS x, b.i AS y, c.i AS z, count(*) AS n FROM baskets a JOIN baskets b USING (k) JOIN baskets c USING (k) WHERE a.i < b.i AND b.i < c.i GROUP BY 1, 2, 3, 4) "
)


@query(SON.replace(str(SHARE), str(SHARE3)).rstrip() + ", " + SON3 + "SELECT DISTINCT x, y, z FROM p3 JOIN need USING (part) WHERE n >= need AND EXISTS (SELECT 1 FROM p2 WHERE p2.part = p3.part AND item = x AND item2 = y)")
def itemsets_candidates_k3(spark, d):
    """SON's first pass beyond pairs, at a lower support so that some sets of three are frequent."""
    pairs = brand_pairs(spark, d)
    sets = itemsets.son_candidates(pairs.withColumn("part", F.col("k") % 4), "k", "i", "part", itemsets.association_support(pairs, "k", SHARE3), 3)
    return sets.select(*[F.col("items")[i].alias(n) for i, n in enumerate("xyz")])


# --- similarity ------------------------------------------------------------------


@query()
def lsh_jaccard(spark, d):
    return rounded(lsh.lsh_join(tokens(spark, d), "d", "t"), "similarity")


@query(f"WITH {TOKENS}, n AS (SELECT d, count(*) AS n FROM tokens GROUP BY d), s AS (SELECT a.d AS id1, b.d AS id2, count(*) AS shared FROM tokens a JOIN tokens b ON a.t = b.t AND a.d < b.d GROUP BY 1, 2) SELECT count(*) AS n_exact, 0::BIGINT AS n_wrong, true AS recall_reached FROM s JOIN n n1 ON n1.d = id1 JOIN n n2 ON n2.d = id2 WHERE shared / (n1.n + n2.n - shared) >= 0.5")
def lsh_recall(spark, d):
    """The LSH join against the exact one: pairs that are none, and whether 97 % of those that are were found."""
    from lodespark.session import written

    held = written(tokens(spark, d), "tokens")
    exact, found = lsh.exact_join(held, "d", "t").select("id1", "id2", F.lit(1).alias("e")), lsh.lsh_join(held, "d", "t").select("id1", "id2", F.lit(1).alias("f"))
    both = exact.join(found, ["id1", "id2"], "full")
    return both.agg(F.count("e").alias("n_exact"), F.count_if(F.col("e").isNull()).alias("n_wrong"), (F.coalesce(F.count_if(F.expr("e = 1 AND f = 1")) / F.count("e"), F.lit(1.0)) >= 0.97).alias("recall_reached"))


@query(f"WITH {TOKENS}, n AS (SELECT d, count(*) AS n FROM tokens GROUP BY d), s AS (SELECT a.d AS id1, b.d AS id2, count(*) AS shared FROM tokens a JOIN tokens b ON a.t = b.t AND a.d < b.d GROUP BY 1, 2) SELECT id1, id2, round(shared / (n1.n + n2.n - shared), 6) AS similarity FROM s JOIN n n1 ON n1.d = id1 JOIN n n2 ON n2.d = id2 WHERE shared / (n1.n + n2.n - shared) >= 0.5")
def jaccard_exact(spark, d):
    return rounded(lsh.exact_join(tokens(spark, d), "d", "t"), "similarity")


@query(
    f"WITH {TOKENS}, ix AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS x FROM (SELECT DISTINCT t FROM tokens)), m AS (SELECT count(*) AS m FROM ix), "
    f"ab AS (SELECT unnest([{', '.join(f'[{a}, {b}]' for a, b in S.minhash_params())}]) AS p) "
    "SELECT d, p[1]::BIGINT AS a, min(((p[1]::BIGINT * x + p[2]) % 1299709) % m) AS least FROM tokens JOIN ix USING (t), m, ab GROUP BY 1, 2"
)
def minhash_signature(spark, d):
    from lodespark.session import written

    pairs = written(tokens(spark, d), "tokens")
    params = S.minhash_params()
    sigs = lsh.signatures(lsh.indexed(pairs, "t"), "d", "ix", max(1, pairs.select("t").distinct().count()), params)
    return sigs.select("d", F.posexplode("sig").alias("k", "least")).select("d", F.get(F.array(*[F.lit(a).cast("bigint") for a, _ in params]), F.col("k")).alias("a"), "least")


# --- collaborative filtering -----------------------------------------------------

MEANS = "mu AS (SELECT coalesce(avg(stars), 3.0) AS mu FROM {r}), um AS (SELECT u, sum(stars) AS total, count(*) AS n, avg(stars) AS mean, (sum(stars) + 5.0 * any_value(mu)) / (count(*) + 5.0) AS damped FROM {r}, mu GROUP BY u), bm AS (SELECT b, sum(stars) AS total, count(*) AS n, avg(stars) AS mean, (sum(stars) + {beta} * any_value(mu)) / (count(*) + {beta}) AS damped FROM {r}, mu GROUP BY b)"


@query(f"WITH {RATINGS}, {MEANS.format(r='ratings', beta='12.0')} SELECT u, n, round(mean, 6) AS mean, round(damped, 6) AS damped FROM um")
def cf_means_users(spark, d):
    return rounded(cf.means(ratings(spark, d), "u", 5.0).select("u", "n", "mean", "damped"), "mean", "damped")


@query(f"WITH {RATINGS}, {MEANS.format(r='ratings', beta='12.0')} SELECT b, n, round(mean, 6) AS mean, round(damped, 6) AS damped FROM bm")
def cf_means_items(spark, d):
    return rounded(cf.means(ratings(spark, d), "b", 12.0).select("b", "n", "mean", "damped"), "mean", "damped")


TRAIN = f"{RATINGS}, {SPLIT}, train AS (SELECT u, b, stars FROM split WHERE bucket >= 100), hold AS (SELECT u, b, stars FROM split WHERE bucket < 100)"


@query(f"WITH {RATINGS}, {SPLIT} SELECT u, b, bucket, bucket < 350 AS \"inner\" FROM split")
def split_md5(spark, d):
    return X.pair_split(ratings(spark, d).select("u", "b", "stars"), 0.35, "hold").select("u", "b", "bucket", "inner")


LADDER = "CASE WHEN um.damped IS NOT NULL AND bm.damped IS NOT NULL THEN least(greatest(um.damped + bm.damped - mu, 1.0), 5.0) ELSE coalesce(um.damped, bm.damped, mu) END"


@query(f"WITH {TRAIN}, {MEANS.format(r='train', beta='12.0')} SELECT hold.u, hold.b, round({LADDER}, 6) AS prediction FROM hold LEFT JOIN um USING (u) LEFT JOIN bm ON bm.b = hold.b, mu")
def cf_impute(spark, d):
    train, hold = held_out(spark, d)
    return rounded(cf.imputed(hold.select("u", "b"), train), "prediction")


PAIRS = "c AS (SELECT r.u, r.b, r.stars - bm.damped AS d FROM {r} r JOIN bm ON bm.b = r.b), s AS (SELECT x.b, y.b AS j, count(*) AS common, sum(x.d * y.d) AS num, sum(x.d * x.d) AS si, sum(y.d * y.d) AS sj FROM c x JOIN c y ON x.u = y.u AND x.b != y.b GROUP BY 1, 2), pairs AS (SELECT b, j, common, num / sqrt(si * sj) AS similarity FROM s WHERE common >= {co} AND num != 0 AND si > 0 AND sj > 0 AND abs(num / sqrt(si * sj)) >= {floor})"


@query(f"WITH {RATINGS}, {MEANS.format(r='ratings', beta='12.0')}, {PAIRS.format(r='ratings', co=5, floor=0.0)} SELECT b, j, common, round(similarity, 6) AS similarity FROM pairs")
def cf_pearson_pairs(spark, d):
    return rounded(cf.item_pairs(ratings(spark, d)), "similarity")


def _predict_sql(p: cf.CFParams) -> str:
    return (
        f"WITH {TRAIN}, {MEANS.format(r='train', beta=p.item_beta)}, {PAIRS.format(r='train', co=p.min_common, floor=p.min_similarity)}, "
        "near AS (SELECT h.u, h.b, p.j, t.stars, p.similarity, row_number() OVER (PARTITION BY h.u, h.b ORDER BY abs(p.similarity) DESC, p.j) AS rk FROM hold h JOIN train t ON t.u = h.u JOIN pairs p ON p.b = h.b AND p.j = t.b), "
        f"w AS (SELECT near.u, near.b, near.stars, bm.damped AS mj, CASE WHEN abs(similarity) > {p.dead} THEN sign(similarity) * pow(abs(similarity) - {p.dead}, {p.power}) ELSE 0 END AS w FROM near JOIN bm ON bm.b = near.j WHERE rk <= {p.neighbours}), "
        "a AS (SELECT w.u, w.b, sum(w * (stars - (um.damped + mj - mu))) AS num, sum(abs(w)) AS den, count(*) AS k_used FROM w JOIN um ON um.u = w.u, mu GROUP BY 1, 2) "
        f"SELECT hold.u, hold.b, round(CASE WHEN um.damped IS NOT NULL AND bm.damped IS NOT NULL AND a.den >= 1e-9 THEN least(greatest(um.damped + bm.damped - mu + a.num / a.den, 1.0), 5.0) ELSE {LADDER} END, 5) AS prediction, coalesce(k_used, 0) AS k_used "
        "FROM hold LEFT JOIN um ON um.u = hold.u LEFT JOIN bm ON bm.b = hold.b LEFT JOIN a ON a.u = hold.u AND a.b = hold.b, mu"
    )


@query(_predict_sql(cf.FIRST))
def cf_predict(spark, d):
    train, hold = held_out(spark, d)
    return rounded(cf.predict(hold, train).select("u", "b", "prediction", "k_used"), "prediction", digits=5)


@query(_predict_sql(cf.SECOND))
def cf_predict_second(spark, d):
    train, hold = held_out(spark, d)
    return rounded(cf.predict(hold, train, cf.SECOND).select("u", "b", "prediction", "k_used"), "prediction", digits=5)


# --- features --------------------------------------------------------------------


@query(f"WITH {RATINGS} SELECT u, round(avg(stars), 6) AS mean, count(*) AS n, round(greatest(0, var_pop(stars)), 6) AS variance FROM ratings GROUP BY u")
def feat_user_stats(spark, d):
    return rounded(X.moments(ratings(spark, d), "u"), "mean", "variance")


@query(f"WITH {RATINGS} SELECT b, round((sum(stars) + 110.0 * (SELECT avg(stars) FROM ratings)) / (count(*) + 110.0), 6) AS shrunk FROM ratings GROUP BY b")
def feat_shrunk_means(spark, d):
    return rounded(X.shrunk_means(ratings(spark, d), "b", 110.0), "shrunk")


@query(f"WITH {RATINGS}, n AS (SELECT count(*) AS n FROM ratings GROUP BY u), l AS (SELECT list_sort(list(n)) AS l FROM n) SELECT q, l[floor(q * (len(l) - 1))::INT + 1] AS value FROM l, (VALUES (0.9::DOUBLE), (0.9999::DOUBLE)) v(q)")
def feat_percentiles(spark, d):
    counts = X.moments(ratings(spark, d), "u")
    one = lambda q: X.count_percentile(counts, "n", q).select(F.lit(q).alias("q"), "value")
    return one(0.9).unionByName(one(0.9999))


@query("SELECT c_custkey, round(ln(1 + count(*) OVER (PARTITION BY c_nationkey)), 6) AS pop_log FROM customer")
def feat_city_pop(spark, d):
    return X.popularity(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", F.round(S.log1p_plus("n_c_nationkey"), 6).alias("pop_log"))


POS, NEG = ["the", "and", "le", "der", "de"], ["of", "is", "la", "die", "que"]
_in = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z]+') AS t, coalesce(length(text), 0) AS length FROM documents) SELECT doc_id, len(list_filter(t, lambda x: x IN ({_in(POS)})))::INT AS pos, len(list_filter(t, lambda x: x IN ({_in(NEG)})))::INT AS neg, length::INT AS length FROM t")
def feat_text_sentiment(spark, d):
    return table(spark, d, "documents").select("doc_id", S.review_sentiment("text", POS, NEG).alias("s")).select("doc_id", "s.*")


POS2, NEG2 = ["of the", "in the", "de la"], ["and the", "is the", "que la"]


@query(
    "WITH t AS (SELECT doc_id, length(text)::DOUBLE AS n_chars, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda x: x != '') AS t FROM documents), "
    f"k AS (SELECT *, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i < len(t) AND t[i] || ' ' || t[i + 1] IN ({_in(POS2)}) THEN 1 WHEN i < len(t) AND t[i] || ' ' || t[i + 1] IN ({_in(NEG2)}) THEN -1 ELSE 0 END) AS k FROM t), "
    "f AS (SELECT *, list_transform(list_filter(range(1, len(t) + 1), lambda i: k[i] = 0 AND (i = 1 OR k[i - 1] = 0)), lambda i: t[i]) AS free FROM k), "
    f"s AS (SELECT *, 2.0 * len(list_filter(k, lambda x: x = 1)) + len(list_filter(free, lambda x: x IN ({_in(POS)}))) AS p, 2.0 * len(list_filter(k, lambda x: x = -1)) + len(list_filter(free, lambda x: x IN ({_in(NEG)}))) AS n FROM f) "
    "SELECT doc_id, n_chars, len(t)::DOUBLE AS n_words, round((p - n) / (p + n + 1.0), 6) AS sentiment FROM s"
)
def feat_phrase_sentiment(spark, d):
    s = S.tip_sentiment("text", POS, NEG, POS2, NEG2)
    return rounded(table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.*"), "sentiment")


@query("WITH e AS (SELECT user_id, date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) AS age FROM events) SELECT user_id, count(*)::DOUBLE AS n, round(sum(exp(-ln(2) / 180 * age)), 6) AS decayed, count(*) FILTER (WHERE age <= 365)::DOUBLE AS recent, max(date_diff('day', DATE '0001-01-01', (SELECT max(ts)::DATE FROM events)) + 1)::INT AS now FROM e GROUP BY user_id")
def feat_decay(spark, d):
    rows = table(spark, d, "events").select("user_id", S.date_ordinal(F.date_format("ts", "yyyy-MM-dd")).alias("day"))
    now = rows.agg(F.max("day").alias("now"))
    age = F.col("now") - F.col("day")
    sums = rows.join(F.broadcast(now)).groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.sum(S.decay(age)).alias("decayed"), F.count_if(age <= 365).cast("double").alias("recent"), F.max("now").alias("now"))
    return rounded(sums, "decayed")


GROUPS = {"g_metal": ["STEEL", "BRASS", "COPPER", "NICKEL", "TIN"], "g_size": ["SMALL", "MEDIUM", "LARGE"], "g_kind": ["STANDARD", "PROMO", "ECONOMY"]}


@query("SELECT p_partkey, " + ", ".join(f"list_has_any(string_split(upper(p_type), ' '), [{_in(m)}])::INT::DOUBLE AS {g}" for g, m in GROUPS.items()) + ", len(string_split(upper(p_type), ' '))::DOUBLE AS n_items FROM part")
def feat_onehot(spark, d):
    return table(spark, d, "part").select("p_partkey", *S.one_hot(S.list_items(F.upper("p_type"), " "), GROUPS))


@query(
    "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, (lower(trim(event_type)) IN ('true', 'yes', 'y', '1'))::INT::DOUBLE AS flag, 1.0::DOUBLE AS noise, round(least(greatest(value, -1.05), 1.05), 6) AS capped, "
    "floor(value * 2) / 2 AS bin, (CASE WHEN value > 0 THEN round(ln(1 + value), 6) ELSE 0 END) AS logged, round_even(value, 0)::BIGINT AS even FROM events"
)
def feat_parse(spark, d):
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select(
        "event_id", S.map_total(F.map_filter(props, lambda k, _: k == "k")).alias("k"), S.parse_bool("event_type").alias("flag"), S.noise_level("event_type").alias("noise"),
        F.round(S.winsor("value", 1.05), 6).alias("capped"), S.geo_bin("value").alias("bin"), F.round(S.log1p_plus("value"), 6).alias("logged"), S.half_even("value").alias("even"),
    )


@query("SELECT p_partkey, regexp_replace('00' || p_partkey, '^0+([0-9])', '\\1') AS item FROM part")
def feat_product_id(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("00"), F.col("p_partkey").cast("string")).alias("raw")).select("p_partkey", product_id("raw").alias("item"))


BASE = f"{TRAIN}, mu AS (SELECT avg(stars) AS mu FROM train), us AS (SELECT u, avg(stars) AS mean, count(*) AS n, (sum(stars) + 20.0 * any_value(mu)) / (count(*) + 20.0) AS shrunk FROM train, mu GROUP BY u), bs AS (SELECT b, avg(stars) AS mean, count(*) AS n, (sum(stars) + 110.0 * any_value(mu)) / (count(*) + 110.0) AS shrunk FROM train, mu GROUP BY b), base AS (SELECT h.u, h.b, h.stars, coalesce(us.shrunk, mu) + coalesce(bs.shrunk, mu) - mu AS base, coalesce(us.n, 0) AS un, coalesce(bs.n, 0) AS bn, (coalesce(us.mean, mu) - mu) * (coalesce(bs.mean, mu) - mu) AS centred, coalesce(us.mean, mu) AS um, coalesce(bs.mean, mu) AS bm, mu FROM hold h LEFT JOIN us ON us.u = h.u LEFT JOIN bs ON bs.b = h.b, mu)"


def _base_rows(spark, d):
    train, hold = held_out(spark, d)
    return X.feature_rows(hold, train)


@query(f"WITH {BASE} SELECT u, b, round(base, 6) AS base, round(CASE WHEN un > 0 THEN ln(1 + un) ELSE 0 END, 6) AS u_n_log, round(CASE WHEN bn > 0 THEN ln(1 + bn) ELSE 0 END, 6) AS b_n_log, round(centred, 6) AS centred FROM base")
def feat_rows(spark, d):
    return rounded(_base_rows(spark, d).select("u", "b", "base", "u_n_log", "b_n_log", "centred"), "base", "u_n_log", "b_n_log", "centred")


@query(f"WITH {BASE}, r AS (SELECT u, b, CASE WHEN un > 0 THEN least(1.0, ln(1 + un) / 9.0) ELSE 0 END AS ru, CASE WHEN bn > 0 THEN least(1.0, ln(1 + bn) / 9.0) ELSE 0 END AS rb FROM base) SELECT u, b, round(0.67 + 0.33 * (CASE WHEN ru + rb > 0 THEN 2.0 * ru * rb / (ru + rb) ELSE 0 END), 6) AS reliance FROM r")
def feat_reliance(spark, d):
    return _base_rows(spark, d).select("u", "b", F.round(S.harmonic_reliance("u_n", "b_n", 9.0, 9.0, 0.67, 0.33), 6).alias("reliance"))


@query(f"WITH {BASE} SELECT round(sqrt(avg(pow(base - stars, 2))), 6) AS rmse FROM base")
def rmse(spark, d):
    return rounded(eda.rmse(_base_rows(spark, d), "base", "stars"), "rmse")


@query(f"WITH {BASE} SELECT least(floor(abs(base - stars)), 4)::INT AS bin, count(*) AS n FROM base GROUP BY 1")
def error_histogram(spark, d):
    return eda.error_histogram(_base_rows(spark, d), "base", "stars")


@query(f"WITH {BASE}, x AS (SELECT base, centred, stars - base AS y FROM base) SELECT count(*)::DOUBLE AS a00, round(sum(base), 4) AS a01, round(sum(centred), 4) AS a02, round(sum(base * base), 4) AS a11, round(sum(base * centred), 4) AS a12, round(sum(centred * centred), 4) AS a22, round(sum(y), 4) AS b0, round(sum(base * y), 4) AS b1, round(sum(centred * y), 4) AS b2 FROM x")
def ridge_gram(spark, d):
    a, b = stack.gram(_base_rows(spark, d).withColumn("y", F.col("stars") - F.col("base")), ["base", "centred"], "y")
    row = {f"a{i}{j}": round(float(a[i, j]), 4) for i in range(3) for j in range(i, 3)} | {f"b{i}": round(float(b[i]), 4) for i in range(3)}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


@query()
def gbt_predict(spark, d):
    """Boosted residuals of the first model, all rounds; each is a pass over the data."""
    train, hold = held_out(spark, d)
    return stack.boosted_residuals(train, hold, stack.FIRST, reliance="tail").select("u", "b", "prediction")


@query()
def stack_predict(spark, d):
    train, hold = held_out(spark, d)
    return stack.stacked(train, hold, stack.SECOND)


# --- graphs ----------------------------------------------------------------------


@query(f"WITH {edges_sql()} SELECT src, dst, n FROM edges")
def graph_edges(spark, d):
    return edges(spark, d)


@query(f"WITH {edges_sql()} SELECT src AS id FROM edges UNION SELECT dst FROM edges")
def graph_vertices(spark, d):
    return graph.vertices(edges(spark, d))


@query(f"WITH {edges_sql()} SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def graph_mirror(spark, d):
    return graph.mirrored(edges(spark, d))


@query(f"WITH {edges_sql()} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def graph_degree(spark, d):
    return graph.degrees(edges(spark, d))


def _cc_sql(threshold: int = EDGES) -> str:
    return f"WITH RECURSIVE {edges_sql(threshold)}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT src AS id, src AS other FROM both_ways UNION SELECT reach.id, dst FROM reach JOIN both_ways ON other = src), cc AS (SELECT id, min(other) AS community FROM reach GROUP BY id) "


@query(_cc_sql() + "SELECT id, community FROM cc")
def graph_components(spark, d):
    return graph.components(edges(spark, d))


def _lpa_sql(rounds: int) -> str:
    parts = ["l0 AS (SELECT DISTINCT src AS id, src AS label FROM both_ways)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS (SELECT id, label FROM (SELECT b.src AS id, l.label, row_number() OVER (PARTITION BY b.src ORDER BY count(*) DESC, l.label) AS rk FROM both_ways b JOIN l{i} l ON l.id = b.dst GROUP BY b.src, l.label) WHERE rk = 1)")
    return f"WITH {edges_sql()}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), {', '.join(parts)} SELECT id, label FROM l{rounds}"


@query(_lpa_sql(5))
def graph_lpa(spark, d):
    return graph.label_propagation(edges(spark, d))


def _betweenness_sql(threshold: int, levels: int) -> str:
    """Paths counted level by level from all vertices at once, then credit handed back; `levels` exceeds every distance."""
    parts = [edges_sql(threshold), "both_ways AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)", "l0 AS MATERIALIZED (SELECT DISTINCT src AS s, src AS t, 1.0::DOUBLE AS p FROM both_ways)"]
    for i in range(1, levels + 1):
        before = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{k} o WHERE o.s = x.s AND o.t = x.t)" for k in range(max(0, i - 2), i))
        parts.append(f"l{i} AS MATERIALIZED (SELECT s, t, p FROM (SELECT l.s, b.dst AS t, sum(l.p) AS p FROM l{i - 1} l JOIN both_ways b ON b.src = l.t GROUP BY 1, 2) x WHERE {before})")
    parts.append(f"c{levels} AS MATERIALIZED (SELECT s, t, p, 1.0::DOUBLE AS credit FROM l{levels})")
    for i in range(levels, 0, -1):
        parts.append(f"f{i} AS MATERIALIZED (SELECT c.s, u.t AS parent, c.t, c.credit * u.p / c.p AS flow FROM c{i} c JOIN both_ways b ON b.src = c.t JOIN l{i - 1} u ON u.s = c.s AND u.t = b.dst)")
        parts.append(f"c{i - 1} AS MATERIALIZED (SELECT l.s, l.t, l.p, 1.0 + coalesce(g.g, 0.0) AS credit FROM l{i - 1} l LEFT JOIN (SELECT s, parent, sum(flow) AS g FROM f{i} GROUP BY 1, 2) g ON g.s = l.s AND g.parent = l.t)")
    flows = " UNION ALL ".join(f"SELECT parent, t, flow FROM f{i}" for i in range(1, levels + 1))
    return f"WITH {', '.join(parts)} SELECT least(parent, t) AS src, greatest(parent, t) AS dst, round(sum(flow) / 2, 6) AS betweenness FROM ({flows}) GROUP BY 1, 2"


@query(_betweenness_sql(DENSE, 20))
def graph_betweenness(spark, d):
    return rounded(graph.edge_betweenness(edges(spark, d, DENSE)), "betweenness")


@query(
    _cc_sql() + ", m AS (SELECT count(*) AS m FROM edges), deg AS (SELECT src AS id, count(*) AS degree FROM both_ways GROUP BY 1), i AS (SELECT community, count(*) AS inner_edges FROM edges JOIN cc ON id = src GROUP BY 1), t AS (SELECT community, sum(degree) AS total FROM deg JOIN cc USING (id) GROUP BY 1) "
    "SELECT round(sum(coalesce(inner_edges, 0) / m - pow(total / (2 * m), 2)), 6) AS q FROM t LEFT JOIN i USING (community), m"
)
def graph_modularity(spark, d):
    from lodespark.session import written

    e = written(edges(spark, d), "edges")
    return rounded(graph.modularity(e, e, graph.components(e)), "q")


@query()
def graph_girvan_newman(spark, d):
    return graph.communities(graph.girvan_newman(edges(spark, d, CUT)), "community").select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "size")


# --- streams ---------------------------------------------------------------------

HORNER = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split({x}::VARCHAR, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (a * 256 + b) % 2147483647)"
STREAM = "stream AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, o_custkey AS key FROM orders)"


@query(
    f"WITH {STREAM}, first AS (SELECT key, min(seq) AS first_seen, {HORNER.format(x='key')} AS x FROM stream GROUP BY key), bits AS (SELECT key, first_seen, unnest([{', '.join(f'(({a} * x + {b}) % 2147483647) % 69997' for a, b in S.BLOOM_PARAMS)}]) AS bit FROM first), "
    "fs AS (SELECT bit, min(first_seen) AS first_set FROM bits GROUP BY bit), ready AS (SELECT key, max(first_set) AS ready, any_value(first_seen) AS first_seen FROM bits JOIN fs USING (bit) GROUP BY key), "
    "j AS (SELECT (seq - 1) // 100 AS batch, sum(CASE WHEN seq = first_seen AND ready < seq THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN seq = first_seen AND NOT ready < seq THEN 1 ELSE 0 END)::BIGINT AS tn FROM stream JOIN ready USING (key) GROUP BY 1) "
    "SELECT batch, fp, tn, CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) END AS fpr FROM j"
)
def stream_bloom(spark, d):
    stream = sketches.numbered(table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_custkey"), ["o_orderdate", "o_orderkey"], 100)
    return sketches.bloom_fpr(stream, "o_custkey")


FM = (
    "WITH s AS (SELECT DISTINCT {tick} AS batch, user_id AS key FROM events), x AS (SELECT batch, {h} AS x FROM s), h AS (SELECT batch, unnest(range(100)) AS h, x FROM x), "
    "z AS (SELECT batch, h, CASE WHEN ((2 * h + 1) * x + 2 * h + 3) % 2147483647 = 0 THEN 32 ELSE bit_count(xor(((2 * h + 1) * x + 2 * h + 3) % 2147483647, ((2 * h + 1) * x + 2 * h + 3) % 2147483647 - 1)::BIGINT) - 1 END AS z FROM h), "
    "r AS (SELECT batch, h, pow(2, max(z)) AS r FROM z GROUP BY 1, 2), g AS (SELECT batch, h // 10 AS g, avg(r) AS m FROM r GROUP BY 1, 2), e AS (SELECT batch, round_even(median(m), 0)::BIGINT AS estimate FROM g GROUP BY 1) "
)
_HASH = HORNER.format(x="key") + "::BIGINT"


@query(FM.format(tick="(row_number() OVER (ORDER BY event_id) - 1) // 300", h=_HASH) + "SELECT batch, count(*) AS truth, any_value(estimate) AS estimate FROM s JOIN e USING (batch) GROUP BY batch")
def stream_fm(spark, d):
    return sketches.flajolet_martin(sketches.numbered(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], 300), "user_id")


UNIFORM = "('0x' || substr(md5('{salt}:' || seq), 1, 8))::BIGINT / 4294967296.0"


@query(
    f"WITH s AS (SELECT row_number() OVER (ORDER BY event_id) AS seq, user_id AS key FROM events), a AS (SELECT seq, (seq - 1) // 100 AS batch, key, (CASE WHEN seq <= 100 THEN seq - 1 ELSE floor({UNIFORM.format(salt='slot')} * 100) END)::BIGINT AS slot FROM s WHERE seq <= 100 OR {UNIFORM.format(salt='keep')} < 100 / seq), "
    "e AS (SELECT (seq - 1) // 100 AS batch, max(seq) AS seqnum FROM s GROUP BY 1) SELECT seqnum, slot, max_by(key, seq) AS key FROM e, (SELECT unnest([0, 20, 40, 60, 80])::BIGINT AS slot) w JOIN a USING (slot) WHERE a.seq <= seqnum GROUP BY 1, 2"
)
def stream_reservoir(spark, d):
    return sketches.reservoir(sketches.numbered(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], 100), "user_id")


@query(FM.format(tick="event_id // 300", h=_HASH) + "SELECT batch AS tick, estimate FROM e")
def stream_live_fm(spark, d):
    return live.live_flajolet_martin(live.event_stream(spark, d), F.floor(F.col("event_id") / 300), "user_id")


LIVE_BLOOM = (
    f"WITH stream AS (SELECT event_id AS seq, user_id AS key FROM events), first AS (SELECT key, min(seq) AS first_seen, {HORNER.format(x='key')} AS x FROM stream GROUP BY key), "
    f"bits AS (SELECT key, first_seen, unnest([{', '.join(f'(({a} * x + {b}) % 2147483647) % 69997' for a, b in S.BLOOM_PARAMS)}]) AS bit FROM first), fs AS (SELECT bit, min(first_seen) AS first_set FROM bits GROUP BY bit), "
    "ready AS (SELECT key, max(first_set) AS ready, any_value(first_seen) AS first_seen FROM bits JOIN fs USING (bit) GROUP BY key) "
    "SELECT seq // 100 AS tick, sum(CASE WHEN seq = first_seen AND ready < seq THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN seq = first_seen AND NOT ready < seq THEN 1 ELSE 0 END)::BIGINT AS tn FROM stream JOIN ready USING (key) GROUP BY 1"
)


@query(LIVE_BLOOM)
def stream_live_bloom(spark, d):
    return live.live_bloom(live.event_stream(spark, d), F.floor(F.col("event_id") / 100), "event_id", "user_id").drop("shard")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_live_windows(spark, d):
    return live.live_windows(live.event_stream(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_exact_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


# --- clustering ------------------------------------------------------------------

DIMS = "long AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), sums AS (SELECT label, dim, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM long GROUP BY 1, 2), cl AS (SELECT label, dim, n, s, q, s / n AS mean, sqrt(greatest(0, q / n - (s / n) * (s / n))) AS sd FROM sums)"


def _points(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("x"))


@query(f"WITH {DIMS} SELECT label, dim::INT AS dim, n, round(s, 5) AS \"sum\", round(q, 5) AS sumsq, round(mean, 5) AS mean, round(sd, 5) AS sd FROM cl")
def bfr_summary(spark, d):
    return rounded(bfr.summaries(_points(spark, d), "label"), "sum", "sumsq", "mean", "sd", digits=5)


@query(f"WITH {DIMS}, dist AS (SELECT vec_id, cl.label, sqrt(sum(pow((v - mean) / sd, 2))) AS distance FROM long JOIN cl ON cl.dim = long.dim GROUP BY 1, 2) SELECT vec_id, arg_min(label, distance) AS label, round(min(distance), 4) AS distance FROM dist GROUP BY 1")
def bfr_mahalanobis(spark, d):
    rows = _points(spark, d)
    return rounded(bfr.nearest(rows, F.broadcast(bfr.summaries(rows, "label")), "vec_id", "label"), "distance", digits=4)


@query()
def bfr_cluster(spark, d):
    return bfr.cluster(table(spark, d, "embeddings"), "vec_id", "embedding", 10)[0]


from lodespark.plans import entities, reports  # noqa: E402, F401  register their queries here
