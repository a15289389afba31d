"""Sources and sinks as queries: the driver's tables are written to the shared folder as the text files that users have, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators import cf, eda, graph, itemsets, lsh, sketches
from lodespark.plans import catalogue as C
from lodespark.plans.catalogue import query
from lodespark.plans.entities import standin, with_standins
from lodespark.session import scratch_path
from lodespark.sources import readers, writers
from lodespark.sources.readers import table


def _lines(spark: SparkSession, lines: DataFrame, header: str | None = None) -> str:
    """Text files with these lines; the header stands before and, once more, after them, in the first and the last file.

    Every partition is a file. Drawn into one, all partitions would be sorted and joined in one task, and those that
    Spark places near their shuffle files would come before the header.
    """
    path = scratch_path(spark, "text")
    if header is not None:
        head = spark.createDataFrame([(header,)], "value string").coalesce(1)
        lines = head.unionByName(lines).unionByName(head)
    lines.write.text(path)
    return path


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a report in order, from 0; a report is one file."""
    whole = spark.read.text(f"{path}/part-*", wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n")).alias("line", "value"))


def _ordered_sql(sql: str, order: str, header: str | None = None) -> str:
    body = f"SELECT row_number() OVER (ORDER BY {order}) - {0 if header else 1} AS line, value FROM ({sql})"
    return (f"SELECT 0 AS line, '{header}' AS value UNION ALL " if header else "") + body


# --- sources ---------------------------------------------------------------------


@query(f"WITH {with_standins('reviews')} SELECT user_id, business_id, text FROM reviews")
def src_json_lines(spark, d):
    """JSON lines with a declared schema; absent keys are null."""
    path = _lines(spark, standin(spark, d, "reviews").select(F.to_json(F.struct("*")).alias("value")))
    return readers.json_lines(spark, path, readers.REVIEW).select("user_id", "business_id", "text")


@query("SELECT NULL::VARCHAR AS business_id, NULL::DOUBLE AS stars WHERE false")
def src_json_absent(spark, d):
    """An absent file is an empty table with the declared columns."""
    return readers.json_lines(spark, scratch_path(spark, "absent"), readers.BUSINESS).select("business_id", "stars")


PAIR_LINES = "SELECT o_custkey::VARCHAR AS user_id, l_suppkey::VARCHAR AS business_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _pair_lines(spark, d, stars: bool = False) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    last = [F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(F.ceil(F.col("l_quantity") / 10).cast("string"))] if stars else []
    return both.select(F.concat_ws(",", F.col("o_custkey").cast("string"), F.concat(F.lit(" "), F.col("l_suppkey").cast("string")), *last).alias("value"))


@query(f"SELECT user_id, business_id, count(*) AS n FROM ({PAIR_LINES}) GROUP BY 1, 2")
def src_csv_header(spark, d):
    """Two columns of a CSV; the first line and all lines equal to it go."""
    path = _lines(spark, _pair_lines(spark, d), "user_id,business_id")
    return readers.csv_columns(spark, path, ["user_id", "business_id"]).groupBy("user_id", "business_id").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM ({PAIR_LINES})")
def src_csv_detect(spark, d):
    """Whether there is a header is read off the first line: here with and without one."""
    none = _lines(spark, _pair_lines(spark, d))
    some = _lines(spark, _pair_lines(spark, d), "user_id,business_id")
    read = [readers.csv_columns(spark, p, ["user_id", "business_id"], None) for p in (none, some)]
    counts = [r.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")) for r in read]
    return counts[0].intersect(counts[1])


@query(f"SELECT DISTINCT user_id, business_id FROM ({PAIR_LINES})")
def src_distinct_pairs(spark, d):
    return readers.distinct_pairs(spark, _lines(spark, _pair_lines(spark, d), "user_id,business_id"))


RATED = "SELECT o_custkey::VARCHAR AS user_id, l_suppkey::VARCHAR AS business_id, ceil(l_quantity / 10)::DOUBLE AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber != 7"


@query(f"SELECT user_id, business_id, sum(stars) AS stars, count(*) AS n FROM ({RATED}) GROUP BY 1, 2")
def src_ratings(spark, d):
    """Labelled ratings (the training and the validation file); lines whose stars don't parse go."""
    path = _lines(spark, _pair_lines(spark, d, True), "user_id,business_id,stars")
    return readers.ratings(spark, path).groupBy("user_id", "business_id").agg(F.sum("stars").alias("stars"), F.count("*").alias("n"))


@query(f"SELECT user_id, count(*) AS n FROM ({PAIR_LINES}) GROUP BY 1")
def src_pairs_unlabelled(spark, d):
    """The test file: pairs without a label, from a file that may hold more columns."""
    path = _lines(spark, _pair_lines(spark, d, True), "user_id,business_id,stars")
    return readers.ratings(spark, path, labelled=False).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%d/%m/%Y') || '-' || o_custkey AS basket, l_partkey::VARCHAR AS item, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def src_transactions(spark, d):
    """The nine-column sales file: date-customer baskets, leading zeros of items go."""
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cells = [F.date_format("o_orderdate", "dd/MM/yyyy"), F.col("o_custkey").cast("string"), F.lit("x"), F.lit("y"), F.lit("z"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lit("1"), F.lit("2"), F.lit("3")]
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in cells]
    names = ",".join(f'"{n}"' for n in ("TRANSACTION_DT", "CUSTOMER_ID", "AGE_GROUP", "PIN_CODE", "PRODUCT_SUBCLASS", "PRODUCT_ID", "AMOUNT", "ASSET", "SALES_PRICE"))
    path = _lines(spark, both.select(F.concat_ws(",", *quoted).alias("value")), names)
    return readers.transactions(spark, path).groupBy("basket", "item").agg(F.count("*").alias("n"))


@query("SELECT vec_id::INT AS point, len(embedding)::INT AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def src_points(spark, d):
    """Point lines: id, a label that is ignored, numbers; blank and short lines go."""
    lines = table(spark, d, "embeddings").select(F.concat_ws(",", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), ",")).alias("value"))
    path = _lines(spark, lines.unionByName(spark.createDataFrame([("",), ("7",), (" ",)], "value string")))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return readers.points(spark, path).select("point", F.size("x").alias("dims"), F.round(total, 4).alias("total"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def src_csv_dataframe(spark, d):
    """A CSV with a header under a declared schema."""
    path = scratch_path(spark, "csv")
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    table(spark, d, "customer").select(*columns).write.option("header", True).csv(path)
    return readers.csv_table(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


@query("SELECT * FROM (VALUES ('/a/b c.csv', 'file:///a/b%20c.csv'), ('file:///a/b', 'file:///a/b'), ('hdfs://n:1/x', 'hdfs://n:1/x'), ('s3a://k/x', 's3a://k/x')) v(path, uri)")
def src_path(spark, d):
    """Absolute paths become file URIs; URIs stay."""
    paths = ["/a/b c.csv", "file:///a/b", "hdfs://n:1/x", "s3a://k/x"]
    return spark.createDataFrame([(p, readers.as_uri(p)) for p in paths], "path string, uri string")


# --- sinks -----------------------------------------------------------------------


@query("SELECT 0 AS line, '{\"n\":' || count(*) || ',\"n_users\":' || count(DISTINCT o_custkey) || '}' AS value FROM orders")
def sink_json(spark, d):
    """A result as one JSON document."""
    path = scratch_path(spark, "report")
    counts = eda.counts(table(spark, d, "orders"), "o_custkey", F.lit(True)).select("n", "n_users")
    writers.json_document(counts, path)
    return _numbered(spark, path)


@query(_ordered_sql("SELECT c_mktsegment || ',' || round(avg(o_totalprice), 2)::DOUBLE AS value, c_mktsegment AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", "k", "city,stars"))
def sink_averages(spark, d):
    """A sorted two-column CSV with a header."""
    path = scratch_path(spark, "report")
    rows = C._averages(spark, d).select(F.col("c_mktsegment").alias("city"), F.round("mean", 2).alias("stars"))
    writers.csv(rows, path, ["city"])
    return _numbered(spark, path)


SETS = f"WITH {C.BASKETS}, l AS (SELECT i, count(*) AS n FROM baskets GROUP BY 1)"


@query(f"{SETS}, t AS (SELECT ceil(0.0237 * count(DISTINCT k)) AS t FROM baskets), b AS (SELECT string_agg('(''' || i || ''')', ',' ORDER BY i) AS all_sets, string_agg('(''' || i || ''')', ',' ORDER BY i) FILTER (WHERE n >= t) AS kept FROM l, t) SELECT line, value FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS line, unnest(['Candidates:', all_sets, '', 'Frequent Itemsets:', kept, '']) AS value FROM b)")
def sink_itemsets(spark, d):
    """The report of candidate and frequent sets, here of single items."""
    pairs = C.brand_pairs(spark, d)
    path = scratch_path(spark, "report")
    singles = pairs.groupBy("i").agg(F.count("*").alias("n"))
    least = pairs.select("k").distinct().agg(F.ceil(F.lit(C.SHARE) * F.count("*")).alias("t"))
    sets = singles.crossJoin(F.broadcast(least)).select(F.array("i").alias("items"), "n", "t")
    writers.itemset_report(sets.select("items"), sets.where("n >= t").select("items"), path)
    return _numbered(spark, path)


JACCARD = f"WITH {C.TOKENS}, s AS (SELECT d, count(*) AS n FROM tokens GROUP BY d), p AS (SELECT a.d AS x, b.d AS y, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.d < b.d GROUP BY 1, 2) SELECT x || ',' || y || ',' || printf('%.6f', c / (s1.n + s2.n - c)) AS value, x, y FROM p JOIN s s1 ON s1.d = x JOIN s s2 ON s2.d = y WHERE c / (s1.n + s2.n - c) >= 0.5"


@query(_ordered_sql(JACCARD, "x, y", "business_id_1,business_id_2,similarity"))
def sink_similarities(spark, d):
    """Similar pairs in order; the pairs themselves come from the exact join."""
    path = scratch_path(spark, "report")
    writers.similarity_report(lsh.exact_join(C.tokens(spark, d), "d", "t"), path)
    return _numbered(spark, path)


@query(_ordered_sql(f"WITH {C.TRAIN}, {C.MEANS.format(r='train', beta='12.0')} SELECT hold.u || ',' || hold.b || ',' || printf('%.6f', {C.LADDER}) AS value, hold.u, hold.b FROM hold LEFT JOIN um USING (u) LEFT JOIN bm ON bm.b = hold.b, mu", "u, b", "user_id,business_id,prediction"))
def sink_predictions(spark, d):
    train, hold = C.held_out(spark, d)
    path = scratch_path(spark, "report")
    writers.prediction_report(cf.imputed(hold.select("u", "b"), train), path)
    return _numbered(spark, path)


@query()
def sink_betweenness(spark, d):
    """Edges by betweenness; the SQL of shortest paths is too slow on the whole graph, so a unit test holds it against brute force."""
    path = scratch_path(spark, "report")
    writers.text(writers.betweenness_lines(graph.edge_betweenness(C.edges(spark, d, C.DENSE))), path)
    return _numbered(spark, path)


@query(_ordered_sql(f"WITH {C.edges_sql(C.DENSE)}, l AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), g AS (SELECT id % 10 AS g, list_sort(list(id)) AS m FROM l GROUP BY 1) SELECT array_to_string(list_transform(m, lambda x: '''' || x || ''''), ', ') AS value, len(m) AS n, m FROM g", "n, m"))
def sink_communities(spark, d):
    """Communities by size and members, here the vertices by their last digit."""
    path = scratch_path(spark, "report")
    vertices = graph.vertices(C.edges(spark, d, C.DENSE))
    writers.text(writers.community_lines(graph.communities(vertices.withColumn("label", F.col("id") % 10))), path)
    return _numbered(spark, path)


@query("SELECT 0 AS line, 'Round 1: 5,2,3,1' AS value UNION ALL SELECT 1, 'Round 2: 9,1,4,0' UNION ALL SELECT 1 + row_number() OVER (ORDER BY vec_id), vec_id || ',' || (vec_id % 7 - 1) FROM embeddings")
def sink_clusters(spark, d):
    """The rounds, then every point's cluster by id."""
    path = scratch_path(spark, "report")
    rounds = spark.createDataFrame([(1, 5, 2, 3, 1), (2, 9, 1, 4, 0)], "round int, n_ds int, n_cs int, in_cs int, n_rs int")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("point"), (F.col("vec_id") % 7 - 1).alias("cluster"))
    writers.text(writers.cluster_lines(rounds, labels), path)
    return _numbered(spark, path)


def _wrap(sql: str, value: str, order: str, header: str) -> str:
    return _ordered_sql(f"SELECT {value} AS value, * FROM ({sql})", order, header)


@query(_wrap(C.ORACLES["stream_bloom"], "batch || ',' || coalesce(printf('%.6f', fpr), '')", "batch", "Time,FPR"))
def sink_stream_bloom(spark, d):
    """Time and false-positive rate of every batch."""
    path = scratch_path(spark, "report")
    writers.bloom_report(C.stream_bloom(spark, d), path)
    return _numbered(spark, path)


@query(_wrap(C.ORACLES["stream_fm"], "batch || ',' || truth || ',' || estimate", "batch", "Time,Ground Truth,Estimation"))
def sink_stream_fm(spark, d):
    path = scratch_path(spark, "report")
    writers.distinct_report(C.stream_fm(spark, d), path)
    return _numbered(spark, path)


@query(_ordered_sql("SELECT seqnum || ',' || string_agg(key::VARCHAR, ',' ORDER BY slot) AS value, seqnum FROM (" + C.ORACLES["stream_reservoir"] + ") GROUP BY seqnum", "seqnum", "seqnum,0_id,20_id,40_id,60_id,80_id"))
def sink_stream_reservoir(spark, d):
    """One wide row of sampled ids after every batch."""
    path = scratch_path(spark, "report")
    writers.reservoir_report(C.stream_reservoir(spark, d), path)
    return _numbered(spark, path)


@query(
    f"WITH {C.BASE}, e AS (SELECT base - stars AS e FROM base) SELECT 0 AS line, 'RMSE: ' || printf('%.6f', sqrt(avg(e * e))) AS value FROM e UNION ALL "
    "SELECT 1 + k, CASE k WHEN 4 THEN '>=4' ELSE '>=' || k || ' and <' || (k + 1) END || ': ' || (SELECT count(*) FROM e WHERE least(floor(abs(e)), 4) = k) FROM (SELECT unnest(range(5)) AS k)"
)
def sink_metrics(spark, d):
    """RMSE and the error bins as lines."""
    path = scratch_path(spark, "report")
    writers.text(writers.metric_lines(C._base_rows(spark, d), "base", "stars"), path)
    return _numbered(spark, path)


@query("SELECT c_name, n FROM (SELECT o_custkey::VARCHAR AS c_name, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, c_name LIMIT 10")
def eda_top10_collected(spark, d):
    """The ten most frequent keys, each task handing over its own ten; the last choice is the driver's."""
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("c_name")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(eda.top_collected(counts, "c_name", "n", 10), "c_name string, n bigint")


@query(f"WITH {C.BASKETS}, t AS (SELECT ceil(0.0237 * count(DISTINCT k))::INT AS t FROM baskets), l AS (SELECT i FROM baskets GROUP BY 1 HAVING count(*) >= (SELECT t FROM t)) SELECT a.i AS x, b.i AS y FROM l a JOIN l b ON a.i < b.i")
def itemsets_prefix_join(spark, d):
    """Candidates of size 2 by the prefix self-join of the frequent items."""
    pairs = C.brand_pairs(spark, d)
    least = pairs.select("k").distinct().agg(F.ceil(F.lit(C.SHARE) * F.count("*")).alias("t"))
    frequent = pairs.groupBy("i").agg(F.count("*").alias("n")).crossJoin(F.broadcast(least)).where("n >= t").select(F.array("i").alias("items"))
    return itemsets.candidates(frequent, 2).select(F.col("items")[0].alias("x"), F.col("items")[1].alias("y"))


@query("WITH s AS (SELECT row_number() OVER (ORDER BY event_id) AS seq, user_id FROM events) SELECT (seq - 1) // 250 AS batch, count(*) AS n, min(seq) AS first, max(seq) AS last FROM s GROUP BY 1")
def stream_batches(spark, d):
    """The batch driver: running positions cut into batches of a size."""
    numbered = sketches.numbered(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], 250)
    return numbered.groupBy("batch").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
