"""Sinks: sorted CSV and text reports; each is one ordered text dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, order: list | None = None) -> None:
    out = df.orderBy(*order) if order else df
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json_document(df: DataFrame, path: str) -> None:
    """Every row as one JSON object."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def quoted(items: str) -> Column:
    """('a', 'b'); a single item has no trailing comma."""
    return F.concat(F.lit("("), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", "), F.lit(")"))


def itemset_lines(sets: DataFrame) -> DataFrame:
    """(size, value): all sets of a size on one line, in order."""
    return sets.groupBy(F.size("items").alias("size")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("items")), quoted), ",").alias("value"))


def itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    lines = None
    for k, (title, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", frequent))):
        head = sets.sparkSession.createDataFrame([(k, 0, title)], "part int, size int, value string")
        block = head.unionByName(itemset_lines(sets).select(F.lit(k).alias("part"), "size", F.concat("value", F.lit("\n")).alias("value")))
        lines = block if lines is None else lines.unionByName(block)
    lines.orderBy("part", "size").coalesce(1).select("value").write.mode("overwrite").text(path)


def betweenness_lines(betweenness: DataFrame) -> DataFrame:
    line = F.format_string("('%s', '%s'), %.5f", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("betweenness"))
    return betweenness.orderBy(F.desc("betweenness"), "src", "dst").select(line.alias("value"))


def community_lines(communities: DataFrame) -> DataFrame:
    line = F.array_join(F.transform("members", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")
    return communities.orderBy("size", "members").select(line.alias("value"))


def cluster_lines(rounds: DataFrame, labels: DataFrame) -> DataFrame:
    stats = rounds.select(F.lit(0).alias("part"), F.col("round").cast("bigint").alias("at"), F.format_string("Round %d: %d,%d,%d,%d", "round", "n_ds", "n_cs", "in_cs", "n_rs").alias("value"))
    marks = labels.select(F.lit(1).alias("part"), F.col("point").cast("bigint").alias("at"), F.format_string("%d,%d", F.col("point").cast("bigint"), F.col("cluster").cast("bigint")).alias("value"))
    return stats.unionByName(marks).orderBy("part", "at").select("value")


def text(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("overwrite").text(path)


def similarity_report(pairs: DataFrame, path: str) -> None:
    """Sorted pairs id1, id2, similarity."""
    rows = pairs.select(F.col("id1").alias("business_id_1"), F.col("id2").alias("business_id_2"), F.format_string("%.6f", F.col("similarity").cast("double")).alias("similarity"), "id1", "id2")
    csv(rows.orderBy("id1", "id2").drop("id1", "id2"), path)


def prediction_report(predictions: DataFrame, path: str) -> None:
    """Predictions of pairs u, b in order."""
    rows = predictions.select(F.col("u").alias("user_id"), F.col("b").alias("business_id"), F.format_string("%.6f", F.col("prediction")).alias("prediction"))
    csv(rows, path, ["user_id", "business_id"])


def bloom_report(rates: DataFrame, path: str) -> None:
    csv(rates.select(F.col("batch").alias("Time"), F.when(F.col("fpr").isNotNull(), F.format_string("%.6f", F.col("fpr"))).alias("FPR")), path, ["Time"])


def distinct_report(estimates: DataFrame, path: str) -> None:
    csv(estimates.select(F.col("batch").alias("Time"), F.col("truth").alias("Ground Truth"), F.col("estimate").alias("Estimation")), path, ["Time"])


def reservoir_report(samples: DataFrame, path: str, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> None:
    wide = samples.groupBy("seqnum").pivot("slot", list(slots)).agg(F.first("key"))
    csv(wide.select("seqnum", *[F.col(str(k)).alias(f"{k}_id") for k in slots]), path, ["seqnum"])


def metric_lines(rows: DataFrame, guess: str, truth: str) -> DataFrame:
    """The RMSE, then the number of absolute errors in [0,1) to [3,4) and from 4."""
    error = F.abs(F.col(guess) - F.col(truth))
    bins = [F.count_if(F.least(F.floor(error), F.lit(4)) == k).alias(f"b{k}") for k in range(5)]
    sums = rows.agg(F.sqrt(F.avg(error * error)).alias("rmse"), *bins)
    names = [f">={k} and <{k + 1}" for k in range(4)] + [">=4"]
    values = [F.format_string("RMSE: %.6f", F.col("rmse"))] + [F.format_string(n + ": %d", F.col(f"b{k}")) for k, n in enumerate(names)]
    return sums.select(F.explode(F.array(*values)).alias("value"))
