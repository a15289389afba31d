"""Exploratory aggregates: counts, distincts, top-k, averages by group, partition statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions.scalars import crc_partition


def counts(df: DataFrame, user: str, chosen: Column) -> DataFrame:
    """Rows, rows of the chosen kind, distinct users; a null user counts as one more."""
    distinct = F.countDistinct(user) + F.coalesce(F.max(F.col(user).isNull().cast("int")), F.lit(0))
    return df.agg(F.count("*").alias("n"), F.count_if(chosen).alias("n_chosen"), distinct.alias("n_users"))


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys, ties by the key, nulls last."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(k)


def average_by_group(facts: DataFrame, dims: DataFrame, on: str, value: str, group: str) -> DataFrame:
    """Mean of `value` by the dimension's group, best first; null keys meet, a null group is the empty one, a null value 0."""
    right = dims.select(F.col(on).alias("_on"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias(group))
    joined = facts.select(on, F.coalesce(F.col(value), F.lit(0.0)).alias("_v")).join(right, F.col(on).eqNullSafe(F.col("_on")))
    return joined.groupBy(group).agg(F.avg("_v").alias("mean")).orderBy(F.desc("mean"), group)


def partition_stats(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows in each of n partitions by crc32 of the key, empty ones with 0."""
    got = df.groupBy(crc_partition(key, n).alias("part")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).join(got, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))


def dealt_by_crc(df: DataFrame, key: str, n: int) -> DataFrame:
    """df physically dealt into n partitions by crc32 of the key."""
    return df.repartitionById(n, crc_partition(key, n))


def physical_partition_stats(df: DataFrame) -> DataFrame:
    """Rows in each physical partition, empty ones with 0."""
    n = df.rdd.getNumPartitions()
    got = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).join(got, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))


def rmse(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(actual), F.lit(2.0)))).alias("rmse"))


def error_histogram(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Pairs by absolute error: [0,1), [1,2), [2,3), [3,4), 4 and more."""
    bin_ = F.least(F.floor(F.abs(F.col(predicted) - F.col(actual))), F.lit(4)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def top_collected(counts: DataFrame, key: str, n: str, k: int) -> list[tuple]:
    """The k largest counts, ties by key, chosen on the driver among each task's own k: at most k rows a task get there."""
    import heapq

    import pyarrow as pa

    def own(batches):
        best: list[tuple] = []
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            best = heapq.nsmallest(k, [*best, *rows], key=lambda r: (-r[1], r[0]))
        columns = list(zip(*best, strict=True)) if best else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], ["key", "n"])

    each = counts.select(F.col(key).cast("string").alias("key"), F.col(n).cast("bigint").alias("n")).mapInArrow(own, "key string, n bigint").collect()
    return heapq.nsmallest(k, [(r.key, r.n) for r in each], key=lambda r: (-r[1], r[0]))
