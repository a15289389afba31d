"""Stream sketches over ordered batches: Bloom filter, Flajolet-Martin, reservoir; set-based and exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions.scalars import bloom_bits, fm_hashes, half_even, trailing_zeros
from lodespark.session import written


def numbered(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds seq (from 1) in the given order and batch (from 0).

    Rows are numbered within ranges of the order and the ranges' sizes added up, so no task holds them all. The
    ranges are written once, so that both steps see the same ones.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = within.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b._p") < F.col("a._p"), "left").groupBy(F.col("a._p").alias("_p")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return within.join(F.broadcast(before), "_p").withColumn("seq", F.col("_rn") + F.col("_before")).withColumn("batch", F.floor((F.col("seq") - 1) / size)).drop("_p", "_rn", "_before")


def bloom_fpr(stream: DataFrame, key: str) -> DataFrame:
    """(batch, fp, tn, fpr) of a filter that lives through all batches; fpr is null without new keys.

    A bit is set from its first key on, so a key is in the filter when all its
    bits were first set before it, and seen when its own first place is before it.
    """
    rows = stream.select("seq", "batch", F.col(key).cast("string").alias("key"))
    keys = rows.groupBy("key").agg(F.min("seq").alias("first_seen"))
    bits = keys.select("key", "first_seen", F.explode(F.array_distinct(bloom_bits("key"))).alias("bit"))
    first_set = bits.groupBy("bit").agg(F.min("first_seen").alias("first_set"))
    ready = bits.join(first_set, "bit").groupBy("key").agg(F.max("first_set").alias("ready"), F.first("first_seen").alias("first_seen"))
    judged = rows.join(ready, "key").where("first_seen = seq").select("batch", (F.col("ready") < F.col("seq")).cast("long").alias("fp"))
    counts = judged.groupBy("batch").agg(F.sum("fp").alias("fp"), F.sum(1 - F.col("fp")).alias("tn"))
    return rows.select("batch").distinct().join(counts, "batch", "left").select("batch", F.coalesce("fp", F.lit(0)).alias("fp"), F.coalesce("tn", F.lit(0)).alias("tn"), F.try_divide("fp", F.col("fp") + F.col("tn")).alias("fpr"))


def flajolet_martin(stream: DataFrame, key: str, hashes: int = 100, group: int = 10) -> DataFrame:
    """(batch, truth, estimate): the median of the groups' mean 2**R, rounded half to even."""
    keys = stream.select("batch", F.col(key).cast("string").alias("key")).distinct()
    zeros = keys.select("batch", F.posexplode(F.transform(fm_hashes("key", hashes), trailing_zeros)).alias("h", "zeros"))
    most = zeros.groupBy("batch", "h").agg(F.pow(F.lit(2.0), F.max("zeros")).alias("r"))
    means = most.groupBy("batch", F.floor(F.col("h") / group).alias("g")).agg(F.avg("r").alias("mean"))
    estimate = means.groupBy("batch").agg(half_even(F.expr("percentile(mean, 0.5)")).alias("estimate"))
    return keys.groupBy("batch").agg(F.count("*").alias("truth")).join(estimate, "batch")


def uniform(seq: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), seq.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def accepted(stream: DataFrame, key: str, size: int) -> DataFrame:
    """(seq, batch, key, slot): rows that enter the reservoir and where; the n-th with probability size / n."""
    seq = F.col("seq")
    slot = F.when(seq <= size, seq - 1).otherwise(F.floor(uniform(seq, "slot:") * size))
    return stream.where((seq <= size) | (uniform(seq, "keep:") < size / seq)).select("seq", "batch", F.col(key).alias("key"), slot.alias("slot"))


def reservoir(stream: DataFrame, key: str, size: int = 100, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """(seqnum, slot, key): the chosen slots after every batch; null while a slot is empty."""
    taken = accepted(stream, key, size).where(F.col("slot").isin(*slots)).groupBy("slot", "batch").agg(F.max_by("key", "seq").alias("key"))
    ends = stream.groupBy("batch").agg(F.max("seq").alias("seqnum"))
    grid = ends.select("batch", "seqnum", F.explode(F.array(*[F.lit(s).cast("bigint") for s in slots])).alias("slot")).join(taken, ["batch", "slot"], "left")
    last = F.last("key", ignorenulls=True).over(Window.partitionBy("slot").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    return grid.select("seqnum", "slot", last.alias("key"))
