"""Frequent itemsets: baskets, A-Priori by levels, SON's first pass on declared partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import written


def baskets(pairs: DataFrame, key: str, item: str, longer_than: int = 0) -> DataFrame:
    """(key, items): distinct items in order; only baskets longer than the bound."""
    return pairs.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items")).where(F.size("items") > longer_than)


def local_support(support: int, part: int, total: int) -> int:
    """The support that a set needs in a part of the baskets."""
    return max(1, math.ceil(support * part / total)) if total else 1


def candidates(level: DataFrame, k: int) -> DataFrame:
    """Sets of k whose every subset of k-1 is in `level` (items: sorted array)."""
    head = level.select(F.slice("items", 1, k - 2).alias("prefix"), F.element_at("items", -1).alias("last"))
    joined = head.join(head.select(F.col("prefix").alias("p2"), F.col("last").alias("last2")), (F.col("prefix") == F.col("p2")) & (F.col("last") < F.col("last2")))
    grown = joined.select(F.concat("prefix", F.array("last", "last2")).alias("items"))
    if k == 2:
        return grown
    parts = grown.select("items", F.explode(F.transform("items", lambda x: F.array_remove(F.col("items"), x))).alias("subset"))
    held = parts.join(level.select(F.col("items").alias("subset")), "subset", "left_semi")
    return held.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") == k).select("items")


def _counted(long: DataFrame, previous: DataFrame, wanted: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """Frequent sets among the candidates, and the baskets' matches: each match of k-1 items grows by one later item."""
    later = long.select(F.col("key").alias("k2"), F.col("item").alias("next"))
    grown = previous.join(later, (F.col("key") == F.col("k2")) & (F.element_at("items", -1) < F.col("next"))).select("key", F.concat("items", F.array("next")).alias("items"))
    matches = grown.join(wanted, "items", "left_semi")
    frequent = matches.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    return written(frequent, "level"), matches


def frequent_itemsets(pairs: DataFrame, key: str, item: str, support: float, max_size: int | None = None) -> DataFrame:
    """(items, size, n): every set that `support` baskets or more hold."""
    long = pairs.select(F.col(key).alias("key"), F.col(item).alias("item")).where("key IS NOT NULL AND item IS NOT NULL").distinct()
    ones = written(long.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).select(F.array("item").alias("items"), "n"), "level")
    long = written(long.join(ones.select(F.element_at("items", 1).alias("item")), "item", "left_semi"), "baskets")
    found, level, matches, k = ones, ones, long.select("key", F.array("item").alias("items")), 2
    while not level.isEmpty() and (max_size is None or k <= max_size):
        level, matches = _counted(long, matches.join(level, "items", "left_semi"), candidates(level.select("items"), k), support)
        found, k = found.unionByName(level), k + 1
        if max_size is None or k <= max_size:
            matches = written(matches, "matches")
    return found.select("items", F.size("items").alias("size"), "n")


def fp_growth(pairs: DataFrame, key: str, item: str, support: int) -> DataFrame:
    """The same sets by Spark's FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    held = baskets(pairs, key, item)
    total = held.count()
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / max(total, 1))).fit(held)
    return model.freqItemsets.select(F.sort_array("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("n"))


def son_candidates(pairs: DataFrame, key: str, item: str, part: str, support: float, size: int) -> DataFrame:
    """SON's first pass: sets of a size that are frequent in some declared partition by its own share of the support.

    Sizes 1 and 2 come as columns item (and item2), larger ones as items, in order.
    """
    sorted_items = F.sort_array(F.collect_set("item"))
    long = pairs.select(F.col(part).alias("part"), F.col(key).alias("key"), F.col(item).alias("item"))
    held = written(long.groupBy("part", "key").agg(sorted_items.alias("rest"), F.max(F.col("item").isNull()).alias("none")), "baskets")
    sizes = held.groupBy("part").agg(F.count("*").alias("p"))
    total = sizes.agg(F.sum("p").alias("d"))
    need = F.broadcast(sizes.join(F.broadcast(total)).select("part", F.greatest(F.lit(1), F.ceil(F.lit(float(support)) * F.col("p") / F.col("d"))).alias("need")))
    enough = lambda matches: written(matches.groupBy("part", "items").agg(F.count("*").alias("n")).join(need, "part").where("n >= need").select("part", "items"), "level")
    single = F.when(F.col("none"), F.concat("rest", F.array(F.get("rest", F.size("rest"))))).otherwise(F.col("rest"))
    level = enough(held.select("part", F.explode(single).alias("item")).select("part", F.array("item").alias("items")))
    alone = level.select("part", F.element_at("items", 1).alias("next"))
    matches = held.select("part", F.array().cast(level.schema["items"].dataType).alias("items"), "rest")
    for k in range(1, size + 1):
        # baskets stay rows of their own: a match carries the items after it, and what it may grow into is looked up
        if k > 1:
            matches = matches.join(level, ["part", "items"], "left_semi")
        grown = matches.select("part", "items", "rest", F.posexplode("rest").alias("at", "next")).join(alone, ["part", "next"], "left_semi")
        matches = grown.select("part", F.concat("items", F.array("next")).alias("items"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))
        if k > 1:
            level = enough(matches)
    sets = level.select("items").distinct()
    return sets if size > 2 else sets.select(*[F.col("items")[i].alias(n) for i, n in enumerate(("item", "item2")[:size])])


def association_support(pairs: DataFrame, key: str, share: float) -> float:
    """A share of the baskets as a support."""
    return share * pairs.select(key).distinct().count()
