"""Feature engineering for rating prediction: aggregates, shrunk means, per-entity features, feature rows of three models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions import scalars as S


def pair_split(ratings: DataFrame, share: float, salt: str) -> DataFrame:
    """Adds `inner`: whether a pair falls into the validation share, by a stable hash."""
    return ratings.withColumn("bucket", S.pair_bucket("u", "b", salt)).withColumn("inner", F.col("bucket") < int(share * 1000))


def moments(ratings: DataFrame, key: str) -> DataFrame:
    """(key, mean, n, variance): the variance is of the population and never below 0."""
    return ratings.groupBy(key).agg(F.avg("stars").alias("mean"), F.count("*").alias("n"), F.greatest(F.lit(0.0), F.var_pop("stars")).alias("variance"))


def shrunk_means(ratings: DataFrame, key: str, beta: float, default: float = 3.5) -> DataFrame:
    """(key, shrunk): means drawn to the global one."""
    mu = ratings.agg(F.coalesce(F.avg("stars"), F.lit(default)).alias("mu"))
    return moments(ratings, key).join(F.broadcast(mu)).select(key, S.damped_mean(F.col("mean") * F.col("n"), "n", "mu", beta).alias("shrunk"))


def count_percentile(counts: DataFrame, column: str, q: float) -> DataFrame:
    """The count at place floor(q * (rows - 1)) of the ascending counts, found from a histogram of the counts."""
    histogram = counts.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    at = histogram.agg(F.floor(F.lit(q) * (F.sum("c") - 1)).alias("at"))
    upto = histogram.withColumn("upto", F.sum("c").over(Window.orderBy("v")))
    return upto.join(F.broadcast(at)).where("upto > at").agg(F.min("v").alias("value"))


def popularity(df: DataFrame, group: str) -> DataFrame:
    """Adds n_<group>, the rows that share the group's value."""
    return df.join(df.groupBy(group).agg(F.count("*").alias(f"n_{group}")), group, "left")


def user_features(users: DataFrame) -> DataFrame:
    """Projection of user records (user_id, review_count, average_stars, fans, useful, funny, cool, elite, friends, compliment_*)."""
    compliments = [c for c in users.columns if c.startswith("compliment_")]
    log = lambda c: S.log1p_plus(S.make_float(c))
    elite = S.count_items("elite")
    return users.where("user_id IS NOT NULL").select(
        "user_id", log("review_count").alias("u_review_count_log"), S.make_float("average_stars").alias("u_average_stars"), log("fans").alias("u_fans_log"),
        log("useful").alias("u_useful_log"), log("funny").alias("u_funny_log"), log("cool").alias("u_cool_log"), elite.cast("double").alias("u_elite_count"),
        S.log1p_plus(elite).alias("u_elite_count_log"), (elite > 0).cast("double").alias("u_is_elite"), S.count_items("friends").cast("double").alias("u_friends_count"),
        (S.sum_of([S.make_float(c) for c in compliments]) if compliments else F.lit(0.0)).alias("u_compliments"),
    )


def business_features(businesses: DataFrame) -> DataFrame:
    """Projection of business records with attributes and hours as maps, popularity of city and state, half-degree bins."""
    attribute = lambda k: F.col("attributes")[k]
    categories = S.list_items("categories")
    rows = popularity(popularity(businesses.where("business_id IS NOT NULL"), "city"), "state")
    return rows.select(
        "business_id", S.make_float("stars").alias("b_stars"), S.log1p_plus(S.make_float("review_count")).alias("b_review_count_log"), S.make_float("is_open").alias("b_is_open"),
        S.make_float(attribute("RestaurantsPriceRange2")).alias("b_price"), F.size(categories).cast("double").alias("b_categories_n"),
        F.coalesce(F.size(F.map_keys("hours")), F.lit(0)).cast("double").alias("b_hours_n"), S.parse_bool(attribute("BusinessAcceptsCreditCards")).alias("b_accepts_credit_cards"),
        S.noise_level(attribute("NoiseLevel")).alias("b_noise_level"), S.parse_bool(attribute("RestaurantsTakeOut")).alias("b_takeout"),
        S.parse_bool(attribute("RestaurantsDelivery")).alias("b_delivery"), S.parse_bool(attribute("ByAppointmentOnly")).alias("b_appointment"),
        S.parse_bool(attribute("RestaurantsReservations")).alias("b_reservations"), S.parse_bool(attribute("RestaurantsTableService")).alias("b_table_service"),
        S.parse_bool(attribute("WheelchairAccessible")).alias("b_wheelchair"), S.log1p_plus("n_city").alias("b_city_pop_log"), S.log1p_plus("n_state").alias("b_state_pop_log"),
        S.geo_bin(S.make_float("latitude")).alias("b_lat_bin"), S.geo_bin(S.make_float("longitude")).alias("b_lon_bin"), categories.alias("b_categories"),
    )


def extra_business_features(features: DataFrame, checkins: DataFrame, photos: DataFrame, tips: DataFrame) -> DataFrame:
    """Check-in totals, photo and tip counts of the businesses that are there already."""
    seen = checkins.groupBy("business_id").agg(F.sum(S.map_total("time")).alias("b_checkins_total"))
    shots = photos.groupBy("business_id").agg(F.count("*").cast("double").alias("b_photo_count"))
    said = tips.groupBy("business_id").agg(F.count("*").cast("double").alias("b_tip_count"))
    out = features
    for more in (seen, shots, said):
        out = out.join(more, "business_id", "left")
    return out.fillna(0.0, ["b_checkins_total", "b_photo_count", "b_tip_count"])


def review_text_features(reviews: DataFrame, key: str, prefix: str) -> DataFrame:
    """Reviews, mean length, positive and negative words and their dominance, by user or business."""
    s = S.review_sentiment("text")
    rows = reviews.where(F.col(key).isNotNull()).select(key, s.alias("s"))
    sums = rows.groupBy(key).agg(F.count("*").cast("double").alias("n"), F.sum("s.length").alias("length"), F.sum("s.pos").cast("double").alias("pos"), F.sum("s.neg").cast("double").alias("neg"))
    return sums.select(
        key, F.col("n").alias(f"{prefix}_text_count"), (F.col("length") / F.col("n")).alias(f"{prefix}_text_avg_len"), F.col("pos").alias(f"{prefix}_pos"), F.col("neg").alias(f"{prefix}_neg"),
        F.greatest(F.lit(0.0), (F.col("neg") - F.col("pos")) / (F.col("neg") + F.col("pos") + 1.0)).alias(f"{prefix}_neg_dom"),
    )


def with_review_text(features: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """Full outer: ids with reviews alone get rows too; missing numbers are 0."""
    return features.join(text, key, "full").fillna(0.0)


def user_trust(reviews: str, useful: str, elite: str, length: str):
    """.3 log reviews + .35 log useful + .1 elite + .25 log mean length."""
    return 0.3 * S.log1p_plus(reviews) + 0.35 * S.log1p_plus(useful) + 0.1 * F.col(elite) + 0.25 * S.log1p_plus(length)


def tip_features(tips: DataFrame, key: str, half_life: float = 180.0, recent_days: int = 365) -> DataFrame:
    """Tips by user or business: count, mean sentiment, sentiment with decay, recent ones. Now is the latest date, or 2019-01-01."""
    rows = tips.where(F.col(key).isNotNull()).select(key, S.date_ordinal("date").alias("day"), S.tip_sentiment("text")["sentiment"].alias("s"))
    now = tips.agg(F.coalesce(F.max(S.date_ordinal("date")), S.date_ordinal(F.lit("2019-01-01"))).alias("now"))
    age = F.col("now") - F.col("day")
    return rows.join(F.broadcast(now)).groupBy(key).agg(
        F.count("*").cast("double").alias("tip_count"), F.avg("s").alias("tip_sentiment"), F.sum(F.col("s") * S.decay(age, half_life)).alias("tip_decayed"),
        F.count_if(age <= recent_days).cast("double").alias("tip_recent"),
    )


#: What a column is for an entity that has no record, where that isn't 0.
MISSING = {"b_noise_level": 1.0}


def tip_aggregates(tips: DataFrame, half_life: float = 180.0, recent_days: int = 365) -> DataFrame:
    """(kind, id, tip_count, tip_sentiment, tip_decayed, tip_recent) for businesses (B) and users (U) in one pass.

    Only tips with both ids and a valid date count. Now is the latest date of all, or 2019-01-01.
    """
    now = tips.agg(F.coalesce(F.max(S.date_ordinal("date")), S.date_ordinal(F.lit("2019-01-01"))).alias("now"))
    whole = tips.withColumn("day", S.date_ordinal("date")).where("business_id IS NOT NULL AND user_id IS NOT NULL AND day IS NOT NULL")
    rows = whole.select("business_id", "user_id", "day", S.tip_sentiment("text")["sentiment"].alias("s")).join(F.broadcast(now))
    sides = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("id")) for k, c in (("B", "business_id"), ("U", "user_id"))])
    age = F.greatest(F.col("now") - F.col("day"), F.lit(0))
    tagged = rows.select(F.explode(sides).alias("of"), "s", (F.col("s") * S.decay(age, half_life)).alias("d"), (age <= recent_days).cast("double").alias("r"))
    return tagged.groupBy("of.kind", "of.id").agg(F.count("*").cast("double").alias("tip_count"), F.avg("s").alias("tip_sentiment"), F.sum("d").alias("tip_decayed"), F.sum("r").alias("tip_recent"))


COMPLIMENTS = "hot profile list note plain cool funny writer photos".split()


def plain_user_features(users: DataFrame) -> DataFrame:
    """The third model's projection of user records: counts as they are."""
    number = lambda c, name=None: S.make_float(c).alias("u_" + (name or c))
    return users.where("user_id IS NOT NULL").select(
        "user_id", number("review_count"), S.count_items("friends").cast("double").alias("u_friends"), *[number(c) for c in ("useful", "funny", "cool", "fans")],
        S.count_items("elite").cast("double").alias("u_elite"), number("average_stars"), *[number(f"compliment_{k}") for k in COMPLIMENTS],
    )


def plain_business_features(businesses: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """The third model's projection of business records, with a column for every group of categories."""
    attribute = lambda k: F.col("attributes")[k]
    *flags, size = S.one_hot(S.list_items("categories"), groups)
    return businesses.where("business_id IS NOT NULL").select(
        "business_id", *[S.make_float(c).alias(f"b_{c}") for c in ("stars", "review_count", "latitude", "longitude")], S.make_float(attribute("RestaurantsPriceRange2")).alias("b_price_range"),
        *[S.parse_bool(attribute(k)).alias(f"b_{n}") for n, k in (("credit_card", "BusinessAcceptsCreditCards"), ("appointment_only", "ByAppointmentOnly"), ("reservations", "RestaurantsReservations"), ("table_service", "RestaurantsTableService"), ("wheelchair", "WheelchairAccessible"))],
        size.alias("b_num_categories"), *flags,
    )


# Column orders of the three models' rows over the joined tables (fixed values).
FIRST_ROW = {
    "u_n_log": "u_n_log", "b_n_log": "b_n_log", "u_mean": "u_mean", "b_mean": "b_mean", "u_average_stars": "u_average_stars", "u_review_count_log": "u_review_count_log", "u_fans_log": "u_fans_log",
    "u_useful_log": "u_useful_log", "b_stars": "b_stars", "b_review_count_log": "b_review_count_log", "b_is_open": "b_is_open", "b_price": "b_price", "b_hours_n": "b_hours_n", "b_stars_centred": "b_stars - mu",
    "b_hours_log": "ln(1 + b_hours_n)", "b_price_squared": "b_price * b_price", "stars_gap": "u_average_stars - b_stars", "b_state_pop_log": "b_state_pop_log", "b_checkins_root": "sqrt(greatest(0.0D, b_checkins_total))",
    "b_tips_log": "0.8D * ln(1 + b_tip_count)", "b_noise_level": "b_noise_level", "b_takeout": "b_takeout", "u_elite_count": "u_elite_count",
}
SECOND_ROW = {
    **{k: FIRST_ROW[k] for k in ("u_n_log", "b_n_log", "u_mean", "b_mean", "u_average_stars", "u_review_count_log", "u_fans_log", "u_useful_log")},
    "u_trust": "u_trust", "u_text_count": "u_text_count", "u_text_len_log": "ln(1 + u_text_avg_len)", "u_pos": "u_pos", "u_neg": "u_neg",
    **{k: FIRST_ROW[k] for k in ("b_stars", "b_review_count_log", "b_is_open", "b_price", "b_hours_n", "b_stars_centred", "b_hours_log", "b_price_squared", "stars_gap", "b_checkins_root")},
    "b_lat_bin": "b_lat_bin", "b_lon_bin": "b_lon_bin", **{k: FIRST_ROW[k] for k in ("b_noise_level", "b_takeout", "u_elite_count")},
    "centred": "centred", "b_text_count": "b_text_count", "b_text_len_log": "ln(1 + b_text_avg_len)", "b_pos": "b_pos", "b_neg": "b_neg",
}
THIRD_ROW = [
    *[f"b_{c}" for c in "stars review_count latitude longitude price_range credit_card appointment_only reservations table_service wheelchair".split()],
    *[f"u_{c}" for c in "review_count friends useful funny cool fans elite average_stars".split()], *[f"u_compliment_{k}" for k in COMPLIMENTS],
    *[f"b_tip_{c}" for c in "count sentiment decayed recent".split()], *[f"u_tip_{c}" for c in "count sentiment decayed".split()], "b_num_categories",
]


def model_rows(pairs: DataFrame, ratings: DataFrame, users: DataFrame, items: DataFrame, row: dict[str, str]) -> DataFrame:
    """The first or second model's row for each pair, in its column order; users and items hold the entity features under u and b."""
    whole = feature_rows(pairs, ratings, users, items)
    keep = [c for c in pairs.columns if c not in row]
    return whole.select(*keep, "base", "u_n", "b_n", *[F.expr(e).alias(k) for k, e in row.items()])


def third_rows(pairs: DataFrame, users: DataFrame, items: DataFrame, tips: DataFrame, groups: list[str]) -> DataFrame:
    """The third model's row for each pair: entity and tip features and category groups; what is missing is 0."""
    of = lambda kind, key, names: tips.where(F.col("kind") == kind).select(F.col("id").alias(key), *[F.col(f"tip_{n}").alias(f"{key}_tip_{n}") for n in names])
    text = lambda df, key: df.withColumn(key, F.col(key).cast("string"))
    out = pairs.withColumn("_u", F.col("u").cast("string")).withColumn("_b", F.col("b").cast("string"))
    sides = [(text(users, "u"), "u"), (text(items, "b"), "b"), (of("U", "u", ["count", "sentiment", "decayed"]), "u"), (of("B", "b", ["count", "sentiment", "decayed", "recent"]), "b")]
    for df, key in sides:
        out = out.join(df.withColumnRenamed(key, f"_{key}"), f"_{key}", "left")
    names = [*THIRD_ROW, *groups]
    return out.select(*pairs.columns, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def feature_rows(pairs: DataFrame, ratings: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None, user_beta: float = 20.0, item_beta: float = 110.0, default: float = 3.5) -> DataFrame:
    """One row for each pair: base = mu + (shrunk u - mu) + (shrunk b - mu), activity, means, squares, gaps, and whatever the entity tables hold.

    The columns of `users` (key u) and `items` (key b) are joined as they are, missing numbers as 0.
    """
    mu = ratings.agg(F.coalesce(F.avg("stars"), F.lit(default)).alias("mu"))
    side = lambda k, beta: moments(ratings, k).join(shrunk_means(ratings, k, beta, default), k).select(k, *[F.col(c).alias(f"{k}_{c}") for c in ("mean", "n", "variance", "shrunk")])
    out = pairs.join(side("u", user_beta), "u", "left").join(side("b", item_beta), "b", "left").join(F.broadcast(mu))
    for k in "ub":
        out = out.withColumns({f"{k}_mean": F.coalesce(f"{k}_mean", "mu"), f"{k}_shrunk": F.coalesce(f"{k}_shrunk", "mu"), f"{k}_n": F.coalesce(F.col(f"{k}_n").cast("double"), F.lit(0.0)), f"{k}_variance": F.coalesce(f"{k}_variance", F.lit(0.0))})
    for k, more in (("u", users), ("b", items)):
        if more is not None:
            numbers = {c: MISSING.get(c, 0.0) for c, kind in more.dtypes if c != k and kind in ("double", "int", "bigint")}
            out = out.join(more, k, "left").fillna(numbers)
    return out.withColumns({
        "base": F.col("u_shrunk") + F.col("b_shrunk") - F.col("mu"), "u_n_log": S.log1p_plus("u_n"), "b_n_log": S.log1p_plus("b_n"),
        "gap": F.abs(F.col("u_mean") - F.col("b_mean")), "gap_shrunk": F.abs(F.col("u_shrunk") - F.col("b_shrunk")),
        "centred": (F.col("u_mean") - F.col("mu")) * (F.col("b_mean") - F.col("mu")), "u_new": (F.col("u_n") == 0).cast("double"), "b_new": (F.col("b_n") == 0).cast("double"),
    })


CORE = ["u_n_log", "b_n_log", "u_mean", "b_mean", "u_variance", "b_variance", "u_shrunk", "b_shrunk", "gap", "gap_shrunk", "centred", "u_new", "b_new"]


def densify(rows: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """The columns, in order, as one dense vector."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(rows)
