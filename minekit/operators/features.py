"""Features of users and items, and content-based scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of attributes, ambiences and defaults that the features are defined by.
FLAGS = ("BusinessAcceptsCreditCards", "RestaurantsTakeOut", "RestaurantsReservations", "RestaurantsDelivery", "WheelchairAccessible", "OutdoorSeating", "HasTV")
AMBIENCES = ("romantic", "intimate", "classy", "hipster", "divey", "touristy", "trendy", "upscale", "casual")
PRESENT = ("Alcohol", "GoodForKids")
DEFAULT_STARS, DEFAULT_PRICE, DEFAULT_PLACE, THIS_YEAR = 3.0, 2, 0.5, 2022


def count_in(text: Column, count: str = "chars") -> Column:
    """Length of a list given as text: its characters, or its comma-separated items."""
    return F.coalesce(F.length(text) if count == "chars" else F.size(F.split(text, ", ")), F.lit(0)).cast("long")


def sum_by_prefix(rows: DataFrame, prefix: str) -> Column:
    names = [c for c in rows.columns if c.startswith(prefix)]
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in names), F.lit(0)).cast("long")


def user_features(users: DataFrame, version: int = 1) -> DataFrame:
    """1: seven numbers and the length of ``elite``; 2: six, with sums; 3: all counters, elite years and years of membership."""
    if version == 1:
        return users.select("user_id", "review_count", "useful", "funny", "cool", "fans", "average_stars", sum_by_prefix(users, "compliment").alias("compliments"), count_in(F.col("elite")).alias("elite"))
    if version == 2:
        liked = F.col("useful") + F.col("funny") + F.col("cool")
        return users.select("user_id", "review_count", "average_stars", liked.alias("liked"), sum_by_prefix(users, "compliment").alias("compliments"), "fans", count_in(F.col("elite")).alias("elite"))
    counters = [c for c in users.columns if c in ("review_count", "useful", "funny", "cool", "fans", "average_stars") or c.startswith("compliment_")]
    return users.select("user_id", *counters, count_in(F.col("elite"), "items").alias("elite"), (THIS_YEAR - F.year(F.to_date("yelping_since"))).alias("years"))


def flag(attributes: Column, name: str) -> Column:
    """1 where the attribute is "True", else 0, missing too."""
    return F.coalesce((F.try_element_at(attributes, F.lit(name)) == "True").cast("int"), F.lit(0))


def scaled(x: Column, low: float, high: float) -> Column:
    return F.coalesce((x - low) / (high - low), F.lit(DEFAULT_PLACE))


def item_features(items: DataFrame, version: int = 1) -> DataFrame:
    """1: review_count and stars; 2: those, price range, flags, place and categories."""
    base = [F.coalesce("review_count", F.lit(0)).alias("review_count"), F.coalesce("stars", F.lit(DEFAULT_STARS)).alias("stars")]
    if version == 1:
        return items.select("business_id", *base)
    price = F.coalesce(F.try_element_at("attributes", F.lit("RestaurantsPriceRange2")).try_cast("int"), F.lit(DEFAULT_PRICE))
    return items.select(
        "business_id", *base, price.alias("price"), *[flag(F.col("attributes"), x).alias(x) for x in FLAGS], F.coalesce("is_open", F.lit(0)).alias("is_open"),
        scaled(F.col("longitude"), -180, 180).alias("longitude"), scaled(F.col("latitude"), -90, 90).alias("latitude"), count_in(F.col("categories")).alias("categories"),
    )


def side_counts(checkins: DataFrame, photos: DataFrame, tips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(business_id, slots, photos) and (user_id, business_id, likes)."""
    slots = checkins.select("business_id", F.size(F.map_values("time")).alias("slots"))
    shots = photos.groupBy("business_id").agg(F.count("*").alias("photos"))
    return slots.join(shots, "business_id", "full"), tips.groupBy("user_id", "business_id").agg(F.sum("likes").alias("likes"))


def assemble(ratings: DataFrame, users: DataFrame, items: DataFrame, *extra: tuple[DataFrame, list[str]]) -> DataFrame:
    """Ratings (user_id, business_id, stars_given) with all features left-joined, missing as null; no tip has 0 likes."""
    out = ratings.join(users, "user_id", "left").join(items, "business_id", "left")
    for frame, keys in extra:
        out = out.join(frame, keys, "left")
    return out.fillna({"likes": 0}) if "likes" in out.columns else out


def vectors(assembled: DataFrame) -> DataFrame:
    """``assembled`` with a vector column ``features`` of all its features, missing ones as NaN."""
    from pyspark.ml.feature import VectorAssembler

    names = [c for c in assembled.columns if c not in ("user_id", "business_id", "stars_given")]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(assembled)


def ambience_profile(items: DataFrame, ambience: str = "Ambience") -> DataFrame:
    """(business_id, f, v): whether each of ``PRESENT`` is given, whatever its value, and a flag for each ambience.

    The ambience is a dictionary written as text with single quotes and True or False.
    """
    text = F.try_element_at("attributes", F.lit(ambience))
    fixed = F.replace(F.replace(F.replace(text, F.lit("'"), F.lit('"')), F.lit("True"), F.lit("true")), F.lit("False"), F.lit("false"))
    parsed = F.from_json(fixed, "map<string,boolean>")
    flags = [*[F.try_element_at("attributes", F.lit(x)).isNotNull() for x in PRESENT], *[F.coalesce(F.try_element_at(parsed, F.lit(x)), F.lit(False)) for x in AMBIENCES]]
    cells = F.array(*[F.struct(F.lit(k).alias("f"), F.coalesce(x, F.lit(False)).cast("double").alias("v")) for k, x in enumerate(flags)])
    return items.select("business_id", F.explode(cells).alias("c")).select("business_id", "c.f", "c.v")


def content_scores(ratings: DataFrame, profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, i, score): the user's rated profiles (i, f, v), summed by rating and scaled to sum 1, times the item's; null without one."""
    sums = ratings.join(profile, "i").groupBy("u", "f").agg(F.sum(F.col("r") * F.col("v")).alias("s"))
    totals = sums.groupBy("u").agg(F.sum(F.abs("s")).alias("total"))
    scores = (
        pairs.select("u", "i").join(profile, "i").join(sums, ["u", "f"]).join(totals, "u")
        .groupBy("u", "i").agg(F.try_divide(F.sum(F.col("s") * F.col("v")), F.max("total")).alias("score"))
    )
    return pairs.select("u", "i").join(scores, ["u", "i"], "left")
