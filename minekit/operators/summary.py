"""Counts, top-k, two-level means, partition profiles, and filters by group size."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def review_summary(reviews: DataFrame, user: str, item: str, when: Column) -> DataFrame:
    """One row: reviews, those that ``when`` picks, distinct users, distinct items."""
    return reviews.agg(
        F.count("*").alias("n_review"), F.count_if(when).alias("n_when"),
        F.count_distinct(user).alias("n_user"), F.count_distinct(item).alias("n_item"),
    )


def top_k(rows: DataFrame, key: str, k: int = 10, *, bottom: bool = False) -> DataFrame:
    """(key, n): the k keys of most (fewest) rows, ties by key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.asc("n") if bottom else F.desc("n"), key).limit(k)


def by_year(rows: DataFrame, at: str) -> DataFrame:
    return rows.groupBy(F.year(at).cast("long").alias("year")).agg(F.count("*").alias("n"))


def two_level_mean(rows: DataFrame, places: DataFrame, item: str, value: str, place: str) -> DataFrame:
    """Mean over a place's items of each item's mean: every item counts once."""
    means = rows.groupBy(item).agg(F.avg(value).alias("m"))
    return means.join(places.select(item, place), item).groupBy(place).agg(F.avg("m").alias("mean")).orderBy(F.desc("mean"), place)


def partition_profile(rows: DataFrame, key: Column, n: int = 30, *, least: int = 50) -> DataFrame:
    """(pid, n_items) of an explicit hash partitioning; one partition where there are fewer than ``least`` rows."""
    few = rows.limit(least).count() < least  # a bounded look
    pid = F.lit(0) if few else F.pmod(key * 23 + 109, F.lit(n))
    return rows.groupBy(pid.cast("long").alias("pid")).agg(F.count("*").alias("n_items"))


def actual_partitions(rows: DataFrame, n: int | None = None, *keys: str) -> DataFrame:
    """(pid, n_items) of the partitions that Spark has, or makes by key."""
    dealt = rows.repartition(n, *keys) if n else rows
    return dealt.groupBy(F.spark_partition_id().alias("pid")).agg(F.count("*").alias("n_items"))


def larger_groups(pairs: DataFrame, group: str, item: str, more_than: int) -> DataFrame:
    """(group, n): groups of more than so many distinct items."""
    return pairs.groupBy(group).agg(F.count_distinct(item).alias("n")).filter(F.col("n") > more_than)


def popular_only(rows: DataFrame, train: DataFrame, item: str, least: int = 20) -> DataFrame:
    """The rows whose item has so many training rows."""
    popular = train.groupBy(item).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(item)
    return rows.join(popular, item, "left_semi")


def timed_profile(rows: DataFrame, key: str, n: int = 30, *, least: int = 50) -> DataFrame:
    """(kind, n_partition, n_items, exe_time): as Spark has the rows, and dealt by key to ``n`` partitions.

    ``n_items`` lists the rows of each partition; the time is that of the ten keys of
    fewest rows.  Where the default has fewer than ``least`` rows, by its number of
    partitions times the first's size, the dealt rows are one partition.
    """
    spark, out = rows.sparkSession, []
    sizes: list[int] = []
    for kind in ("default", "customized"):
        if kind == "customized":
            n = 1 if len(sizes) * sizes[0] < least else n
        dealt = rows if kind == "default" else rows.repartition(n, key)
        began = time.time()
        top_k(dealt, key, bottom=True).collect()
        took = time.time() - began
        found = {r["pid"]: r["n_items"] for r in actual_partitions(dealt).collect()}  # a row for each partition
        parts = max(found, default=-1) + 1 if kind == "default" else n
        sizes = [found.get(k, 0) for k in range(parts)] or [0]
        out.append((kind, len(sizes), sizes, took))
    return spark.createDataFrame(out, "kind string, n_partition long, n_items array<long>, exe_time double")


def timed_top(groups: DataFrame, key: str, value: str, k: int = 10, *, most: int = 1_000_000) -> DataFrame:
    """(way, keys, exe_time): the k groups of greatest value, sorted on the driver ("m1") and by Spark ("m2").

    More than ``most`` groups are not collected; "m1" is left out then.
    """
    spark, out = groups.sparkSession, []
    began = time.time()
    few = groups.select(key, value).limit(most + 1).collect()
    if len(few) <= most:
        first = sorted(few, key=lambda r: (-r[value], r[key]))[:k]
        out.append(("m1", [str(r[key]) for r in first], time.time() - began))
    began = time.time()
    top = groups.orderBy(F.desc(value), key).limit(k).collect()
    out.append(("m2", [str(r[key]) for r in top], time.time() - began))
    return spark.createDataFrame(out, "way string, keys array<string>, exe_time double")
