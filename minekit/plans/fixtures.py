"""Inputs of the named queries, derived from the test tables; each with the SQL of the same rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose numbers a task keeps, about.
KNOWN = 500_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(u, i, r): customers rate suppliers by the quantities they order."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("i")).agg(F.avg(F.col("l_quantity").cast("int") % 5 + 1.0).alias("r"))


RATINGS = """ratings AS MATERIALIZED (SELECT o_custkey AS u, l_suppkey AS i, avg(CAST(floor(l_quantity) AS INT) % 5 + 1.0::DOUBLE) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """(basket, item): the suppliers of each order."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item")).distinct()


BASKETS = """baskets AS MATERIALIZED (SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem),
  mean AS MATERIALIZED (SELECT (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM baskets GROUP BY basket)) / (n * (n - 1) / 2) AS m
    FROM (SELECT count(DISTINCT item) AS n FROM baskets)),
  asked AS MATERIALIZED (SELECT greatest(8, floor(0.12 * m)) AS support, m + 2 * sqrt(m) AS shared FROM mean)"""


def pair_mean(rows: DataFrame) -> float:
    """The mean number of baskets that hold a pair of items, over all pairs."""
    held = rows.groupBy("basket").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0.0
    n = rows.agg(F.count_distinct("item")).first()[0]
    return held / (n * (n - 1) / 2) if n > 1 else 0.0


def support(rows: DataFrame) -> int:
    """Baskets of a frequent itemset: 0.12 of the mean of a pair, 8 at least, so that every size of table has some."""
    return max(8, math.floor(0.12 * pair_mean(rows)))


def sets(spark: SparkSession, d: str) -> DataFrame:
    """(id, x): documents by the distinct words of their whole texts, A-Z in lower case; x is a number below 2^28 from the word."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.split(lower, r"[\x20\x09-\x0D]+"))).alias("w"))
    return words.filter("w <> ''").select("id", F.conv(F.substring(F.md5("w"), 1, 7), 16, 10).cast("long").alias("x")).distinct()


def set_rows(spark: SparkSession, d: str) -> DataFrame:
    """(id, xs): the rows of ``sets``, a set in one row, its x as little-endian 32-bit integers."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).filter("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = set((text or b"").lower().split())  # bytes: A-Z alone, and the white space of SETS
                for w in words.difference(known):
                    known[w] = int(md5(w).hexdigest()[:7], 16)
                out.append(np.unique(np.fromiter((known[w] for w in words), "<i4", len(words))).tobytes())
            if len(known) > KNOWN:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "xs"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("xs", T.BinaryType())]))


SETS = r"""sets AS MATERIALIZED (SELECT DISTINCT doc_id AS id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) AS x
  FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w FROM documents))"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, n): suppliers that share more orders than the mean of a pair by twice its square root."""
    from minekit.operators import graph

    rows = baskets(spark, d)
    mean = pair_mean(rows)
    return graph.cooccurrence(rows, "basket", "item", mean + 2 * math.sqrt(mean))


EDGES = BASKETS + """, edges AS MATERIALIZED (SELECT a.item AS src, b.item AS dst, count(*) AS n FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.item < b.item
  GROUP BY 1, 2 HAVING count(*) >= (SELECT shared FROM asked)), both_ways AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""


def stream(spark: SparkSession, d: str, per_batch: int = 100) -> DataFrame:
    """(seq, batch, value): events in order, in batches of their count; many values come again."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.floor(F.col("event_id") / per_batch).alias("batch"), F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string")).alias("value")
    )


STREAM = "stream AS MATERIALIZED (SELECT event_id AS seq, event_id // 100 AS batch, event_type || '-' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 7 AS VARCHAR) AS value FROM events)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


def users(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the columns of user records."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), (F.col("c_custkey") % 97).alias("review_count"), (F.col("c_custkey") % 7).alias("useful"),
        (F.col("c_custkey") % 5).alias("funny"), (F.col("c_custkey") % 3).alias("cool"), F.col("c_nationkey").cast("long").alias("fans"), F.col("c_acctbal").alias("average_stars"),
        (F.col("c_custkey") % 11).alias("compliment_hot"), (F.col("c_custkey") % 13).alias("compliment_plain"), F.col("c_mktsegment").alias("elite"),
        F.concat((2005 + F.col("c_custkey") % 15).cast("string"), F.lit("-03-01 00:00:00")).alias("yelping_since"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with the columns of business records."""
    k = F.col("s_suppkey")
    yes = lambda m: F.when(k % m == 0, "True").otherwise("False")
    ambience = F.concat(F.lit("{'romantic': "), yes(2), F.lit(", 'classy': "), yes(3), F.lit(", 'casual': "), yes(5), F.lit("}"))
    given = lambda m, rest, value: F.when(k % m != rest, value)  # noqa: E731  null: named without a value
    attributes = F.create_map(
        F.lit("Alcohol"), given(4, 1, F.lit("none")), F.lit("GoodForKids"), given(3, 2, yes(2)), F.lit("HasTV"), yes(2), F.lit("WheelchairAccessible"), yes(7), F.lit("RestaurantsTakeOut"), yes(3), F.lit("RestaurantsPriceRange2"), (k % 4 + 1).cast("string"), F.lit("Ambience"), ambience,
    )
    return table(spark, d, "supplier").select(
        k.cast("string").alias("business_id"), k.alias("i"), (k % 50).alias("review_count"), (k % 9 / 2.0 + 0.5).alias("stars"), (k % 2).alias("is_open"),
        F.col("s_acctbal").alias("longitude"), F.lit(None).cast("double").alias("latitude"), F.col("s_name").alias("categories"), F.when(k % 6 != 5, attributes).alias("attributes"),
    )


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Check-ins, photos and tips of suppliers, from their order lines: (business_id, time), (business_id, photo_id), (user_id, business_id, likes)."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    business = F.col("l_suppkey").cast("string").alias("business_id")
    by_slot = lines.filter("l_returnflag = 'R'").groupBy(business, F.date_format("l_shipdate", "yyyy-MM").alias("slot")).agg(F.count("*").cast("string").alias("n"))
    checkins = by_slot.groupBy("business_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("time"))
    photos = lines.filter("l_linestatus = 'F'").select(business, F.concat_ws("-", "l_orderkey", "l_linenumber").alias("photo_id"))
    return checkins, photos, lines.select(F.col("o_custkey").cast("string").alias("user_id"), business, F.col("l_linenumber").cast("long").alias("likes"))


SIDES = """lines AS MATERIALIZED (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  checkins AS (SELECT l_suppkey AS i, count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS slots FROM lines WHERE l_returnflag = 'R' GROUP BY 1),
  photos AS (SELECT l_suppkey AS i, count(*) AS photos FROM lines WHERE l_linestatus = 'F' GROUP BY 1),
  tips AS (SELECT o_custkey AS u, l_suppkey AS i, CAST(sum(l_linenumber) AS BIGINT) AS likes FROM lines GROUP BY 1, 2)"""
