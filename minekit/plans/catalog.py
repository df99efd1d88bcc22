"""Named queries over the test tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.functions import hashing, metrics
from minekit.operators import cf, clustering, features, graph, itemsets, joined, models, similarity, sketches, summary
from minekit.plans import fixtures as fx
from minekit.plans.iterate import cut
from minekit.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _six(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


# ---------------------------------------------------------------- summaries


@query("review_summary", """SELECT count(*) AS n_review, count(*) FILTER (WHERE strftime(ts, '%Y-%m-%d') LIKE '2024-01-1%') AS n_when,
  count(DISTINCT user_id) AS n_user, count(DISTINCT event_type) AS n_item FROM events""")
def _(spark, d):
    return summary.review_summary(fx.table(spark, d, "events"), "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").startswith("2024-01-1"))


@query("top10_users", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def _(spark, d):
    return summary.top_k(fx.table(spark, d, "events"), "user_id")


@query("top10_items", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def _(spark, d):
    return summary.top_k(fx.table(spark, d, "lineitem"), "l_partkey")


@query("bottom10_items", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n, l_partkey LIMIT 10")
def _(spark, d):
    return summary.top_k(fx.table(spark, d, "lineitem"), "l_partkey", bottom=True)


@query("yearly_count", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return summary.by_year(fx.table(spark, d, "orders"), "o_orderdate")


@query("group_mean_two_level", """SELECT n_name, round(avg(m), 6) AS mean FROM (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def _(spark, d):
    places = fx.table(spark, d, "supplier").join(fx.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("s_suppkey", "l_suppkey")
    return summary.two_level_mean(fx.table(spark, d, "lineitem"), places, "l_suppkey", "l_quantity", "n_name").select("n_name", *_six("mean"))


@query("partition_profile", "SELECT (user_id * 23 + 109) % 30 AS pid, count(*) AS n_items FROM events GROUP BY 1")
def _(spark, d):
    return summary.partition_profile(fx.table(spark, d, "events"), F.col("user_id"))


@query("basket_size_filter", "SELECT l_orderkey AS basket, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 5")
def _(spark, d):
    return summary.larger_groups(fx.baskets(spark, d), "basket", "item", 5)


@query("popular_filter", f"""WITH {fx.RATINGS}, train AS (SELECT * FROM ratings WHERE (u * 31 + i) % 5 <> 0)
  SELECT u, i, round(r, 6) AS r FROM ratings WHERE i IN (SELECT i FROM train GROUP BY 1 HAVING count(*) >= 380)""")
def _(spark, d):
    rated = fx.ratings(spark, d)
    return summary.popular_only(rated, rated.filter("(u * 31 + i) % 5 <> 0"), "i", 380).select("u", "i", *_six("r"))


@query("transaction_baskets", """SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || '-' || CAST(o_custkey AS VARCHAR) AS basket, o_orderpriority AS item FROM orders""")
def _(spark, d):
    orders = fx.table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return readers.transactions(orders, "day", "o_custkey", "o_orderpriority")


@query("basket_orientation", f"WITH {fx.RATINGS} SELECT i AS basket, count(*) AS n FROM ratings GROUP BY 1")
def _(spark, d):
    return readers.baskets(fx.ratings(spark, d), 2, "u", "i").groupBy("basket").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- frequent itemsets

#: The least support, as SQL, and itemset sizes that the SQL goes to: more than any level here that is not empty.
SUPPORT, TOP = "(SELECT support FROM asked)", 8


def _shown(found: DataFrame) -> DataFrame:
    return found.select(F.array_join(F.transform("itemset", lambda x: x.cast("string")), ",").alias("itemset"), F.size("itemset").cast("long").alias("size"), "count")


def _itemset_sql(where: str = "", by: str = "", least: str = SUPPORT, most: int = TOP) -> str:
    """Levels 1 to ``most`` as CTEs; by: a column of ``held`` that sets are counted within."""
    b = f"{by}, " if by else ""
    same = f" AND h.{by} = i.{by}" if by else ""
    out = [f"items AS MATERIALIZED (SELECT * FROM dealt WHERE ({b}item) IN (SELECT ({b}item) FROM dealt GROUP BY {b}item HAVING count(*) >= {least}))"]
    out.append(f"h1 AS MATERIALIZED (SELECT {b}basket, [item] AS s FROM items)")
    for k in range(2, most + 1):
        out.append(f"""g{k} AS MATERIALIZED (SELECT {'h.' + by + ', ' if by else ''}h.basket, list_append(h.s, i.item) AS s FROM h{k - 1} h JOIN items i ON h.basket = i.basket{same} AND i.item > h.s[-1]),
  h{k} AS MATERIALIZED (SELECT * FROM g{k} WHERE ({b}s) IN (SELECT ({b}s) FROM g{k} GROUP BY {b}s HAVING count(*) >= {least}))""")
    return ", ".join(out)


_LISTED = "array_to_string(s, ',') AS itemset, CAST(len(s) AS BIGINT) AS size"
_ALL = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(1, TOP + 1))
_FREQUENT = f"WITH {fx.BASKETS}, dealt AS (SELECT * FROM baskets), {_itemset_sql()} SELECT {_LISTED}, count(*) AS count FROM ({_ALL}) GROUP BY s"
_PAIRS = f"WITH {fx.BASKETS}, dealt AS (SELECT * FROM baskets), {_itemset_sql(most=2)} SELECT {_LISTED}, count(*) AS count FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY s"


@query("frequent_itemsets", _FREQUENT)
def _(spark, d):
    rows = cut(fx.baskets(spark, d))
    return _shown(itemsets.apriori(rows, fx.support(rows)))


@query("frequent_pairs_pcy", _PAIRS)
def _(spark, d):
    rows = cut(fx.baskets(spark, d))
    return _shown(itemsets.pcy(rows, fx.support(rows), most=2))


@query("multihash_pairs", _PAIRS)
def _(spark, d):
    rows = cut(fx.baskets(spark, d))
    return _shown(itemsets.multi_hash(rows, fx.support(rows)))


@query("pcy_bitmap", f"""WITH {fx.BASKETS} SELECT bucket, count(*) AS n FROM (
  SELECT (((a.item * 31 + b.item) % 2147483647) * 7 + 3) % 1009 AS bucket FROM baskets a JOIN baskets b ON a.basket = b.basket AND a.item < b.item) GROUP BY 1 HAVING count(*) >= {SUPPORT}""")
def _(spark, d):
    rows = cut(fx.baskets(spark, d))
    pairs = rows.join(rows.withColumnRenamed("item", "other"), "basket").filter("item < other").select(F.array("item", "other").alias("itemset"))
    return itemsets.bitmap(pairs, fx.support(rows), 1009, 7, 3)


@query("son_candidates", f"WITH {fx.BASKETS}, dealt AS (SELECT basket, item, basket % 2 AS chunk FROM baskets), {_itemset_sql(by='chunk', least='(SELECT support / 2 FROM asked)', most=2)} SELECT DISTINCT {_LISTED} FROM (SELECT s FROM h1 UNION ALL SELECT s FROM h2)")
def _(spark, d):
    rows = cut(fx.baskets(spark, d))
    found = itemsets.son_candidates(rows, fx.support(rows), 2, F.col("basket"), most=2)
    return _shown(found.withColumn("count", F.lit(0))).drop("count")


@query("son_frequent", _FREQUENT)
def _(spark, d):
    rows = cut(fx.baskets(spark, d))
    return _shown(itemsets.son(rows, fx.support(rows), 2, F.col("basket")))


# ---------------------------------------------------------------- similarity

_JACCARD = """pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) AS k FROM sets a JOIN sets b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
  sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY 1),
  scored AS MATERIALIZED (SELECT a, b, k / (p.n + q.n - k) AS similarity FROM pairs JOIN sizes p ON a = p.id JOIN sizes q ON b = q.id)"""
N_HASH = 100
_BANDS, _ = similarity.bands_and_rows(N_HASH, 0.5)
_FAMILY = hashing.family(N_HASH)
_SIGNATURES = (
    "signatures AS MATERIALIZED (SELECT id, ["
    + ", ".join(f"min((CAST({a} AS BIGINT) * x + {b}) % {hashing.PRIME})" for a, b in _FAMILY)
    + "] AS signature FROM sets GROUP BY id)"
)
_CANDIDATES = (
    "banded AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT id, {k} AS band, signature[{first + 1}:{first + size}] AS key FROM signatures" for k, (first, size) in enumerate(similarity.band_bounds(N_HASH, _BANDS)))
    + "), candidates AS MATERIALIZED (SELECT DISTINCT p.id AS a, q.id AS b FROM banded p JOIN banded q ON p.band = q.band AND p.key = q.key AND p.id < q.id)"
)


@query("jaccard_exact", f"WITH {fx.SETS}, {_JACCARD} SELECT a, b, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.5")
def _(spark, d):
    return joined.similar(joined.merged(cut(fx.set_rows(spark, d))), 0.5).select("a", "b", *_six("similarity"))


@query("minhash_signatures", f"WITH {fx.SETS}, {_SIGNATURES} SELECT id, array_to_string(signature, ',') AS signature FROM signatures")
def _(spark, d):
    return similarity.minhash(fx.sets(spark, d), _FAMILY, hashing.PRIME).select("id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


@query("lsh_candidates", f"WITH {fx.SETS}, {_SIGNATURES}, {_CANDIDATES} SELECT a, b FROM candidates")
def _(spark, d):
    return similarity.candidates(cut(similarity.minhash(fx.sets(spark, d), _FAMILY, hashing.PRIME)), _BANDS, N_HASH)


@query("lsh_similar_pairs", f"WITH {fx.SETS}, {_JACCARD}, {_SIGNATURES}, {_CANDIDATES} SELECT a, b, round(similarity, 6) AS similarity FROM scored JOIN candidates USING (a, b) WHERE similarity >= 0.5")
def _(spark, d):
    banding = similarity.banding(N_HASH, 0.5, hashing.SEED, hashing.PRIME)
    return joined.similar(joined.merged(cut(fx.set_rows(spark, d))), 0.5, banding).select("a", "b", *_six("similarity"))


@query("dense_ids", "SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS index FROM (SELECT DISTINCT n_name FROM nation)")
def _(spark, d):
    return similarity.dense_ids(fx.table(spark, d, "nation"), "n_name")


# ---------------------------------------------------------------- collaborative filtering

_TRAIN = fx.RATINGS + """, train AS MATERIALIZED (SELECT * FROM ratings WHERE (u * 31 + i) % 5 <> 0), test AS MATERIALIZED (SELECT * FROM ratings WHERE (u * 31 + i) % 5 = 0)"""
_PEARSON = """sums AS MATERIALIZED (SELECT a.i AS i, b.i AS j, count(*) AS n, sum(a.r) AS sx, sum(b.r) AS sy, sum(a.r * b.r) AS sxy, sum(a.r * a.r) AS sxx, sum(b.r * b.r) AS syy
  FROM train a JOIN train b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2 HAVING count(*) >= 25),
  spread AS (SELECT *, sqrt(greatest(n * sxx - sx * sx, 0) * greatest(n * syy - sy * sy, 0)) AS below FROM sums),
  weights AS MATERIALIZED (SELECT i, j, CASE WHEN below > 1e-9 THEN (n * sxy - sx * sy) / below ELSE 0 END AS w, n FROM spread)"""
_NEAR = """near AS MATERIALIZED (SELECT * FROM (SELECT t.u, t.i, w.j, w.w, r.r, row_number() OVER (PARTITION BY t.u, t.i ORDER BY round(w.w, 9) DESC, w.j) AS rank
  FROM test t JOIN train r ON r.u = t.u JOIN weights w ON w.i = t.i AND w.j = r.i WHERE w.w > {cut}) WHERE rank <= 20)"""
_CF = """summed AS (SELECT u, i, sum(r * w) / sum(abs(w)) AS cf, count(*) AS n FROM near GROUP BY 1, 2), means AS (SELECT u, avg(r) AS mean FROM train GROUP BY 1),
  predicted AS MATERIALIZED (SELECT t.u, t.i, coalesce(cf, mean, (SELECT avg(r) FROM train)) AS p, coalesce(n, 0) AS n, t.r AS y
  FROM test t LEFT JOIN summed s ON s.u = t.u AND s.i = t.i LEFT JOIN means m ON m.u = t.u)"""


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    rated = cut(fx.ratings(spark, d))
    return rated.filter("(u * 31 + i) % 5 <> 0"), rated.filter("(u * 31 + i) % 5 = 0")


def _weights(train: DataFrame) -> DataFrame:
    return cut(cf.pearson(train))


def _predicted(spark, d, more_than: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test = _split(spark, d)
    weights = _weights(train).withColumn("w", F.round("w", 9))
    return train, test, cf.predict(train, test, weights, more_than=more_than)


@query("item_pearson", f"WITH {_TRAIN}, {_PEARSON} SELECT i, j, round(w, 6) AS w, n FROM weights")
def _(spark, d):
    train, _ = _split(spark, d)
    return cf.pearson(train).select("i", "j", *_six("w"), "n")


@query("case_amplified", f"WITH {_TRAIN}, {_PEARSON} SELECT i, j, round(w * pow(abs(w), 1.2), 6) AS w FROM weights")
def _(spark, d):
    train, _ = _split(spark, d)
    return cf.pearson(train).select("i", "j", F.round(cf.amplified(F.col("w")), 6).alias("w"))


_ROUNDED = _PEARSON.replace("THEN (n * sxy - sx * sy) / below", "THEN round((n * sxy - sx * sy) / below, 9)")


@query("topn_neighbours", f"WITH {_TRAIN}, {_ROUNDED}, {_NEAR.format(cut=0)} SELECT u, i, j, round(w, 6) AS w, rank FROM near")
def _(spark, d):
    train, test = _split(spark, d)
    weights = _weights(train).withColumn("w", F.round("w", 9))
    return cf.neighbours_of(weights, train, test).select("u", "i", "j", *_six("w"), F.col("rank").cast("long").alias("rank"))


@query("cf_predictions", f"WITH {_TRAIN}, {_ROUNDED}, {_NEAR.format(cut=0)}, {_CF} SELECT u, i, round(p, 6) AS p, n FROM predicted")
def _(spark, d):
    return _predicted(spark, d)[2].select("u", "i", *_six("p"), "n")


@query("hybrid_predictions", f"""WITH {_TRAIN}, {_ROUNDED}, {_NEAR.format(cut=0.12)}, {_CF}, model AS (SELECT i, avg(r) AS m FROM train GROUP BY 1)
  SELECT u, p.i, round(CASE WHEN n >= 1 THEN p ELSE coalesce(m, p) END, 6) AS p FROM predicted p LEFT JOIN model USING (i)""")
def _(spark, d):
    train, test, found = _predicted(spark, d, 0.12)
    model = test.select("u", "i").join(train.groupBy("i").agg(F.avg("r").alias("m")), "i")
    return cf.hybrid(found, model).select("u", "i", *_six("p"))


@query("hybrid_with_trees")
def _(spark, d):
    """The neighbours' prediction where there are any, else that of boosted trees on user and item features."""
    _, test, found = _predicted(spark, d, 0.12)
    train, rows, names = _learnable(spark, d)
    model = models.apply(models.boosted_trees(train, names), rows, names).select("u", "i", F.col("p").alias("m"))
    return cf.hybrid(found, model)


@query("neighbour_counts", f"WITH {_TRAIN}, {_PEARSON} SELECT t.u, t.i, count(*) AS n FROM test t JOIN train r ON r.u = t.u JOIN weights w ON w.i = t.i AND w.j = r.i GROUP BY 1, 2")
def _(spark, d):
    train, test = _split(spark, d)
    return cf.neighbour_counts(_weights(train), train, test)


_SCORED = f"WITH {_TRAIN}, {_ROUNDED}, {_NEAR.format(cut=0)}, {_CF}"


@query("rmse_eval", f"{_SCORED} SELECT round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, count(*) AS n FROM predicted")
def _(spark, d):
    _, test, found = _predicted(spark, d)
    return metrics.rmse(found.drop("n").join(test.withColumnRenamed("r", "y"), ["u", "i"])).select(*_six("rmse"), "n")


@query("error_histogram", f"{_SCORED} SELECT CAST(floor(round(abs(p - y), 9)) AS BIGINT) AS bin, count(*) AS n FROM predicted GROUP BY 1")
def _(spark, d):
    _, test, found = _predicted(spark, d)
    rows = found.drop("n").join(test.withColumnRenamed("r", "y"), ["u", "i"]).select(F.lit(0.0).alias("y"), F.round(F.abs(F.col("p") - F.col("y")), 9).alias("p"))
    return metrics.error_histogram(rows)


@query("selector_accuracy", f"{_SCORED} SELECT round(avg(CASE WHEN (p >= 3) = (y >= 3) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM predicted")
def _(spark, d):
    _, test, found = _predicted(spark, d)
    return metrics.accuracy(found.drop("n").join(test.withColumnRenamed("r", "y"), ["u", "i"]), 3).select(*_six("accuracy"))


@query("r2_eval", f"{_SCORED} SELECT round(1 - sum(pow(p - y, 2)) / sum(pow(y - (SELECT avg(y) FROM predicted), 2)), 6) AS r2 FROM predicted")
def _(spark, d):
    _, test, found = _predicted(spark, d)
    return metrics.r2(found.drop("n").join(test.withColumnRenamed("r", "y"), ["u", "i"])).select(*_six("r2"))


# ---------------------------------------------------------------- features, content and models


@query("user_features", """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_custkey % 97 AS review_count, c_custkey % 7 AS useful, c_custkey % 5 AS funny, c_custkey % 3 AS cool,
  CAST(c_nationkey AS BIGINT) AS fans, c_acctbal AS average_stars, c_custkey % 11 + c_custkey % 13 AS compliments, length(c_mktsegment) AS elite FROM customer""")
def _(spark, d):
    return features.user_features(fx.users(spark, d))


@query("user_features_sums", """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_custkey % 97 AS review_count, c_acctbal AS average_stars, c_custkey % 7 + c_custkey % 5 + c_custkey % 3 AS liked,
  c_custkey % 11 + c_custkey % 13 AS compliments, CAST(c_nationkey AS BIGINT) AS fans, length(c_mktsegment) AS elite FROM customer""")
def _(spark, d):
    return features.user_features(fx.users(spark, d), 2)


@query("user_features_counters", """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_custkey % 97 AS review_count, c_custkey % 7 AS useful, c_custkey % 5 AS funny, c_custkey % 3 AS cool,
  CAST(c_nationkey AS BIGINT) AS fans, c_acctbal AS average_stars, c_custkey % 11 AS compliment_hot, c_custkey % 13 AS compliment_plain, CAST(1 AS BIGINT) AS elite,
  CAST(2022 - (2005 + c_custkey % 15) AS INT) AS years FROM customer""")
def _(spark, d):
    return features.user_features(fx.users(spark, d), 3)


@query("item_features", """SELECT CAST(s_suppkey AS VARCHAR) AS business_id, s_suppkey % 50 AS review_count, s_suppkey % 9 / 2.0::DOUBLE + 0.5 AS stars,
  CASE WHEN s_suppkey % 6 <> 5 THEN CAST(s_suppkey % 4 + 1 AS INT) ELSE 2 END AS price,
  CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS "RestaurantsTakeOut", 0 AS "BusinessAcceptsCreditCards", 0 AS "RestaurantsReservations",
  CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS "HasTV", 0 AS "OutdoorSeating", 0 AS "RestaurantsDelivery",
  CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS "WheelchairAccessible",
  s_suppkey % 2 AS is_open, round((s_acctbal + 180) / 360, 6) AS longitude, 0.5::DOUBLE AS latitude, length(s_name) AS categories FROM supplier""")
def _(spark, d):
    return features.item_features(fx.items(spark, d), 2).withColumn("longitude", F.round("longitude", 6))


_PROFILE = """profile AS MATERIALIZED (SELECT s_suppkey AS i, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS f, unnest([CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 4 <> 1 THEN 1 ELSE 0 END, CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 3 <> 2 THEN 1 ELSE 0 END,
  CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 2 = 0 THEN 1 ELSE 0 END, 0, CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 3 = 0 THEN 1 ELSE 0 END, 0, 0, 0, 0, 0,
  CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 5 = 0 THEN 1 ELSE 0 END]) AS v FROM supplier)"""


@query("content_scores", f"""WITH {_TRAIN}, {_PROFILE}, sums AS MATERIALIZED (SELECT u, f, sum(r * v) AS s FROM train JOIN profile USING (i) GROUP BY 1, 2),
  totals AS (SELECT u, sum(abs(s)) AS total FROM sums GROUP BY 1)
  SELECT t.u, t.i, round(sum(s * v) / nullif(max(total), 0), 6) AS score FROM test t LEFT JOIN profile p ON p.i = t.i LEFT JOIN sums s ON s.u = t.u AND s.f = p.f LEFT JOIN totals o ON o.u = t.u GROUP BY 1, 2""")
def _(spark, d):
    train, test = _split(spark, d)
    shown = fx.items(spark, d)
    profile = features.ambience_profile(shown).join(shown.select("business_id", "i"), "business_id").select("i", "f", "v")
    return features.content_scores(train, profile, test).select("u", "i", *_six("score"))


@query("item_features_basic", """SELECT CAST(s_suppkey AS VARCHAR) AS business_id, s_suppkey % 50 AS review_count, s_suppkey % 9 / 2.0::DOUBLE + 0.5 AS stars FROM supplier""")
def _(spark, d):
    return features.item_features(fx.items(spark, d))


@query("checkin_photo_counts", f"""WITH {fx.SIDES} SELECT CAST(coalesce(c.i, p.i) AS VARCHAR) AS business_id, slots, photos FROM checkins c FULL JOIN photos p ON c.i = p.i""")
def _(spark, d):
    return features.side_counts(*fx.sides(spark, d))[0].select("business_id", F.col("slots").cast("long").alias("slots"), "photos")


@query("tip_likes", f"WITH {fx.SIDES} SELECT CAST(u AS VARCHAR) AS user_id, CAST(i AS VARCHAR) AS business_id, likes FROM tips")
def _(spark, d):
    return features.side_counts(*fx.sides(spark, d))[1]


@query("assembled_features", f"""WITH {_TRAIN}, {fx.SIDES} SELECT t.u, t.i, round(r, 6) AS r, s_suppkey % 50 AS item_reviews, s_suppkey % 9 / 2.0::DOUBLE + 0.5 AS stars,
  CASE WHEN s_suppkey % 6 <> 5 THEN CAST(s_suppkey % 4 + 1 AS INT) ELSE 2 END AS price, slots, photos, c_custkey % 97 AS review_count, c_acctbal AS average_stars,
  c_custkey % 7 + c_custkey % 5 + c_custkey % 3 AS liked, likes FROM train t LEFT JOIN supplier ON s_suppkey = t.i LEFT JOIN customer ON c_custkey = t.u
  LEFT JOIN checkins c ON c.i = t.i LEFT JOIN photos p ON p.i = t.i LEFT JOIN tips x ON x.u = t.u AND x.i = t.i""")
def _(spark, d):
    return _assembled(spark, d, _split(spark, d)[0]).select(
        F.col("user_id").cast("long").alias("u"), F.col("business_id").cast("long").alias("i"), F.round("stars_given", 6).alias("r"),
        "item_reviews", "stars", "price", "slots", "photos", "review_count", "average_stars", "liked", "likes",
    )


def _assembled(spark, d, rated: DataFrame) -> DataFrame:
    """The 23 features of (u, i, r)."""
    ids = [F.col("u").cast("string").alias("user_id"), F.col("i").cast("string").alias("business_id")]
    items = features.item_features(fx.items(spark, d), 2).withColumnRenamed("review_count", "item_reviews")
    by_item, likes = features.side_counts(*fx.sides(spark, d))
    by_item = by_item.withColumn("slots", F.col("slots").cast("long"))
    return features.assemble(rated.select(*ids, F.col("r").alias("stars_given")), features.user_features(fx.users(spark, d), 2), items, (by_item, ["business_id"]), (likes, ["user_id", "business_id"]))


def _learnable(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and test ratings with user and item features and label y."""
    users = features.user_features(fx.users(spark, d)).withColumn("u", F.col("user_id").cast("long")).drop("user_id")
    items = features.item_features(fx.items(spark, d)).withColumn("i", F.col("business_id").cast("long")).drop("business_id").withColumnRenamed("review_count", "item_reviews")
    names = [c for c in [*users.columns, *items.columns] if c not in ("u", "i")]
    train, test = (x.join(users, "u", "left").join(items, "i", "left").withColumnRenamed("r", "y") for x in _split(spark, d))
    return train, test, names


@query("gbt_predictions")
def _(spark, d):
    train, test, names = _learnable(spark, d)
    model = models.boosted_trees(train, names)
    return models.apply(model, test, names).select("u", "i", "p")


@query("als_predictions")
def _(spark, d):
    train, test = _split(spark, d)
    return models.factor_predictions(models.factorise(train), test, train.agg(F.avg("r")).first()[0])


@query("model_selector")
def _(spark, d):
    train, test, names = _learnable(spark, d)
    with_both = lambda x: x.join(train.groupBy("u").agg(F.avg("y").alias("a")), "u").join(train.groupBy("i").agg(F.avg("y").alias("b")), "i")
    model = models.select_model(with_both(train), [*names, "a", "b"])
    return models.select_predictions(model, with_both(test), [*names, "a", "b"]).select("u", "i", "p")


# ---------------------------------------------------------------- graphs

_LABELS = "l0 AS (SELECT DISTINCT src AS node, src AS label FROM both_ways)" + "".join(
    f""", l{k} AS MATERIALIZED (SELECT node, label FROM (SELECT e.src AS node, label, row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, label) AS r
  FROM both_ways e JOIN l{k - 1} l ON l.node = e.dst GROUP BY e.src, label) WHERE r = 1)""" for k in range(1, 6)
)
_REACH = """reach AS (SELECT DISTINCT src AS node, src AS seen FROM both_ways UNION SELECT r.node, e.dst FROM reach r JOIN both_ways e ON e.src = r.seen)"""
_COMPONENTS = f"{_REACH}, components AS MATERIALIZED (SELECT node, min(seen) AS component FROM reach GROUP BY 1)"
DEEP = 24
_LEVELS = "f0 AS MATERIALIZED (SELECT DISTINCT src AS root, src AS node, 0 AS level, 1.0::DOUBLE AS paths FROM both_ways), s0 AS MATERIALIZED (SELECT * FROM f0)" + "".join(
    f""", f{k} AS MATERIALIZED (SELECT f.root, e.dst AS node, {k} AS level, sum(f.paths) AS paths FROM f{k - 1} f JOIN both_ways e ON e.src = f.node
  WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.root = f.root AND s.node = e.dst) GROUP BY 1, 2), s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM f{k})"""
    for k in range(1, DEEP + 1)
)
_STEPS = f"""steps AS MATERIALIZED (SELECT c.root, c.node AS c, c.level, c.paths AS cp, p.node AS p, p.paths AS pp FROM s{DEEP} c JOIN both_ways e ON e.src = c.node
  JOIN s{DEEP} p ON p.root = c.root AND p.node = e.dst AND p.level = c.level - 1), w{DEEP + 1} AS MATERIALIZED (SELECT root, c, p, 0.0::DOUBLE AS flow FROM steps WHERE false)""" + "".join(
    f""", w{k} AS MATERIALIZED (SELECT t.root, t.c, t.p, pp / cp * (1 + coalesce(g.credit, 0)) AS flow FROM steps t
  LEFT JOIN (SELECT root, p, sum(flow) AS credit FROM w{k + 1} GROUP BY 1, 2) g ON g.root = t.root AND g.p = t.c WHERE t.level = {k})"""
    for k in range(DEEP, 0, -1)
)
_FLOWS = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, DEEP + 1))


@query("cograph_edges", f"WITH {fx.EDGES} SELECT src, dst, n FROM edges")
def _(spark, d):
    return fx.edges(spark, d)


@query("degrees", f"WITH {fx.EDGES} SELECT src AS node, count(*) AS degree FROM both_ways GROUP BY 1")
def _(spark, d):
    return graph.degrees(fx.edges(spark, d))


@query("connected_components", f"WITH RECURSIVE {fx.EDGES}, {_COMPONENTS} SELECT node, component FROM components")
def _(spark, d):
    return graph.connected_components(fx.edges(spark, d))


@query("label_propagation_5", f"WITH {fx.EDGES}, {_LABELS} SELECT node, label FROM l5")
def _(spark, d):
    return graph.label_propagation(fx.edges(spark, d))


@query("shortest_path_counts", f"WITH {fx.EDGES}, {_LEVELS} SELECT root, node, level, paths FROM s{DEEP}")
def _(spark, d):
    return graph.shortest_paths(fx.edges(spark, d))


@query("edge_betweenness", f"WITH {fx.EDGES}, {_LEVELS}, {_STEPS} SELECT least(c, p) AS src, greatest(c, p) AS dst, round(sum(flow) / 2, 6) AS score FROM ({_FLOWS}) GROUP BY 1, 2")
def _(spark, d):
    return graph.edge_betweenness(fx.edges(spark, d)).select("src", "dst", *_six("score"))


@query("modularity", f"""WITH RECURSIVE {fx.EDGES}, {_COMPONENTS}, k AS (SELECT src AS node, count(*) AS k FROM both_ways GROUP BY 1), m AS (SELECT count(*) / 2 AS m FROM both_ways)
  SELECT round(sum(CASE WHEN e.src IS NULL THEN 0 ELSE 1 END - a.k * b.k / (2 * (SELECT m FROM m))) / (2 * (SELECT m FROM m)), 6) AS q
  FROM components x JOIN components y ON x.component = y.component AND x.node < y.node JOIN k a ON a.node = x.node JOIN k b ON b.node = y.node
  LEFT JOIN both_ways e ON e.src = x.node AND e.dst = y.node""")
def _(spark, d):
    edges = cut(fx.edges(spark, d))
    return graph.modularity(graph.connected_components(edges), edges).select(*_six("q"))


@query("girvan_newman")
def _(spark, d):
    return graph.girvan_newman(fx.edges(spark, d))


# ---------------------------------------------------------------- clustering

_DIMS = "unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v"
_SUMS = f"summary AS MATERIALIZED (SELECT label AS cluster, CAST(dim AS INT) AS dim, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM (SELECT label, {_DIMS} FROM embeddings) GROUP BY 1, 2)"


def _by_label(spark, d) -> DataFrame:
    return clustering.summaries(fx.points(spark, d).withColumn("cluster", F.col("label").cast("long")))


@query("cluster_summaries", f"WITH {_SUMS} SELECT CAST(cluster AS BIGINT) AS cluster, dim, n, round(s, 6) AS s, round(ss, 6) AS ss FROM summary")
def _(spark, d):
    return _by_label(spark, d).select("cluster", "dim", "n", *_six("s", "ss"))


@query("mahalanobis_assign", f"""WITH {_SUMS}, centre AS MATERIALIZED (SELECT cluster, dim, s / n AS c, sqrt(greatest(ss / n - (s / n) * (s / n), 0)) AS sd FROM summary),
  cells AS (SELECT vec_id AS id, {_DIMS} FROM embeddings), far AS (SELECT id, cluster, sqrt(sum(pow((v - c) / sd, 2))) AS d FROM cells JOIN centre USING (dim) GROUP BY 1, 2)
  SELECT id, CAST(coalesce(min(CASE WHEN d < 16 THEN cluster END), -1) AS BIGINT) AS cluster FROM far GROUP BY 1""")
def _(spark, d):
    return clustering.assign(fx.points(spark, d), clustering.centres(_by_label(spark, d)), 64).select("id", "cluster")


_CELLS = """cells AS MATERIALIZED (SELECT label, vec_id % 7 AS cluster, count(*) AS n FROM embeddings GROUP BY 1, 2)"""


def _grouped(spark, d) -> DataFrame:
    """Points with a cluster that partly follows their label."""
    return fx.points(spark, d).withColumn("cluster", F.col("id") % 7)


@query("cluster_contingency", f"WITH {_CELLS} SELECT label, cluster, n FROM cells")
def _(spark, d):
    return clustering.contingency(_grouped(spark, d))


@query("cluster_quality", f"""WITH {_CELLS}, c AS (SELECT label, sum(n) AS n FROM cells GROUP BY 1), k AS (SELECT cluster, sum(n) AS n FROM cells GROUP BY 1), t AS (SELECT sum(n) AS n FROM cells)
  SELECT round((SELECT sum(n) FROM cells WHERE label = cluster) / (SELECT n FROM t), 6) AS accuracy,
  round(1 - (SELECT sum(cells.n / t.n * ln(cells.n / c.n)) FROM cells JOIN c USING (label), t) / (SELECT sum(k.n / t.n * ln(k.n / t.n)) FROM k, t), 6) AS completeness""")
def _(spark, d):
    return clustering.quality(_grouped(spark, d)).select(*_six("accuracy", "completeness"))


@query("bfr_rounds")
def _(spark, d):
    return clustering.bfr(fx.points(spark, d), 10, 64)[0]


@query("bfr_labels")
def _(spark, d):
    return clustering.bfr(fx.points(spark, d), 10, 64)[1]


# ---------------------------------------------------------------- streams

_MOD = "list_reduce(list_prepend(0::BIGINT, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(value, '')]), lambda a, b: (a * 256 + b) % {m})"
_BLOOM = hashing.prime_family(sketches.LAYERS)


@query("text_hash", f"WITH {fx.STREAM} SELECT seq, {_MOD.format(m=sketches.BITS)} AS h FROM stream")
def _(spark, d):
    return fx.stream(spark, d).select("seq", hashing.text_mod(F.col("value"), sketches.BITS).alias("h"))


@query("bloom_fpr", f"""WITH {fx.STREAM}, hashed AS MATERIALIZED (SELECT batch, value, {_MOD.format(m=sketches.BITS)} AS x FROM stream),
  cells AS MATERIALIZED (SELECT batch, value, unnest([0, 1, 2]) AS layer, unnest([{', '.join(f'(x * {a} + {b}) % {sketches.BITS}' for a, b in _BLOOM)}]) AS bit FROM hashed),
  first AS (SELECT layer, bit, min(batch) AS t FROM cells GROUP BY 1, 2), seen AS (SELECT value, min(batch) AS t FROM hashed GROUP BY 1),
  judged AS (SELECT c.batch, c.value, max(f.t) AS t FROM cells c JOIN first f ON f.layer = c.layer AND f.bit = c.bit GROUP BY 1, 2)
  SELECT h.batch, count(*) AS n, count(*) FILTER (WHERE j.t < h.batch AND s.t >= h.batch) AS false_positives,
  round(count(*) FILTER (WHERE j.t < h.batch AND s.t >= h.batch) / count(*), 6) AS fpr
  FROM hashed h JOIN judged j ON j.batch = h.batch AND j.value = h.value JOIN seen s ON s.value = h.value GROUP BY 1""")
def _(spark, d):
    return sketches.bloom_fpr(fx.stream(spark, d)).withColumn("fpr", F.round("fpr", 6))


_BITS = ", ".join(f"(x * {a} + {b}) % {sketches.BITS} % 2" for a, b in hashing.family(100))


@query("fm_estimate", f"""WITH {fx.STREAM}, hashed AS MATERIALIZED (SELECT batch, value, {_MOD.format(m=sketches.BITS)} AS x FROM stream),
  zeros AS (SELECT batch, value, coalesce(list_position(list_reverse([{_BITS}]), 1) - 1, 100) AS z FROM hashed)
  SELECT batch, count(DISTINCT value) AS truth, pow(2.0, max(z)) AS estimate FROM zeros GROUP BY 1""")
def _(spark, d):
    return sketches.fm_estimate(fx.stream(spark, d))


def _uniform_sql(seed: int) -> str:
    x = f"(seq + {seed})"
    for a, b in ((48271, 11), (69621, 7919), (16807, 104729)):
        x = f"(({a} * {x} + {b}) % {hashing.PRIME})"
    return f"({x} / {float(hashing.PRIME)}::DOUBLE)"


@query("reservoir_slots", f"""WITH {fx.STREAM}, accepted AS MATERIALIZED (SELECT seq, batch, value, CAST(CASE WHEN seq < 100 THEN seq ELSE floor({_uniform_sql(553 + 1_000_003)} * 100) END AS BIGINT) AS slot
  FROM stream WHERE seq < 100 OR {_uniform_sql(553)} < 100.0::DOUBLE / (seq + 1))
  SELECT b.batch, a.slot, arg_max(a.value, a.seq) AS value FROM (SELECT DISTINCT batch FROM stream) b JOIN accepted a ON a.batch <= b.batch WHERE a.slot IN (0, 20, 40, 60, 80) GROUP BY 1, 2""")
def _(spark, d):
    return sketches.reservoir_slots(fx.stream(spark, d))


@query("stream_sample", """WITH ranked AS (SELECT event_type AS value, row_number() OVER (ORDER BY event_id) - 1 AS rank FROM events),
  asked AS (SELECT range AS seq, range // 100 AS batch, ((range + 553) * 1103515245 + 12345) % (SELECT count(*) FROM events) AS rank FROM range(3000))
  SELECT seq, batch, value FROM asked JOIN ranked USING (rank)""")
def _(spark, d):
    return readers.draw(fx.table(spark, d, "events"), "event_id", "event_type", batch=100, batches=30)
