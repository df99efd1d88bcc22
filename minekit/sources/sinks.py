"""Sinks: metrics as JSON, CSV with header, and the text reports of each analysis.

Reports are built as one column of lines in order; a single writer keeps that order.  A
line of an itemset report holds all sets of a size, and one of a community report all its
nodes, so these reports are for results that a person reads; ``write_csv`` has no such bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The rows (one, mostly) as JSON objects."""
    metrics.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, *order: Column | str) -> None:
    """CSV with header, in the given order."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", True).csv(path)


def write_means(means: DataFrame, path: str, place: str = "city", mean: str = "stars") -> None:
    """place,mean lines under their header as one file, greatest mean first, then by place."""
    named = means.select(F.col(means.columns[0]).alias(place), F.col(means.columns[1]).alias(mean))
    named.orderBy(F.desc(mean), place).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_features(rows: DataFrame, path: str, *order: Column | str) -> None:
    """CSV with header of a feature table: arrays and vectors become a column for each element, x_0, x_1, ...

    All rows of such a column must have as many elements as the first row has.
    """
    from pyspark.ml.functions import vector_to_array

    first = rows.first()
    columns = []
    for name, kind in rows.dtypes:
        if kind == "vector" or kind.startswith("array"):
            values = vector_to_array(F.col(name)) if kind == "vector" else F.col(name)
            columns += [values[k].alias(f"{name}_{k}") for k in range(len(first[name]) if first else 0)]
        else:
            columns.append(F.col(name))
    write_csv(rows.select(*columns), path, *order)


def write_similar(pairs: DataFrame, path: str) -> None:
    """business_id_1,business_id_2,similarity lines of (a, b, similarity) under their header, by pair."""
    named = pairs.select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), "similarity")
    write_csv(named, path, "business_id_1", "business_id_2")


def write_predictions(rows: DataFrame, path: str) -> None:
    """user_id,business_id,prediction lines of (u, i, p) under their header."""
    write_csv(rows.select(F.col("u").alias("user_id"), F.col("i").alias("business_id"), F.col("p").alias("prediction")), path)


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def _as_tuple(items: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(items, _quoted), ", "), F.lit(")"))


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """(n, line): both lists by size, ('x') for single items, a blank line after each size."""

    def section(sets: DataFrame, title: str, at: int) -> DataFrame:
        lines = sets.select(F.size("itemset").alias("k"), _as_tuple(F.col("itemset")).alias("s")).groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("s")), ",").alias("line"))
        body = lines.select((F.lit(at) + F.col("k") * 2).alias("n"), "line").unionByName(lines.select((F.lit(at) + F.col("k") * 2 + 1).alias("n"), F.lit("").alias("line")))
        head = sets.sparkSession.createDataFrame([(at, title)], "n int, line string")
        return head.unionByName(body)

    return section(candidates, "Candidates:", 0).unionByName(section(frequent, "Frequent Itemsets:", 1_000_000)).orderBy("n")


def community_report(members: DataFrame, community: str = "component") -> DataFrame:
    """(size, line): 'a', 'b' lines of each community's nodes, by size, then first member."""
    lists = members.groupBy(community).agg(F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("m"))
    return lists.select(F.size("m").alias("size"), F.array_join(F.transform("m", _quoted), ", ").alias("line")).orderBy("size", "line").select("size", "line")


def betweenness_report(scores: DataFrame) -> DataFrame:
    """(line): ('a', 'b'),score with five digits, greatest first."""
    text = F.concat(_as_tuple(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))), F.lit(","), F.round("score", 5).cast("string"))
    return scores.orderBy(F.desc("score"), "src", "dst").select(text.alias("line"))


def cluster_report(rounds: DataFrame, labels: DataFrame) -> DataFrame:
    """(n, line): Round i: a,b,c,d lines, a blank line, then id,label lines by id."""
    top = rounds.select(F.col("round").cast("long").alias("n"), F.concat(F.lit("Round "), "round", F.lit(": "), F.concat_ws(",", "n_ds", "n_cs", "in_cs", "n_rs")).alias("line"))
    blank = rounds.sparkSession.createDataFrame([(10**9, "")], "n long, line string")
    rest = labels.select((F.lit(2 * 10**9) + F.col("id")).cast("long").alias("n"), F.concat_ws(",", "id", "cluster").alias("line"))
    return top.unionByName(blank).unionByName(rest).orderBy("n")


def write_report(report: DataFrame, path: str) -> None:
    """The ``line`` column as one text file, in order."""
    report.select("line").coalesce(1).write.mode("overwrite").text(path)


def write_model(model, path: str) -> None:
    """A fitted pipeline or model, to be loaded again with its class."""
    model.write().overwrite().save(path)
