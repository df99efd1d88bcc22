"""Loops over DataFrames: each step ends in a table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; in local mode alone, else a folder of our own."""
    global _own
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own = _own or "file://" + tempfile.mkdtemp(prefix="minekit-")
    return _own


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage; the table goes with ``drop``, or when the process ends."""
    path = f"{shared_dir(df.sparkSession)}/minekit-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _left[path] = df.sparkSession
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``cut`` returned and that nothing reads any more."""
    for path in {getattr(x, "_cut_path", None) for x in frames} - {None}:
        delete(_left.pop(path, None), path)


def delete(spark: SparkSession | None, path: str) -> None:
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended, and its folder goes with the cluster's cleaner
        return


@atexit.register
def _clear() -> None:
    for path, spark in list(_left.items()):
        delete(spark, path)


def numbered(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``rows`` with dense numbers from 0 (long) in the given order.

    Ranges of the order are sorted each by itself and offset by the counts of the ranges
    before, a row for each range, so that no task sees all rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, own = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    bases, total = [], 0
    for p in sorted(counts):
        bases.append((p, total))
        total += counts[p]
    base = F.broadcast(rows.sparkSession.createDataFrame(bases, "__part long, __base long"))
    return placed.withColumn("__part", part).join(base, "__part").withColumn(name, F.col("__base") + own).drop("__part", "__base", "__at")
