"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Rows and bytes of one Arrow batch: long texts must not add up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, for every operator that hands texts to Python.

    The session keeps the lower settings: frames are evaluated later, and only these bound
    them then.  Settings that are lower already stay.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text in a range that one task orders and writes, about.
RANGE_BYTES = 128 << 20


def ranges_of(docs: DataFrame) -> int:
    """Ranges of ``docs`` (text): as many as shuffle partitions, and more where these would hold over ``RANGE_BYTES`` each."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // RANGE_BYTES))


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a folder of our own in local mode; an error elsewhere, since
    executors would not see the driver's folder.
    """
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="minekit-")
    return _own_dir


class Scratch:
    """Tables written once to the shared folder and read again: lineage ends there, and lost executors lose nothing."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/minekit-{what}-{uuid.uuid4().hex}"
        self.n, self.paths = 0, set()
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for x in frames:
            self._delete(getattr(x, "_scratch_path", None))

    def drop_but(self, *frames: DataFrame) -> None:
        """Delete every table but those of ``frames``, once nothing reads the others any more."""
        for path in self.paths - {x._scratch_path for x in frames}:
            self._delete(path)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str | None) -> None:
        if not path or self.spark.sparkContext._jsc is None:
            return
        jvm = self.spark.sparkContext._jvm
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended, and its folder goes with the cluster's cleaner
            return


def release() -> None:
    """Hand memory that nothing uses back to the system: a worker stays for later tasks, and others run beside it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with ``run``, which gets small batches, none of them empty; memory goes back at the end of each task."""
    bound_batches(df.sparkSession)

    def with_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(x for x in batches if x.num_rows)
        finally:
            release()

    return df.mapInArrow(with_release, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names do no harm."""
    return df.select(*[F.col(x) for x in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
