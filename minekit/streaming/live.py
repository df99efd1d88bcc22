"""Live sketches on Structured Streaming: micro-batches fold into state tables, and give the rows of the batch definitions.

A stream has a folder of its own, named by the caller and the source: the checkpoint of
what was read, and tables of what came of it, a part for each micro-batch.  A fold reads
the parts of earlier micro-batches and replaces its own, so a micro-batch that runs again
changes nothing, and a stream that is stopped goes on where it was, with a new object or
on another driver.  Nothing is kept in the process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.functions import hashing
from minekit.operators import sketches
from minekit.plans.iterate import shared_dir


def read_stream(spark: SparkSession, path: str, schema: str = "seq long, batch long, value string", per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


class Folder:
    """A stream's folder, ``name`` and source together: another source under the same name is another stream."""

    def __init__(self, spark: SparkSession, name: str, source: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/minekit-stream-{name}-{hashlib.md5(source.encode()).hexdigest()[:12]}"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def put(self, what: str, epoch: int, rows: DataFrame) -> DataFrame:
        """Replace the part of a micro-batch; the rows as written."""
        path = f"{self.root}/{what}/epoch={epoch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def before(self, what: str, epoch: int | None, schema: str) -> DataFrame:
        """The parts of micro-batches before ``epoch`` (None: all), with a column ``epoch``."""
        try:
            rows = self.spark.read.schema(f"{schema}, epoch int").parquet(f"{self.root}/{what}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, epoch int")
        return rows if epoch is None else rows.filter(F.col("epoch") < epoch)


def run(stream: DataFrame, fold: Callable[[DataFrame, int], None], folder: Folder) -> None:
    """All that the source has now, a micro-batch at a time; a restart goes on from the folder's checkpoint."""
    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", folder.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class LiveBloom:
    """Bits of each layer and seen values, by the micro-batch that brought them; a batch is checked before it is added."""

    BITS, SEEN, RESULT = "layer int, bit long", "value string", "batch long, n long, false_positives long, fpr double"

    def __init__(self, folder: Folder, seed: int = 553, bits: int = sketches.BITS, layers: int = sketches.LAYERS):
        self.folder, self.coefficients, self.bits = folder, hashing.prime_family(layers, seed), bits

    def fold(self, rows: DataFrame, epoch: int) -> None:
        rows = rows.select("batch", "value").persist()
        set_, seen = (self.folder.before(*x) for x in (("bits", epoch, self.BITS), ("seen", epoch, self.SEEN)))
        cells = rows.select("value").distinct().select("value", F.posexplode(sketches.bloom_bits(F.col("value"), self.coefficients, self.bits)).alias("layer", "bit"))
        cells = cells.select("value", F.col("layer").cast("int").alias("layer"), "bit")
        hits = cells.join(set_, ["layer", "bit"], "left_semi").groupBy("value").agg(F.count("*").alias("k")).filter(F.col("k") == len(self.coefficients))
        wrong = hits.join(seen, "value", "left_anti").select("value", F.lit(1).alias("wrong"))
        result = rows.join(wrong, "value", "left").groupBy("batch").agg(F.count("*").alias("n"), F.count("wrong").alias("false_positives"))
        self.folder.put("results", epoch, result.withColumn("fpr", F.col("false_positives") / F.col("n")))
        # Only what is new: a part never holds what earlier ones do.
        self.folder.put("bits", epoch, cells.select("layer", "bit").distinct().join(set_, ["layer", "bit"], "left_anti"))
        self.folder.put("seen", epoch, rows.select("value").distinct().join(seen, "value", "left_anti"))
        rows.unpersist()

    def results(self) -> DataFrame:
        return self.folder.before("results", None, self.RESULT).drop("epoch")


class LiveReservoir:
    """The slots (slot, seq, value) after each micro-batch: its last entries replace them."""

    SLOTS = "slot long, seq long, value string"

    def __init__(self, folder: Folder, size: int = 100, seed: int = 553):
        self.folder, self.size, self.seed = folder, size, seed

    def slots(self, before: int | None = None) -> DataFrame:
        """The slots now, or before a micro-batch; of ``size`` rows at most."""
        all_ = self.folder.before("slots", before, self.SLOTS)
        last = all_.agg(F.max("epoch")).first()[0]
        return all_.filter(F.col("epoch") == (-1 if last is None else last)).drop("epoch")

    def fold(self, rows: DataFrame, epoch: int) -> None:
        new = sketches.reservoir_accepted(rows, self.size, self.seed).select("slot", "seq", "value")
        both = self.slots(epoch).unionByName(new).groupBy("slot").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
        self.folder.put("slots", epoch, both)


class LiveDistinct:
    """Flajolet-Martin by batch: the most trailing zeros of its values, and its distinct values, by micro-batch."""

    ZEROS = "batch long, zeros int"

    def __init__(self, folder: Folder, n: int = 100, seed: int = 553, p: int = sketches.BITS):
        self.folder, self.coefficients, self.p = folder, hashing.family(n, seed), p

    def fold(self, rows: DataFrame, epoch: int) -> None:
        zeros = sketches.trailing_zeros(hashing.text_mod(F.col("value"), self.p), self.coefficients, self.p)
        self.folder.put("zeros", epoch, rows.groupBy("batch").agg(F.max(zeros).cast("int").alias("zeros")))

    def estimates(self) -> DataFrame:
        """(batch, estimate): maxima merge, so a batch may come in several micro-batches."""
        return self.folder.before("zeros", None, self.ZEROS).groupBy("batch").agg(F.pow(F.lit(2.0), F.max("zeros")).alias("estimate"))


def fm_by_window(stream: DataFrame, at: str, window: str = "5 minutes", late: str = "10 minutes", n: int = 100, seed: int = 553, p: int = sketches.BITS) -> DataFrame:
    """Flajolet-Martin and HyperLogLog estimates by event-time window, late rows up to the watermark."""
    zeros = sketches.trailing_zeros(hashing.text_mod(F.col("value"), p), hashing.family(n, seed), p)
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, window)).agg(F.pow(F.lit(2.0), F.max(zeros)).alias("estimate"), F.approx_count_distinct("value").alias("hll"))
