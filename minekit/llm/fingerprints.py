"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every 5-word shingle hash below 2^64 / SCALE, so that a document's
sketch grows with it, sketches of parts merge by union, and the share of one sketch in
another estimates containment whatever the two sizes.  A document none of whose hashes
is below the threshold keeps its smallest.

``likeness`` of two sketches is |both| / smaller, the larger of the two containments.
It is 1 for equal texts; two texts without words are alike (1), and such a text is
unlike any other (0).

Defined cases: null counts as empty text; rows of equal doc_id are ordered by text;
rows of a null doc_id come first; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm.common import map_arrow, need, ranges_of, table
from minekit.llm.near_dup import shingle_set

WIDTH, SCALE = 5, 4
THRESHOLD = np.uint64(2**64 // SCALE)


def sketch(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes that a text's sketch keeps."""
    hashes = shingle_set(text, width)
    kept = hashes[hashes < THRESHOLD]
    return kept if len(kept) else hashes[:1]


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of several texts' shingles together."""
    both = np.unique(np.concatenate(sketches)) if sketches else np.zeros(0, np.uint64)
    kept = both[both < THRESHOLD]
    return kept if len(kept) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b holds."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else float(not len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return containment(*sorted((a, b), key=len))


def encoded(x: np.ndarray) -> str:
    return base64.b64encode(x.astype("<u8").tobytes()).decode()


def decoded(x: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(x), "<u8")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encoded(sketch(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return map_arrow(need(docs, "doc_id", "text"), run, "doc_id long, fingerprint string")


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` dealt once into ascending ranges of doc_id, each with the first document of the next: range, doc_id, text.

    Range bounds are doc_ids (a quantile sketch; one number a range reaches the
    driver).  The first document of each range also goes to the end of the range before
    it, and that of the first range to the end of the last, so each task sees every
    document of its range with its successor.
    """
    spark = docs.sparkSession
    chosen = need(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    n = ranges_of(chosen)
    least, inner, nulls = docs.agg(
        F.min("doc_id"), F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * n), F.count_if(F.col("doc_id").isNull())
    ).first()
    if least is None and not nulls:
        return chosen.select(F.lit(0).alias("range"), "doc_id", "text", F.lit(False).alias("borrowed"))
    firsts = sorted({least, *inner} - {None}) if least is not None else []
    # A null doc_id stands before all others; its rows make the first range, should there be any.
    bounds = firsts if not nulls else [None, *firsts]
    edges = spark.sparkContext.broadcast(np.array(firsts, np.int64))
    shift = int(bool(nulls))

    @F.pandas_udf("int")
    def place(ids):
        import pandas as pd

        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(edges.value, ids[known].astype("int64"), "right") - 1 + shift
        return pd.Series(out)

    placed = chosen.withColumn("range", place("doc_id"))
    # The single row that each range lends: its first by (doc_id, text).
    leads = F.col("doc_id").isin(firsts) | F.col("doc_id").isNull()
    count = len(bounds)
    copies = F.when(leads, F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("borrowed")), F.struct(F.pmod(F.col("range") - 1, F.lit(count)).cast("int").alias("at"), F.lit(True).alias("borrowed")))).otherwise(
        F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("borrowed")))
    )
    dealt = placed.select("doc_id", "text", F.explode(copies).alias("c")).select(F.col("c.at").alias("range"), "doc_id", "text", F.col("c.borrowed").alias("borrowed"))
    return dealt.repartitionById(n, F.pmod("range", F.lit(n))).sortWithinPartitions("range", "borrowed", F.col("doc_id").asc_nulls_first(), "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, of texts whose second half is the start of the next document, and their likeness."""
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc, text: str, own: np.ndarray, after: str, following: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        other = own if edited == text else sketch(edited)
        return doc, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), encoded(own), encoded(other), likeness(own, other), likeness(own, following)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, sketch) of the document before
        for batch in batches:
            rows = []
            for at, doc, text, borrowed in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "text", "borrowed")), strict=True):
                if held is None or held[0] != at:
                    if not borrowed:
                        held = (at, doc, text, sketch(text))
                    continue
                made = sketch(text)
                rows.append(row(*held[1:], text, made))
                # Of equal doc_ids that a range lends, the first alone follows its last document.
                held = None if borrowed else (at, doc, text, made)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=columns)

    return map_arrow(
        in_ranges(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_edits(table(spark, sf_dir, "documents"))
