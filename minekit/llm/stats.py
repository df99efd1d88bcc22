"""Text statistics of whole documents, for the quality operators.

Every statistic of null or empty text is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.llm.common import WORD, Scratch, map_arrow, need, texts_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the models see; each is a share, a mean or a logarithm, so that sizes compare.
FEATURES = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "top_word_share",
    "upper_share", "digit_share", "punct_share", "space_share", "bang_share", "bar_share", "words_per_line", "ascii_share",
]
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def repeat_words(words: list[str]) -> int:
    """Words in 5-word windows found twice or more, first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k, m in enumerate(_MULTIPLIERS):
        windows = (windows + ids[k : k + n]) * m
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(len(words) + 1, np.int64)
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    starts[at] += 1
    np.subtract.at(starts, at + WINDOW, 1)
    return int((np.cumsum(starts) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def describe(text: str) -> tuple[list[int], list[float]]:
    """The counts and the features of a text."""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols, repeats, dups = sum(map(text.count, SYMBOLS)), repeat_words(words), dup_lines(text)
    if not n:
        return [n, chars, symbols, dups, repeats], [0.0] * len(FEATURES)
    seen = Counter(words)
    data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    total = max(1, int(data.sum()))
    letters = data[65:91].sum() + data[97:123].sum() + data[128:].sum()
    lines = text.count("\n") + 1
    return [n, chars, symbols, dups, repeats], [
        float(np.log1p(n)), chars / n, symbols / max(1, chars), dups / lines, repeats / n, len(seen) / n, seen.most_common(1)[0][1] / n,
        data[65:91].sum() / max(1, letters), data[48:58].sum() / total, (data[33:48].sum() + data[58:65].sum()) / total,
        1 - chars / len(text), data[33] / total, data[124] / total, float(np.log1p(n / lines)), data[:128].sum() / total,
    ]


def measured(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The counts and the features of texts, a row each."""
    rows = [describe(x) for x in texts]
    return np.array([x[0] for x in rows], np.int64).reshape(-1, len(COUNTS)), np.array([x[1] for x in rows], float).reshape(-1, len(FEATURES))


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, the counts (long) and the features (double) of every text."""
    chosen = need(docs, *dict.fromkeys([*keep, "text"]))
    schema = T.StructType(
        [chosen.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in FEATURES]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, features = measured(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(x) for x in (*counts.T, *features.T)], names=[*keep, *COUNTS, *FEATURES])

    return map_arrow(chosen, run, schema)


#: Rows that one task of ``at_places`` orders, about.
RANGE_ROWS = 1 << 18


def at_places(rows: DataFrame, places: np.ndarray, total: int, scratch: Scratch) -> pd.DataFrame:
    """The rows at ``places`` (from 0, ascending) of all ``total`` rows in the order of their columns.

    Equal rows are counted before they are ordered, and ranges of the order are sorted each
    by itself; only the rows asked for and a row for each range come to the driver.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("copies"))
    n = -(-total // RANGE_ROWS)
    schema = T.StructType([*counted.schema.fields, T.StructField("start", T.LongType()), T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            copies = batch.column("copies").to_numpy()
            ends = start + np.cumsum(copies)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - copies), pa.array(np.full(len(copies), part, np.int32))], names=schema.names)
            start = int(ends[-1])

    made = scratch.write(map_arrow(counted.repartitionByRange(n, *names).sortWithinPartitions(*names), run, schema), "ordered")
    base, before = {}, 0
    for part, end in sorted(made.groupBy("part").agg(F.max(F.col("start") + F.col("copies"))).collect()):
        base[part] = before
        before += end

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column("start").to_numpy() + np.array([base[x] for x in batch.column("part").to_pylist()])
            first, beyond = np.searchsorted(places, start), np.searchsorted(places, start + batch.column("copies").to_numpy())
            times = np.maximum(beyond - first, 0)
            at = np.repeat(np.arange(len(times)), times)
            if len(at):
                which = np.repeat(first, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in names), pa.array(places[which])], names=[*names, "place"])

    found = map_arrow(made, hit, T.StructType([*(made.schema[c] for c in names), T.StructField("place", T.LongType())])).toPandas()
    scratch.drop(made)
    return found.sort_values("place").drop(columns="place")


def labelled(labels: DataFrame, label: str, *, keep_row=None) -> DataFrame:
    """(doc_id, label): a row for each document with a label."""
    chosen = need(labels, "doc_id", label).filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if keep_row is not None:
        chosen = chosen.filter(keep_row)
    return chosen.groupBy("doc_id").agg(F.max(label).alias(label))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, *, keep_row=None) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents, those of the smallest hash of doc_id."""
    chosen = labelled(labels, label, keep_row=keep_row).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # ``rows`` of two numbers at most: bounded, so no text is shuffled.
    return need(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")


def remainder(column: str, by: int):
    """crc32 of the column as text, modulo ``by``; null where the column is."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))
