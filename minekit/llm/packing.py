"""Best-fit packing of token sequences by bin completion.

Pieces of one length are alike, so the search runs on the histogram of lengths, at
most ``capacity`` numbers whatever the corpus.  The first incumbent is best-fit
decreasing.  If it misses the lower bound, bins are completed around the largest length
left: undominated fillings are enumerated, the one of least waste first, and a found
filling is repeated as often as its lengths last.  Depth-first branch and bound tries
other fillings, cutting branches whose waste cannot beat the incumbent, until the bound
is met or ``NODES`` nodes are spent; all pieces are packed in any case, and the budgets
``FILLINGS``, ``STEPS`` and ``NODES`` only bound how long fewer sequences are sought.

The n-th piece of each length then takes the n-th place for that length.  Its number
comes from counts by (chunk, length) with prefix sums, so that no length, however
common, gathers in one task.

Defined cases: null or empty text is its end id alone; equal rows are separate
pieces; an empty table packs to no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minekit.llm.common import Scratch, map_arrow, need, table
from minekit.llm.token_files import crc32_of_ids
from minekit.llm.tokens import encoder

CAPACITY = 2048
#: Fillings kept for a bin, steps of one enumeration, and nodes of the search beyond the first descent.
FILLINGS, STEPS, NODES = 4, 600, 2000
#: Pieces in a chunk of the numbering, about.
CHUNK = 2000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fillings(lengths: list[int], left: dict[int, int], room: int, most: int = FILLINGS, steps: int = STEPS) -> list[tuple[int, ...]]:
    """Undominated multisets of ``lengths`` (descending, ``left`` of each) that fit ``room``; least waste first.

    A filling is dominated where a further length still fits, or where one of its
    lengths can be swapped for a longer one within the waste.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [steps]

    def dominated(chosen: list[int], waste: int) -> bool:
        for x in set(chosen):
            for y in range(x + 1, x + waste + 1):
                if left.get(y, 0) > chosen.count(y):
                    return True
        return False

    def walk(start: int, room: int, chosen: list[int]) -> bool:
        """True: stop, an exact filling is known for each that is wanted."""
        budget[0] -= 1
        fits = False
        for i in range(start, len(lengths)):
            x = lengths[i]
            if x > room or left[x] <= chosen.count(x):
                continue
            fits = True
            if budget[0] <= 0 and found:
                return True
            chosen.append(x)
            stop = walk(i, room - x, chosen)
            chosen.pop()
            if stop:
                return True
        if not fits and (room == 0 or not dominated(chosen, room)):
            found.append((room, tuple(chosen)))
            if room == 0 and sum(w == 0 for w, _ in found) >= most:
                return True
        return budget[0] <= 0 and bool(found)

    walk(0, room, [])
    found.sort(key=lambda x: (x[0], [-y for y in x[1]]))
    return [x for _, x in found[:most]] or [()]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths in a bin, number of such bins)."""
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left: bins of one content, and how many
    out: list[tuple[tuple[int, ...], int]] = []

    def put(whole: tuple[int, ...], times: int, room: int) -> None:
        if times:
            free.setdefault(room, []).append((whole, times)) if room else out.append((whole, times))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            rooms = [r for r in free if r >= x]
            if not rooms:
                each = capacity // x
                put((x,) * each, n // each, capacity - each * x)
                put((x,) * (n % each), int(n % each > 0), capacity - n % each * x)
                break
            room = min(rooms)
            whole, times = free[room].pop()
            used = min(n, times)
            put(whole, times - used, room)
            if not free[room]:
                del free[room]
            put((*whole, x), used, room - x)
            n -= used
    return out + [x for same in free.values() for x in same]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins): as few bins as the search finds."""
    counts = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    bound, best = -(-total // capacity), best_fit(counts, capacity)
    best_bins, descended = sum(n for _, n in best), False
    if best_bins == bound:
        return best

    def choices(left: dict[int, int], first: bool) -> list[tuple[tuple[int, ...], int]]:
        lengths = sorted(left, reverse=True)
        top = lengths[0]
        left[top] -= 1
        options = fillings(lengths, left, capacity - top, 1 if first else FILLINGS)
        left[top] += 1
        out = []
        for x in options:
            whole = (top, *x)
            out.append((whole, min(left[y] // whole.count(y) for y in set(whole))))
        return out

    # Each level: what is left, bins so far, options not yet tried, the option taken.
    stack, spent = [(counts, 0, None)], 0
    path: list[tuple[tuple[int, ...], int]] = []
    while stack:
        left, bins, options = stack.pop()
        path = path[: len(stack)]
        if options is None:
            if not left:
                descended = True
                if bins < best_bins:
                    best, best_bins = list(path), bins
                if best_bins == bound:
                    break
                continue
            spent += descended
            if spent > nodes:
                break
            if bins + -(-sum(k * v for k, v in left.items()) // capacity) >= best_bins:
                continue
            options = choices(left, not descended)
        if not options:
            continue
        (whole, times), *rest = options
        stack.append((left, bins, rest))
        path.append((whole, times))
        after = dict(left)
        for y in set(whole):
            after[y] -= whole.count(y) * times
            if not after[y]:
                del after[y]
        stack.append((after, bins + times, None))
    return best


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first number, uses in a bin, first bin, offset of the first use), ascending.

    A pattern has few distinct lengths, and each pattern uses up a length or a group of
    like bins, so the rows are bounded by the capacity, not by the corpus.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for whole, times in patterns:
        offset = 0
        for x in sorted(set(whole), reverse=True):
            n = whole.count(x)
            out.setdefault(x, []).append((used.get(x, 0), n, first, offset))
            used[x] = used.get(x, 0) + n * times
            offset += n * x
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def cut(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Encode whole texts and cut what is longer than ``capacity``: a row for each piece, without its ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end, step = np.array([end_id], enc.dtype).tobytes(), capacity * enc.width
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, value in zip(rows, (doc, k, at // enc.width, len(part) // enc.width, crc32_of_ids(part, enc.width)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    return map_arrow(need(docs, "doc_id", "text"), run, PIECE_SCHEMA)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """The pieces of ``docs`` with their sequence_id and offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(cut(docs, capacity=capacity, end_id=end_id, vocabulary=vocabulary), "pieces")
    # At most ``capacity`` rows.
    counts = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = runs(pack_histogram(counts, capacity))
    chunks = max(1, sum(counts.values()) // CHUNK)

    chunked = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        chunked.groupBy("chunk", "length").agg(F.count("*").alias("n"))
        .select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    own = Window.partitionBy("chunk", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = (
        chunked.withColumn("number", F.row_number().over(own) - 1)
        .join(bases, ["chunk", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("number"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at, table_ = np.flatnonzero(length == x), places[int(x)]
                row = table_[np.searchsorted(table_[:, 0], number[at], "right") - 1]
                k = number[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * x
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return map_arrow(numbered, place, PIECE_SCHEMA + ", sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
