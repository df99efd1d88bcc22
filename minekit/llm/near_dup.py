"""Near-duplicate documents: b-bit MinHash signatures, bands for candidates, links confirmed on full sets.

1. One pass over the texts gives each document its shingle-set digest, 48 band keys
   of 6 minima each, and the low 2 bits of all 288 minima, packed.
2. Documents of equal sets form a class; only the smallest id of a class goes on.
3. In each band bucket, every member is paired with one pivot, the member that shares
   most buckets; buckets whose members are in one component by then need no more.  In
   the others, members outside the largest component are paired with a random node of it.
4. In those still mixed, nodes in no component or in one of two are compared with each
   other (pair by pair in buckets of at most ``FEW`` such nodes, beyond that by blocks of
   whole sets, so that a bucket's pairs are never rows), and nodes with the members (root
   included) of another, larger component that holds enough of their shingles, by blocks.
5. A pair from a pivot or a small bucket goes on if its packed bits, corrected for chance
   agreement, say 0.66 or more (the limit is 0.8).  The full sets decide.

Two documents at similarity 0.8 miss every band with probability 5e-7, and the packed
bits drop such a link with probability 1.7e-6 (exact binomial tail); ``estimate=None``
leaves that filter out.

Defined cases: null or empty text, or no word: the set is empty and links with
nothing.  Rows of one doc_id count as one document and share a component.  A null
doc_id is linked with nothing; its component_id is null and it is kept.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm.common import Scratch, map_arrow, need, table, texts_of
from minekit.llm.components import components

#: Shingles and sets in a block, about; cells of a matrix at most; lone nodes of a bucket that are paired one by one.
IN_BLOCK, BLOCK_SETS, CELLS, FEW = 1 << 16, 512, 1 << 22, 64
BANDS, ROWS, BITS = 48, 6, 2
HASHES = BANDS * ROWS
#: The share of links that is asked for, in percent, and what packed bits must say at least.
PERCENT, ESTIMATE = 80, 0.66

_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct ``width``-word shingles as sorted 64-bit hashes; A-Z in lower case; fewer words are one shingle."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, np.uint64(min(width, len(words))))
    for k in range(min(width, len(words))):
        out = _mixed(out * _MIX[0] + ids[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """288 minima of 32 bits."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    best = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(folded), 512):
        best = np.minimum(best, (folded[at : at + 512, None] * _A + _B).min(0))
    return best


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0]
    for k in range(ROWS):
        out = _mixed(out * _MIX[1] + rows[:, k])
    return out.view(np.int64)


def packed_bits(minima: np.ndarray) -> np.ndarray:
    """2 bits of each minimum, in 64-bit words of 32."""
    low = ((minima * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(-1, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def estimated(a: str, b: str) -> Column:
    """Similarity from two columns of packed words: agreeing positions by bit counts, less chance agreement."""
    wrong = F.lit(0)
    for k in range(HASHES * BITS // 64):
        differ = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        either = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))
        wrong = wrong + F.bit_count(either)
    chance = 0.5**BITS
    return ((HASHES - wrong) / F.lit(float(HASHES)) - chance) / (1 - chance)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), bands, bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, bits = [], [], [], []
            for text in texts_of(batch):
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                if not len(shingles):
                    digests.append(None), bands.append([]), bits.append(None)
                    continue
                minima = signature(shingles)
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                bands.append(band_keys(minima))
                bits.append(packed_bits(minima))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip((sizes, digests, bands, bits), list(schema)[1:], strict=True))], schema=schema
            )

    return map_arrow(need(docs, "doc_id", "text"), run, "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>")


def full_sets(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the whole shingle sets of ``nodes`` (node, digest, copies), from their texts.

    Texts are dealt by doc_id and met with the few bytes of each node, so they are not
    sorted; only nodes with several rows of one set need a choice among these.
    """

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, width) for t in texts_of(batch)]
            same = [len(x) > 0 and xxhash.xxh3_128_digest(x.tobytes()) == d for x, d in zip(made, batch.column("digest").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in made], pa.binary())], names=["node", "shingles"])
            # A doc_id with several texts gives that text alone whose set its node stands for.
            yield out.filter(pa.array(same, pa.bool_()))

    texts = need(docs, "doc_id", "text").withColumnRenamed("doc_id", "node")
    found = lambda some: map_arrow(texts.join(some.select("node", "digest").hint("shuffle_hash"), "node"), full, "node long, shingles binary")
    return found(nodes.filter("copies = 1")).unionByName(found(nodes.filter("copies > 1")).dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch, estimate: float | None) -> DataFrame:
    """The pairs (a, b) of nodes that are links: first by packed bits, then on full sets."""
    near = pairs
    if estimate is not None:
        bits = nodes.select("node", "bits")
        near = (
            pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a")
            .join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
            .filter(estimated("bits_a", "bits_b") >= estimate).select("a", "b")
        )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_sets = (
        near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    )
    return scratch.write(map_arrow(with_sets.select("a", "b", "set_a", "set_b"), linked, "a long, b long"), "links")


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """(node, shingle, size) of every shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            sizes = [len(x) for x in made]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column("node").to_numpy(), sizes)), pa.array(np.concatenate(made)), pa.array(np.repeat(np.array(sizes, np.int64), sizes))],
                    names=["node", "shingle", "size"],
                )

    return map_arrow(sets, run, "node long, shingle long, size long")


def _reaching(facing: DataFrame, found: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, other, held, size): a node and a component that may be linked, with the node's shingles in the union, and all.

    A link of node x to a member y needs |x and y| >= (|x| + |y|) * s / (1 + s).  The
    shingles of x in the union of the component's sets bound the left side, its smallest
    set the right.  The cost is linear in nodes and shingles, not in members.
    """
    others = scratch.write(facing.select(F.col("other").alias("root")).distinct(), "facing-roots")
    of_root = found.join(others, "root").select("node", "root")
    union = _shingle_rows(sets.join(of_root.select("node"), "node")).join(of_root, "node")
    least = scratch.write(union.groupBy("root").agg(F.min("size").alias("least")), "least")
    union = union.select(F.col("root").alias("other"), "shingle").distinct()
    own = _shingle_rows(sets.join(facing.select("node").distinct(), "node")).join(facing, "node")
    held = own.join(union, ["other", "shingle"]).groupBy("node", "other").agg(F.count("*").alias("held"), F.max("size").alias("size"))
    enough = (100 + PERCENT) * F.col("held") >= PERCENT * (F.col("size") + F.col("least"))
    return held.join(least.withColumnRenamed("root", "other"), "other").filter(enough).select("node", "other", "held", "size")


def linked_places(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of a left and a right set that are links.

    Shingles on both sides are columns of 0/1 matrices, whose product counts what each
    pair shares, some rows at a time so that a matrix stays within ``CELLS``.
    """
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    code = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1].ravel()
    cut, n = nl.sum(), int(code.max(initial=-1)) + 1
    both = (np.bincount(code[:cut], minlength=n) > 0) & (np.bincount(code[cut:], minlength=n) > 0)
    number, width = np.cumsum(both) - 1, max(1, int(both.sum()))

    def matrices(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, min(BLOCK_SETS, CELLS // width))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for low in range(0, len(sizes), step):
            high = min(low + step, len(sizes))
            own = codes[starts[low] : starts[high]]
            rows, shared = np.repeat(np.arange(high - low), sizes[low:high]), both[own]
            out = np.zeros((high - low, width), np.float32)
            out[rows[shared], number[own[shared]]] = 1
            yield low, out

    i, j = [], []
    for low, a in matrices(code[:cut], nl):
        for start, b in matrices(code[cut:], nr):
            counts = (a @ b.T).astype(np.int64)
            unions = nl[low : low + len(a), None] + nr[None, start : start + len(b)] - counts
            x, y = np.nonzero((100 * counts >= PERCENT * unions) & (counts > 0))
            i.append(x + low)
            j.append(y + start)
    return np.concatenate(i), np.concatenate(j)


def _linked_in_blocks(left: DataFrame, right: DataFrame | None, nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the nodes of ``left`` and of ``right`` (group, node) in each group; of ``left`` with itself if None.

    A group's nodes are dealt to blocks of about ``IN_BLOCK`` shingles and ``BLOCK_SETS``
    nodes, whole sets with them; each pair of blocks is a row, compared as a whole.  So
    no group, however large, is gathered, and only links come out.
    """

    def dealt(some: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        sized = some.join(nodes.select("node", "n"), "node")
        load = F.greatest(F.sum("n") / IN_BLOCK, F.count("*") / BLOCK_SETS)
        blocks = scratch.write(sized.groupBy("group").agg(F.ceil(load).cast("long").alias("blocks")), f"{name}-blocks")
        placed = sized.join(blocks, "group").select("group", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
        held = placed.join(sets, "node").groupBy("group", "block").agg(F.collect_list(F.struct("node", "shingles")).alias(name))
        return scratch.write(held, name), blocks

    mine, blocks = dealt(left, "mine")
    theirs = mine.withColumnRenamed("mine", "theirs")
    if right is not None:
        theirs, blocks = dealt(right, "theirs")
    first = F.col("block") if right is None else F.lit(0).cast("long")
    each = mine.join(blocks, "group").select("group", "mine", F.explode(F.sequence(first, F.col("blocks") - 1)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column("mine"), batch.column("theirs"), strict=True):
                ids = [z.values.field("node").to_numpy() for z in (x, y)]
                i, j = linked_places(*([np.frombuffer(s.as_buffer(), np.uint64) for s in z.values.field("shingles")] for z in (x, y)))
                a.append(ids[0][i])
                b.append(ids[1][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (a, b)], names=["a", "b"])

    # A node is linked with itself, and pairs within a block come both ways.
    return map_arrow(each.join(theirs, ["group", "block"]).select("mine", "theirs"), run, "a long, b long").filter("a <> b")


def _crowded(alone: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Of (key, node, n) nodes, those that may be linked with another one of them that shares a key.

    A node's shingles that any other of the nodes has bound what it shares with one.
    """
    least = scratch.write(alone.groupBy("key").agg(F.min("n").alias("low"), F.count("*").alias("c")).filter("c > 1"), "lows")
    facing = alone.join(least, "key").groupBy("node").agg(F.min("low").alias("low"))
    rows = _shingle_rows(sets.join(facing.select("node"), "node"))
    common = rows.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1").select("shingle")
    held = rows.join(common, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("held"), F.max("size").alias("size"))
    smallest = F.greatest(F.col("low").cast("double"), F.col("size") * PERCENT / 100.0)
    enough = (100 + PERCENT) * F.col("held") >= PERCENT * (F.col("size") + smallest) - 1e-6
    return alone.select("key", "node").join(held.join(facing, "node").filter(enough).select("node"), "node", "left_semi")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, *, width: int = 5, estimate: float | None = ESTIMATE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    ``estimate``: what packed bits must say at least for a pair to reach the exact check;
    None: every candidate does.  Small sides of joins on hot keys are written first, so
    that the planner knows their size: it broadcasts them, or splits the hot keys.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    made = scratch.write(sketches(docs, width), "sketches")
    usable = made.filter("doc_id is not null and digest is not null")
    classes = scratch.write(usable.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    rows_of = usable.groupBy(F.col("doc_id").alias("node"), "digest").agg(
        F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")
    )
    nodes = scratch.write(rows_of.join(classes.hint("shuffle_hash"), ["node", "digest"]), "nodes")
    # Buckets of two nodes at least, and the pivot of each: the node that meets most others over all its buckets.
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    members = scratch.write(keyed.join(sizes, "key"), "members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.join(weights, "node").select("key", "node", "weight")
    pivots = scratch.write(weighed.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot")), "pivots")
    sets = scratch.write(full_sets(nodes.join(members.select("node").distinct(), "node", "left_semi"), docs, width), "sets")
    first = scratch.write(members.join(pivots, "key").filter("node <> pivot").select(*_ordered("node", "pivot")).distinct(), "first")
    links = _confirmed(first, nodes, sets, scratch, estimate)
    # Rows of one doc_id in several classes join them.
    own = usable.select("doc_id", "digest").join(classes, "digest").select("doc_id", "node")
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    several = several.select(F.explode(F.array("a", "b")).alias("a"), F.col("doc_id").alias("b"))
    found = components(links.unionByName(several), scratch)

    def mixed(of: DataFrame, name: str) -> DataFrame:
        """(key, node, root) of the buckets of ``of`` whose members are in several components."""
        placed = of.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        placed = scratch.write(placed, f"{name}-placed")
        keys = scratch.write(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"), f"{name}-keys")
        out = scratch.write(placed.join(keys, "key"), name)
        scratch.drop(placed, keys, of)
        return out

    # A second pivot for each of those, another in each bucket: a random node of the bucket's largest component.
    placed = mixed(members, "mixed")
    scratch.drop(sizes, pivots)
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("key", "node")).alias("pivot"))
    seconds = scratch.write(by_root.groupBy("key").agg(F.max_by(F.struct("root", "pivot"), F.struct("size", -F.col("root"))).alias("most")), "seconds")
    second = placed.join(seconds, "key").filter("root <> most.root").select(*_ordered("node", "most.pivot")).distinct()
    second = scratch.write(second.join(first, ["a", "b"], "left_anti"), "second")
    more = _confirmed(second, nodes, sets, scratch, estimate)
    found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)

    # What is left, first: nodes that are alone or in a pair, with each other.
    placed = mixed(placed, "left")
    # ``components`` gives no row of a root itself, which is a member like the others.
    whole = scratch.write(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "whole")
    roots = scratch.write(whole.groupBy("root").agg(F.count("*").alias("members")), "roots")
    placed = scratch.write(placed.join(roots, "root", "left").select("key", "node", "root", F.coalesce("members", F.lit(1)).alias("members")), "sized")
    alone = scratch.write(_crowded(placed.filter("members <= 2").select("key", "node").join(nodes.select("node", "n"), "node"), sets, scratch), "alone")
    crowds = scratch.write(alone.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "crowds")
    alone = alone.join(crowds, "key")
    # In buckets of a few, pair by pair; in others, by blocks, so that no bucket's pairs are rows.
    few = alone.filter(F.col("c") <= FEW).join(nodes.select("node", "bits"), "node")
    left, right = (few.select("key", F.col("node").alias(x), F.col("bits").alias(f"bits_{x}")) for x in ("a", "b"))
    near = F.lit(True) if estimate is None else estimated("bits_a", "bits_b") >= estimate
    singles = left.join(right, "key").filter(F.col("a") < F.col("b")).filter(near).select("a", "b").distinct()
    crowded = scratch.write(_linked_in_blocks(alone.filter(F.col("c") > FEW).select(F.col("key").alias("group"), "node"), None, nodes, sets, scratch), "crowded")
    # Second: nodes with the members of another component, if its union of shingles holds enough of theirs.
    parts = scratch.write(placed.filter("members > 2").select("key", F.col("root").alias("other")).distinct(), "parts")
    facing = placed.join(parts, "key").filter("root <> other and (members <= 2 or root > other)").select("node", "other").distinct()
    reach = scratch.write(_reaching(scratch.write(facing, "facing"), whole, sets, scratch), "reach")
    others = scratch.write(reach.select(F.col("other").alias("root")).distinct(), "others")
    theirs = whole.join(others, "root").select(F.col("root").alias("group"), "node")
    across = scratch.write(_linked_in_blocks(reach.select(F.col("other").alias("group"), "node"), theirs, nodes, sets, scratch), "across")
    pairs = singles.join(first.unionByName(second), ["a", "b"], "left_anti")
    more = _confirmed(pairs, nodes, sets, scratch, None).unionByName(across).unionByName(crowded)
    found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)

    scratch.drop_but(made, classes, found)
    rows = made.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    return (
        rows.join(found, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "node", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one_of_each(docs: DataFrame, *, width: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document is the smallest id of its component.

    Of several rows with one such doc_id the first by text, then by the other columns as
    JSON, stays; rows of a null doc_id all stay.  No column name is reserved.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    kept = near_duplicates(docs, width=width).filter("kept and doc_id is not null")
    kept = scratch.write(kept.groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    of = lambda ids, hint: docs.join(ids.select("doc_id").hint(hint), "doc_id", "left_semi")
    several = of(scratch.write(kept.filter("n > 1"), "several"), "merge")
    row, rest = F.struct(*docs.columns), [c for c in docs.columns if c not in ("doc_id", "text")]
    first = several.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(F.struct(*rest)) if rest else F.lit(""))).alias("row")).select("row.*")
    # Texts meet the kept ids as they come, without a sort.
    return of(kept.filter("n = 1"), "shuffle_hash").unionByName(first).unionByName(docs.filter("doc_id is null"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at 2-word shingle similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
