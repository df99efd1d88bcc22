"""Mix sources to target weights, with DataFrame operations alone.

The words of a source, its documents one after another, are packed into blocks of
``BLOCK`` words.  Targets follow the weights, capped at a multiple of each source's
size.  Every source gets whole epochs of its blocks and a remainder; all slots together
are numbered, and a pseudorandom permutation of the numbers deals them to output shards,
so the source counts of a shard are multinomial draws given the totals of the mix (drawn
without replacement).  Slot i of an epoch holds the block that the permutation of this
source and epoch puts at i; blocks and slots meet in a join by block number.  An epoch
takes each block once at most, so no document is taken more often than there are epochs.

The permutations are swap-or-not networks: a round reflects an index at a keyed point or
leaves it, by a keyed bit that both of the pair share.  They are one-to-one for any
number of slots, need no state and no shuffle, and any task computes any part of them.

Order within a source is by a hash of doc_id in chunks, then doc_id; places are prefix
sums within chunks, over chunks, and over groups of chunks, and sources are numbered by
prefix sums over ranges of their names, so that no source, however large, and no number
of sources is gathered in a task.

Defined cases: null or empty text has size 0 and is never taken; null is a source like
others, and the last; a source of size 0 has target 0; repeated rows are separate
documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minekit.llm.common import WORD_SQL, Scratch, need, partitions, table

#: Words in a block, slots in an output shard, and how often a document may be taken.
BLOCK, SHARD, EPOCHS = 128, 1024, 3
#: Documents in a chunk of the order, about; chunks in a group; slots that one row unfolds to.
CHUNK, GROUP, STEP = 500, 1000, 8192
#: Rounds of a permutation, the prime that its keys and bits are taken by, and the key of the permutation of all slots.
ROUNDS, PRIME, ALL_SLOTS = 32, 2147483647, 77_777_777
#: Sources that are broadcast to the rows of the result; beyond it, the join shuffles them.  The rows are the same.
BROADCAST_SOURCES = 1000
UNIT = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def weight_of(rank: Column) -> Column:
    """1, 2, 3, repeating, by rank from 0."""
    return F.pmod(rank, F.lit(3)) + 1


def _hashed(column: Column) -> Column:
    """A number below 2^32 from the column as text; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(column.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(0))


def round_keys(key: Column, n: Column) -> Column:
    """The point and the salt of each round of the permutation of 0 ... n - 1 with this key, as an array."""
    step = lambda x, by, plus: (x * x % PRIME + x * by + plus) % PRIME
    first = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: (key % PRIME * 48271 + r.cast("long") * 7919 + 11) % PRIME)
    a = F.transform(first, lambda x: step(x, 69621, 7919))
    pairs = F.transform(a, lambda x: F.struct(x.alias("a"), step(x, 16807, 104729).alias("b")))
    return F.transform(pairs, lambda p: F.struct(((p["a"] * PRIME + p["b"]) % n).alias("point"), step(p["b"], 48271, 11).alias("salt")))


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """Where the permutation of 0 ... n - 1 puts ``index``: a swap-or-not network with ``keys`` from ``round_keys``."""

    def one(x: Column, key: Column) -> Column:
        other = (key["point"] + n - x) % n
        high = F.greatest(x, other)
        t = (high % PRIME + F.shiftright(high, 31) * 7919 + key["salt"]) % PRIME
        return F.when(t * t % PRIME % 2 == 1, other).otherwise(x)

    return F.aggregate(keys, index, one)


def numbered(rows: DataFrame, scratch: Scratch, name: str, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 0 in the given order, and ``part``, a number that ascends with it in runs.

    Ranges of the order are sorted each by itself; a row for each range is all that one task sees.
    """
    n = partitions(rows.sparkSession)
    at = F.monotonically_increasing_id()
    made = scratch.write(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", at), name)
    made = made.withColumn("part", F.shiftright("at", 33))
    return made.join(_bases(made, F.count("*")), "part").withColumn("rank", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "base")


def _bases(rows: DataFrame, total: Column) -> DataFrame:
    """(part, base): what the parts before each have together; as many rows as parts."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(total.alias("total"))
    return F.broadcast(sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))


def level_of(weighed: DataFrame) -> float:
    """The level at which sources of ``weight`` are filled up to ``most`` and sum to all sizes.

    Newton's steps on the sum, which grows in straight pieces: sources below the level
    are capped and the others share the rest, until no more are capped.  Each step is an
    aggregation to one row.
    """
    level, capped = 0.0, -1
    while True:
        over = F.col("most") < level * F.col("weight")
        got = weighed.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)
        ).first()
        if got[3] == capped or not got[2]:
            return level
        level, capped = ((got[0] or 0) - (got[1] or 0)) / got[2], got[3]


def targets(sized: DataFrame, scratch: Scratch, weight=weight_of, cap: int = EPOCHS) -> DataFrame:
    """(s, part, rank, source_size, target) from (s, source, size): shares by weight, none above ``cap`` times its size."""
    by_source = sized.groupBy("s", "source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(by_source, scratch, "ranked", F.col("source").asc_nulls_last())
    weighed = ranked.withColumn("weight", weight(F.col("rank")).cast("double")).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    weighed = scratch.write(weighed, "weighed")
    target = F.least("most", F.col("weight") * F.lit(level_of(weighed)))
    return scratch.write(weighed.withColumn("target", target).select("s", "part", "rank", "source_size", "target"), "sources")


def placed(sized: DataFrame, documents: int) -> DataFrame:
    """``sized`` (s, doc_id, digest, size) with ``start``: the words of its source before it."""
    chunks = max(1, -(-documents // CHUNK))
    rows = sized.withColumn("chunk", F.pmod(_hashed(F.col("doc_id")), F.lit(chunks)))
    sums = rows.groupBy("s", "chunk").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("chunk") / GROUP))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    group_sums = sums.groupBy("s", "group").agg(F.sum("words").alias("in_group"))
    groups = group_sums.select("s", "group", F.coalesce(F.sum("in_group").over(before("s", "group")), F.lit(0)).alias("group_base"))
    in_groups = sums.withColumn("in_base", F.coalesce(F.sum("words").over(before("s", "group", "chunk")), F.lit(0)))
    bases = in_groups.join(groups, ["s", "group"]).select("s", "chunk", (F.col("group_base") + F.col("in_base")).alias("base"))
    own = Window.partitionBy("s", "chunk").orderBy("doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
        .join(bases, ["s", "chunk"])
        .withColumn("start", F.col("base") + F.col("own"))
        .drop("chunk", "own", "base")
    )


def slots(sources: DataFrame) -> DataFrame:
    """(s, j, block, shard, place): every slot of the mix, the block that fills it, and where it goes."""
    long = lambda x: F.lit(x).cast("long")
    counted = (
        sources.filter("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
        .withColumn("slots", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    )
    own = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("own", F.coalesce(F.sum("slots").over(own), F.lit(0))).join(_bases(counted, F.sum("slots")), "part")
    counted = counted.withColumn("first", F.col("base") + F.col("own")).crossJoin(F.broadcast(counted.agg(F.sum("slots").alias("all"))))  # one row
    epochs = counted.filter("slots > 0").withColumn("epoch", F.explode(F.sequence(long(0), F.floor((F.col("slots") - 1) / F.col("blocks")))))
    epochs = epochs.withColumn("before", F.col("epoch") * F.col("blocks")).withColumn("n", F.least("blocks", F.col("slots") - F.col("before")))
    steps = epochs.select(
        "s", "epoch", "blocks", "before", "first", "all", "n", F.explode(F.sequence(long(0), F.floor((F.col("n") - 1) / STEP))).alias("step")
    ).repartition(partitions(sources.sparkSession), "s", "epoch", "step")
    keyed = steps.withColumn("keys", round_keys(_hashed(F.col("s")) + F.col("epoch") * 1_000_003, F.col("blocks"))).withColumn("all_keys", round_keys(long(ALL_SLOTS), F.col("all")))
    each = lambda i: F.struct(
        (F.col("before") + i).alias("j"), permuted(i, F.col("blocks"), F.col("keys")).alias("block"),
        permuted(F.col("first") + F.col("before") + i, F.col("all"), F.col("all_keys")).alias("at"),
    )
    indices = F.sequence(F.col("step") * STEP, F.least(F.col("n") - 1, F.col("step") * STEP + STEP - 1))
    at = F.col("e.at")
    return keyed.select("s", F.explode(F.transform(indices, each)).alias("e")).select(
        "s", "e.j", "e.block", F.floor(at / SHARD).alias("shard"), (at % SHARD).alias("place")
    )


def shard_counts(made: DataFrame) -> DataFrame:
    """(shard, s, n): the source counts drawn for each output shard."""
    return made.groupBy("shard", "s").agg(F.count("*").alias("n"))


def plan(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Every document's places in the mix, the sources with targets, and the number of sources.

    Columns: doc_id, digest, s, source, size, start, taken, first_shard (-1: none), and parts: the
    stretches (from word, words, times taken) of its blocks.
    """
    sized = need(docs, "doc_id", "source", "text").select(
        "doc_id", "source", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("s"),
        F.xxhash64("text").alias("digest"), F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("long").alias("size"),
    )
    sized = scratch.write(sized, "sized")
    sources = targets(sized, scratch)
    n_sources, documents = sources.count(), sized.count()
    times = scratch.write(slots(sources).groupBy("s", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard")), "times")
    words = scratch.write(placed(sized.filter("size > 0"), documents), "placed")
    block, end = F.col("block"), F.col("start") + F.col("size")
    cut = (
        words.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))))
        .withColumn("from", F.greatest("start", block * BLOCK) - F.col("start"))
        .withColumn("n", F.least(end, (block + 1) * BLOCK) - F.greatest("start", block * BLOCK))
        # The planner takes unfolded rows for as few as the sources, and would broadcast them all.
        .join(times.hint("merge"), ["s", "block"])
    )
    found = cut.groupBy("doc_id", "digest", "s", "source", "size", "start").agg(
        F.sum(F.col("n") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"),
        F.collect_list(F.struct("from", "n", "times")).alias("parts"),
    )
    # Documents of which nothing is taken: by their place in the source, which is theirs alone.
    rest = words.join(found.select("s", "start", "size"), ["s", "start", "size"], "left_anti")
    nothing = [F.lit(0).cast("long").alias("taken"), F.lit(-1).cast("long").alias("first_shard"), F.array().cast("array<struct<from:bigint,n:bigint,times:bigint>>").alias("parts")]
    columns = ["doc_id", "digest", "s", "source", "size", "start"]
    empty = sized.filter("size = 0").select("doc_id", "digest", "s", "source", "size", F.lit(0).cast("long").alias("start"))
    return found.unionByName(rest.select(*columns, *nothing)).unionByName(empty.select(*columns, *nothing)), sources, n_sources


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_shard of every document."""
    made, sources, n = plan(docs, Scratch(docs.sparkSession, "mixing"))
    of_source = sources.select("s", "source_size", "target")
    return made.join(F.broadcast(of_source) if n <= BROADCAST_SOURCES else of_source, "s").select(
        "doc_id", "size", "source_size", "target", "taken", "first_shard"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of ``docs``: for each epoch, the words that it takes of each document.

    A text that is taken whole stays as it is; of others the taken stretches are joined,
    each with the white space after its words.  Rows of one doc_id, source and text have a
    plan each; in their other columns they are all like the first of them by JSON.  No
    column name is reserved.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    made, _, _ = plan(docs, scratch)
    taken = made.filter("taken > 0").select("doc_id", "digest", "source", "size", F.array_sort("parts").alias("parts"))
    taken = scratch.write(taken, "taken")
    key = ["doc_id", "digest", "source"]
    repeated = scratch.write(taken.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "repeated")
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "source", F.struct(*docs.columns).alias("row"))
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.digest") == F.col("y.digest")) & F.col("x.source").eqNullSafe(F.col("y.source"))
    of = lambda how: rows.alias("x").join(repeated.alias("y"), same, how)
    several = of("left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    rows = of("left_anti").unionByName(several)
    # The plans are small beside the texts, which need no sort then.
    joined = rows.alias("x").join(taken.hint("shuffle_hash").alias("y"), same).select("row", "size", "parts")
    each = joined.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(1, EPOCHS + 1)])))
    each = each.withColumn("parts", F.filter("parts", lambda p: p["times"] >= F.col("epoch"))).filter(F.size("parts") > 0)
    words = F.aggregate("parts", F.lit(0).cast("long"), lambda x, p: x + p["n"])
    units = F.regexp_extract_all("row.text", F.lit(UNIT), F.lit(0))
    stretches = F.transform("parts", lambda p: F.array_join(F.slice(F.col("units"), (p["from"] + 1).cast("int"), p["n"].cast("int")), ""))
    text = F.when(words == F.col("size"), F.col("row.text")).otherwise(F.array_join(stretches, ""))
    out = each.withColumn("units", F.when(words != F.col("size"), units)).withColumn("new", text).select("row", "new")
    own = {"text": F.col("new"), "n_chars": F.length("new")}
    return out.select(*[own.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to weights 1, 2, 3 by source."""
    return taken_words(table(spark, sf_dir, "documents"))
