"""The permutations, the draws of shards, and the numbering of sources of the mix."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from minekit.llm import mixing
from minekit.llm.common import Scratch

SOURCES = "s string, part long, rank long, source_size long, target double"


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 333_334, 500_001])
def test_permutations_are_one_to_one_and_far_from_order(spark, n):
    rows = spark.range(0, n, 1, 4).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(F.lit(99).cast("long"), F.lit(n).cast("long"))).alias("at"))
    at = rows.toPandas().sort_values("id")["at"].to_numpy()
    assert np.array_equal(np.sort(at), np.arange(n))
    if n >= 1000:
        steps = np.bincount(np.diff(at) % n)
        assert steps.max() <= 15 and abs(np.corrcoef(at[:-1], at[1:])[0, 1]) < 0.15


def test_shard_counts_vary_as_draws_do(spark):
    """The variance of a source's count in a shard is that of draws without replacement, within 30 %."""
    shares, shards = [0.05, 0.15, 0.3, 0.5], 500
    total, ratios = shards * mixing.SHARD, []
    rows = [(f"s{k}", 0, k, int(x * total) * mixing.BLOCK, float(int(x * total) * mixing.BLOCK)) for k, x in enumerate(shares)]
    counts = mixing.shard_counts(mixing.slots(spark.createDataFrame(rows, SOURCES))).toPandas()
    for k, x in enumerate(shares):
        n = counts[(counts.s == f"s{k}") & (counts["shard"] < shards)].set_index("shard")["n"].reindex(range(shards), fill_value=0)
        ratios.append(n.var() / (mixing.SHARD * x * (1 - x) * (total - mixing.SHARD) / (total - 1)))
    assert all(0.7 < r < 1.3 for r in ratios), ratios


def test_many_sources_and_targets(spark, documents):
    """Sources over several ranges of names are numbered by code point, null last, and filled to one level."""
    draw = random.Random(4)
    names = [f"http://site{k:04d}.org/ü" for k in range(300)] + ["Z", "a", "", "é", None]
    sized = [(("n" if s is None else "s" + s), s, draw.choice([0, 1, 5, 100, 10_000])) for s in names]
    got = {r["s"]: r for r in mixing.targets(spark.createDataFrame(sized, "s string, source string, size long"), Scratch(spark, "test")).collect()}
    order = sorted(sized, key=lambda x: (x[1] is None, (x[1] or "").encode()))
    assert [got[s]["rank"] for s, _, _ in order] == list(range(len(names)))
    total, fixed = sum(n for _, _, n in sized), set()
    while True:
        left, weights = total - sum(3 * n for s, _, n in order if s in fixed), sum(k % 3 + 1 for k, (s, _, _) in enumerate(order) if s not in fixed)
        want = {s: 3 * n if s in fixed else left * (k % 3 + 1) / weights for k, (s, _, n) in enumerate(order)}
        over = {s for s, _, n in order if s not in fixed and want[s] > 3 * n}
        if not over:
            break
        fixed |= over
    assert all(got[s]["target"] == pytest.approx(want[s]) for s in want) and sum(want.values()) == pytest.approx(total)
    assert mixing.targets(spark.createDataFrame(sized[:0], "s string, source string, size long"), Scratch(spark, "test")).count() == 0


def test_no_column_name_is_reserved(documents):
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(10 * i)), "ab"[i % 2]) for i in range(1, 12)] + [(3, " ".join(f"t3w{k}" for k in range(30)), "b")] * 2
    names = ("m_id", "m_key", "m_units", "m_epoch", "row", "s", "digest", "size", "parts", "epoch", "new", "units", "x", "y", "text2")
    docs = documents(rows).withColumns({c: F.lit(f"own {c}") for c in names}).withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.taken_words(docs).collect())
    got = mixed.collect()
    assert sum(len(r["text"].split()) for r in got) == taken and all(r[c] == f"own {c}" for r in got for c in names)
