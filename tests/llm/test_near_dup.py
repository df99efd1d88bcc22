"""Near duplicates, fingerprints, components and mixing against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from minekit.llm import fingerprints, mixing, near_dup
from minekit.llm.common import Scratch
from minekit.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n=150):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 8, 40, 90]))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(base[draw.randrange(12)] if draw.random() < 0.8 else [draw.choice(vocabulary) for _ in range(30)])
        for _ in range(draw.randrange(6)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        out.append((i * 3 + 1, " ".join(w.upper() if draw.random() < 0.2 else w for w in words)))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(documents, width):
    rows = corpus(width)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(documents(rows), width=width).collect()}
    want = brute(rows, width)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


@pytest.mark.parametrize("tails", [1, 3])
def test_links_with_the_smallest_id_of_a_crowded_group(documents, tails):
    """A crowd of near copies, and a text (or a component of three) that links with the crowd's smallest id alone."""
    rows = []
    for at, seed in enumerate((5, 23, 35, 37)):
        common = [f"c{seed}x{k}" for k in range(100)]
        least = [*common, f"z{seed}"]
        crowd = [least, common, *([*common, f"m{seed}x{k}"] for k in range(60))]
        rows += [(at * 1000 + k + 1, " ".join(words)) for k, words in enumerate([*crowd, *(least[-81 + k :] for k in range(tails))])]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(documents(rows), width=2).collect()}
    assert got == {i: root for i, (_, root) in brute(rows, 2).items()} and set(got.values()) == {1, 1001, 2001, 3001}


def templated(n, words=300, seed=3, same=0.88):
    """Texts of one template that lie just under the limit, each with words of its own, and a few that are near copies."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        text = [f"t{k}" if draw.random() < same else f"d{i}x{k}" for k in range(words)]
        rows.append((i + 1, " ".join(text)))
        if i % 40 == 0:
            rows.append((100_000 + i, " ".join([*text[:-2], "other", "end"])))
    return rows


@pytest.mark.parametrize("few", [0, 64])
def test_crowds_of_lone_texts(documents, few, monkeypatch):
    """Buckets of many texts that link with none or one other: pair by pair, and by blocks of several sizes."""
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "IN_BLOCK", 1 << 12)
    rows = templated(160, words=100, same=0.95)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(documents(rows), width=2).collect()}
    assert got == {i: root for i, (_, root) in brute(rows, 2).items()}


def test_links_of_blocks_equal_brute_force(monkeypatch):
    monkeypatch.setattr(near_dup, "CELLS", 2000)
    rng = np.random.default_rng(5)
    make = lambda n: [np.unique(rng.choice(40, rng.integers(1, 36))).astype(np.uint64) for _ in range(n)]
    left, right = make(70), make(90)
    right[:20] = [x.copy() for x in left[:20]]
    i, j = near_dup.linked_places(left, right)
    want = {(a, b) for a, x in enumerate(left) for b, y in enumerate(right) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_kept_rows_with_any_columns(documents):
    """Repeated doc_ids, a map column, and names that the operator might use itself."""
    long = " ".join(f"a{k}" for k in range(30))
    docs = documents([(5, long, "b"), (5, long, "a"), (7, long), (9, "all other words"), (None, long), (9, "all other words")])
    docs = docs.withColumns({c: F.lit(c) for c in ("__row", "n", "row", "node", "kept", "digest")}).withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
    got = sorted(near_dup.keep_one_of_each(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [r["doc_id"] for r in got] == [5, 9, None] and got[0]["source"] == "a" and got[0]["tags"] == {"k": "a"} and got[0]["__row"] == "__row"


def test_edge_cases(edge_cases):
    got = near_dup.near_duplicates(edge_cases, width=2).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 11 and by[1]["n_shingles"] == 0 and by[1]["kept"] and by[2]["component_id"] == 2
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[None]["kept"] and by[4]["n_shingles"] == 1
    kept = near_dup.keep_one_of_each(edge_cases, width=2)
    assert kept.columns == edge_cases.columns and kept.filter("doc_id in (6, 7)").count() == 1 and kept.count() == 9
    assert near_dup.near_duplicates(edge_cases.limit(0), width=2).count() == 0


def test_one_id_with_several_texts(documents):
    long = " ".join(f"a{k}" for k in range(20))
    other = " ".join(f"b{k}" for k in range(20))
    got = near_dup.near_duplicates(documents([(5, long), (5, other), (7, long), (9, other)]), width=2).collect()
    assert {r["component_id"] for r in got} == {5}


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}}


def test_estimates_are_near_the_truth(spark):
    draw = random.Random(1)
    a = [f"w{k}" for k in range(300)]
    rows = []
    for changed in (0, 30, 90):
        b = list(a)
        for k in draw.sample(range(300), changed):
            b[k] = f"x{draw.random()}"
        x, y = (near_dup.shingle_set(" ".join(t), 2) for t in (a, b))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        rows.append((true, near_dup.packed_bits(near_dup.signature(x)).tolist(), near_dup.packed_bits(near_dup.signature(y)).tolist()))
    df = spark.createDataFrame(rows, "true double, p array<long>, q array<long>").withColumn("e", near_dup.estimated("p", "q"))
    assert all(abs(r["true"] - r["e"]) < 0.12 for r in df.collect())


def test_fingerprints(documents, edge_cases):
    rows = corpus(8, 60)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(documents(rows)).collect()}
    import hashlib

    order = sorted(rows)
    for k, (i, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        own, other = fingerprints.sketch(text), fingerprints.sketch(edited)
        assert got[i]["fingerprint"] == fingerprints.encoded(own) and got[i]["near_edited"] == fingerprints.likeness(own, other)
    assert fingerprints.compare_with_edits(edge_cases).count() == 11
    assert fingerprints.compare_with_edits(edge_cases.limit(0)).count() == 0
    one = fingerprints.compare_with_edits(documents([(3, "only one text")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_sketches_merge():
    a, b = (" ".join(f"{x}{k}" for k in range(200)) for x in "ab")
    both = fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b))
    assert fingerprints.containment(fingerprints.sketch(a), both) == 1.0
    assert np.array_equal(fingerprints.decoded(fingerprints.encoded(both)), both)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, cap, fixed, total = {s: k % 3 + 1 for k, s in enumerate(names)}, {s: 3 * n for s, n in sizes.items()}, set(), sum(sizes.values())
    while True:
        left, shares = total - sum(cap[s] for s in fixed), sum(weight[s] for s in names if s not in fixed)
        out = {s: cap[s] if s in fixed else left * weight[s] / shares for s in names}
        over = {s for s in names if s not in fixed and out[s] > cap[s]}
        if not over:
            return out
        fixed |= over


def test_mixing(documents):
    draw = random.Random(6)
    rows = [(i, " ".join(["w"] * draw.choice([0, 3, 50, 700, 4000])), draw.choice(["a", "a", "a", "b", "c", None, "tiny"] if i % 40 else ["tiny"])) for i in range(200)]
    rows = [(i, t if s != "tiny" else "two words", s) for i, t, s in rows]
    docs = documents(rows)
    got = mixing.taken_words(docs).toPandas().set_index("doc_id")
    size = {i: len(t.split()) for i, t, _ in rows}
    sizes, taken = {}, {}
    for i, _, s in rows:
        sizes[s], taken[s] = sizes.get(s, 0) + size[i], taken.get(s, 0) + got.loc[i, "taken"]
        assert got.loc[i, "size"] == size[i] and got.loc[i, "taken"] <= 3 * size[i]
    want = brute_targets(sizes)
    for i, _, s in rows:
        assert got.loc[i, "target"] == pytest.approx(want[s]) and got.loc[i, "source_size"] == sizes[s]
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in sizes)
    again = mixing.taken_words(docs).toPandas().set_index("doc_id").loc[got.index]
    assert (again["taken"] == got["taken"]).all()


def test_mixed_documents_are_what_was_taken(documents, edge_cases):
    rows = [(i, "\n".join(f"t{i} w{k}" for k in range(20 * i)), "ab"[i % 2]) for i in range(1, 30)]
    docs = documents(rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs).collect()}
    words, texts = {}, {i: set(WORD.findall(t)) for i, t, _ in rows}
    mixed = mixing.mixed_documents(docs)
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert set(WORD.findall(r["text"])) <= texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert words == {i: n for i, n in taken.items() if n} and mixed.columns == docs.columns
    assert mixing.mixed_documents(edge_cases).columns == edge_cases.columns and mixing.mixed_documents(edge_cases).count() > 0
    assert mixing.taken_words(edge_cases).count() == 11 and mixing.taken_words(edge_cases.limit(0)).count() == 0


def test_slots_take_each_block_once_an_epoch(spark):
    sources = spark.createDataFrame([("sa", 0, 0, 128 * 37, 128 * 90.0), ("sb", 0, 1, 128 * 5, 128 * 2.0)], "s string, part long, rank long, source_size long, target double")
    made = mixing.slots(sources).toPandas()
    assert sorted(made["shard"] * mixing.SHARD + made["place"]) == list(range(92))
    for s, n, most in (("sa", 37, 3), ("sb", 5, 1)):
        times = made[made.s == s].groupby("block").size()
        assert times.max() <= most and times.index.max() < n
    counts = mixing.shard_counts(mixing.slots(sources)).toPandas()
    assert counts["n"].sum() == 92
