"""The mining operators on small inputs with known answers, and their properties."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from minekit.functions import hashing, metrics
from minekit.operators import cf, clustering, features, graph, itemsets, models, similarity, sketches, summary
from minekit.plans import catalog
from minekit.sources import readers, sinks
from minekit.streaming import live

# A textbook graph of seven nodes.
SEVEN = [tuple(x.split("-")) for x in "A-B A-C B-C B-D D-E D-F D-G E-F F-G".split()]


@pytest.fixture(scope="module")
def seven(spark):
    return spark.createDataFrame(SEVEN, "src string, dst string").cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_summary(spark):
    r = spark.createDataFrame([("u1", "a", "2018-01"), ("u1", "b", "2017-01"), ("u2", "a", "2018-02")], "u string, b string, d string")
    assert rows(summary.review_summary(r, "u", "b", F.col("d").startswith("2018"))) == [(3, 2, 2, 2)]
    assert rows(summary.top_k(r, "u", 1)) == [("u1", 2)]
    assert rows(summary.top_k(r, "u", 1, bottom=True)) == [("u2", 1)]
    assert rows(summary.larger_groups(r, "u", "b", 1)) == [("u1", 2)]
    assert rows(summary.partition_profile(r, F.length("u"))) == [(0, 3)]


def test_two_level_mean_counts_items_once(spark):
    r = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 1.0), (2, 5.0)], "b int, s double")
    p = spark.createDataFrame([(1, "x"), (2, "x")], "b int, city string")
    assert rows(summary.two_level_mean(r, p, "b", "s", "city")) == [("x", 3.0)]


def test_numbers_and_running_slots(spark):
    from minekit.plans.iterate import numbered

    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit("x").alias("v"))
    got = numbered(df, F.col("k")).collect()
    assert all(r["rank"] == r["k"] for r in got) and len(got) == 5000 and numbered(df.limit(0), F.col("k")).count() == 0
    s = stream(spark, n=3000).collect()
    want, held = set(), {}
    accepted = {r["seq"]: r["slot"] for r in sketches.reservoir_accepted(stream(spark, n=3000), 50).collect()}
    for r in s:
        if r["seq"] in accepted:
            held[accepted[r["seq"]]] = r["value"]
        if r["seq"] % 100 == 99:
            want |= {(r["batch"], slot, v) for slot, v in held.items() if slot in (0, 20, 40)}
    assert set(rows(sketches.reservoir_slots(stream(spark, n=3000), size=50, report=(0, 20, 40)))) == want


@pytest.fixture(scope="module")
def baskets(spark):
    import random

    draw = random.Random(4)
    data = {(b, i) for b in range(60) for i in draw.sample(range(8), draw.randint(1, 6))}
    return data, spark.createDataFrame(sorted(data), "basket int, item int").cache()


def brute(data, support):
    by, out = {}, {}
    for b, i in data:
        by.setdefault(b, set()).add(i)
    for k in range(1, 9):
        for c in combinations(range(8), k):
            n = sum(set(c) <= s for s in by.values())
            if n >= support:
                out[c] = n
    return out


@pytest.mark.parametrize("way", ["apriori", "pcy", "multi", "son1", "son5", "fp"])
def test_itemsets_agree(baskets, way):
    data, df = baskets
    made = {
        "apriori": lambda: itemsets.apriori(df, 12), "pcy": lambda: itemsets.pcy(df, 12, buckets=17, least_pairs=0), "multi": lambda: itemsets.multi_hash(df, 12, most=None, buckets=13, least_pairs=0),
        "son1": lambda: itemsets.son(df, 12, 1, F.col("basket")), "son5": lambda: itemsets.son(df, 12, 5, F.col("basket")), "fp": lambda: itemsets.fp_growth(df, 12),
    }[way]()
    assert {tuple(r["itemset"]): r["count"] for r in made.collect()} == brute(data, 12)


def test_counting_given_sets(spark, baskets):
    """Sets that are closed under subsets, and any others."""
    data, df = baskets
    every = brute(data, 0)
    closed = [c for c in every if set(c) <= {0, 1, 2, 3} or c == (5,)]
    given = spark.createDataFrame([(list(c),) for c in closed], "itemset array<int>")
    want = {c: every[c] for c in closed if every[c]}
    assert {tuple(r["itemset"]): r["count"] for r in itemsets.count_closed(df, given).collect()} == want
    some = [(0, 3, 7), (1,), (2, 5), (0, 1, 2, 3, 4, 5)]
    got = itemsets.count_candidates(df, spark.createDataFrame([(list(c),) for c in [*some, (6, 99)]], "itemset array<int>"))
    assert {tuple(r["itemset"]): r["count"] for r in got.collect()} == {c: every[c] for c in some if every[c]}


@pytest.mark.parametrize("name", ["frequent_itemsets", "son_frequent"])
def test_queries_of_itemsets_go_on_until_a_level_is_empty(spark, monkeypatch, name):
    data = {(b, i) for b in range(40) for i in ((0, 1, 2, 3, 4) if b % 8 < 5 else (b % 8, 2, 3))}
    df = spark.createDataFrame(sorted(data), "basket int, item int")
    monkeypatch.setattr(catalog.fx, "baskets", lambda spark, d: df)
    got = {tuple(map(int, r["itemset"].split(","))): r["count"] for r in catalog.QUERIES[name](spark, "").collect()}
    assert got == brute(data, catalog.fx.support(df)) and max(map(len, got)) >= 5


def test_itemsets_of_nothing(spark):
    none = spark.createDataFrame([], "basket int, item int")
    assert itemsets.apriori(none, 1).count() == 0
    assert itemsets.binomial(3, 2) == 3 and itemsets.binomial(1, 2) == 1 and itemsets.chunks_for(40_000) == 3


def test_jaccard_and_lsh(spark):
    import random

    draw = random.Random(2)
    base = [draw.sample(range(60), 12) for _ in range(6)]
    sets = {k: set(base[k % 6]) - ({base[k % 6][k % 5]} if k > 5 else set()) | ({k + 100} if k % 2 else set()) for k in range(24)}
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "id int, x int").cache()
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sets, 2)}
    want = {k: v for k, v in want.items() if v >= 0.5}
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.jaccard_exact(df, 0.5).collect()}
    assert got == pytest.approx(want)
    near = {(r["a"], r["b"]): r["similarity"] for r in similarity.lsh_similar(df, 0.5).collect()}
    assert near.items() <= got.items() and len(near) >= 0.9 * len(got)
    assert similarity.bands_and_rows(100, 0.5) == (33, 3)
    assert [s for _, s in similarity.band_bounds(100, 33)] == [4] + [3] * 32


def test_cf(spark):
    r = spark.createDataFrame([(u, i, float(v)) for u, i, v in [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 4), (3, 1, 3), (3, 2, 6), (4, 1, 5)]], "u int, i int, r double")
    w = cf.pearson(r, least=2)
    assert {(x["i"], x["j"]): round(x["w"], 9) for x in w.collect()} == {(1, 2): 1.0, (2, 1): 1.0}
    pairs = spark.createDataFrame([(4, 2), (9, 2)], "u int, i int")
    got = {(x["u"], x["i"]): (x["p"], x["n"]) for x in cf.predict(r, pairs, w).collect()}
    assert got[(4, 2)] == (5.0, 1) and got[(9, 2)] == (pytest.approx(23 / 7), 0)
    model = spark.createDataFrame([(9, 2, 3.5)], "u int, i int, m double")
    assert {tuple(x) for x in cf.hybrid(cf.predict(r, pairs, w), model).collect()} == {(4, 2, 5.0), (9, 2, 3.5)}
    assert r.select(cf.amplified(F.lit(-0.5)).alias("a")).first()["a"] == pytest.approx(-0.5 * 0.5**1.2)


def test_metrics(spark):
    r = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    assert metrics.rmse(r).first()["rmse"] == pytest.approx(math.sqrt(0.5))
    assert rows(metrics.error_histogram(r)) == [(0, 1), (1, 1)]
    assert metrics.r2(r).first()["r2"] == pytest.approx(0.5) and metrics.accuracy(r, 2.5).first()["accuracy"] == 1.0


def test_features(spark):
    u = spark.createDataFrame([("a", 3, "2010-05-01", "2012, 2013", 1, 2)], "user_id string, review_count int, yelping_since string, elite string, compliment_hot int, compliment_cool int")
    u = u.withColumns({c: F.lit(1) for c in ("useful", "funny", "cool", "fans", "average_stars")})
    assert features.user_features(u).first()["elite"] == 10 and features.user_features(u, 2).first()["compliments"] == 3
    third = features.user_features(u, 3).first()
    assert (third["elite"], third["years"]) == (2, 12)
    b = spark.createDataFrame([("x", {"HasTV": "True", "Ambience": "{'romantic': True, 'casual': False}"}), ("y", None)], "business_id string, attributes map<string,string>")
    b = b.withColumns({"review_count": F.lit(1), "stars": F.lit(4.0), "is_open": F.lit(1), "longitude": F.lit(0.0), "latitude": F.lit(None).cast("double"), "categories": F.lit("a, b")})
    got = {r["business_id"]: r for r in features.item_features(b, 2).collect()}
    assert (got["x"]["HasTV"], got["y"]["HasTV"], got["y"]["price"], got["x"]["latitude"], got["x"]["longitude"]) == (1, 0, 2, 0.5, 0.5)
    profile = {(r["business_id"], r["f"]): r["v"] for r in features.ambience_profile(b).collect()}
    assert profile[("x", 2)] == 1.0 and profile[("x", 10)] == 0.0 and profile[("y", 0)] == 0.0


def test_content_profile_by_hand(spark):
    """Alcohol and GoodForKids count as given whatever their value; then the nine ambiences in their order."""
    rows = [
        ("a", {"Alcohol": "none", "Ambience": "{'romantic': False, 'divey': True, 'casual': True}"}),
        ("b", {"GoodForKids": "False", "Alcohol": None, "HasTV": "True"}), ("c", {"Ambience": None}), ("d", None),
    ]
    got = {}
    for r in features.ambience_profile(spark.createDataFrame(rows, "business_id string, attributes map<string,string>")).collect():
        got.setdefault(r["business_id"], [None] * 11)[r["f"]] = r["v"]
    assert got == {"a": [1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1], "b": [0, 1, *[0] * 9], "c": [0] * 11, "d": [0] * 11}
    profile = spark.createDataFrame([(i, f, float(v)) for i, x in got.items() for f, v in enumerate(x)], "i string, f int, v double")
    ratings, pairs = spark.createDataFrame([("u", "a", 4.0), ("u", "b", 2.0)], "u string, i string, r double"), spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "c"), ("w", "a")], "u string, i string")
    scores = {(r["u"], r["i"]): r["score"] for r in features.content_scores(ratings, profile, pairs).collect()}
    assert scores == {("u", "a"): pytest.approx(12 / 14), ("u", "b"): pytest.approx(2 / 14), ("u", "c"): 0.0, ("w", "a"): None}


def test_betweenness_of_the_textbook_graph(seven):
    got = {(r["src"], r["dst"]): round(r["score"], 6) for r in graph.edge_betweenness(seven).collect()}
    assert got == {("A", "B"): 5.0, ("A", "C"): 1.0, ("B", "C"): 5.0, ("B", "D"): 12.0, ("D", "E"): 4.5, ("D", "F"): 4.0, ("D", "G"): 4.5, ("E", "F"): 1.5, ("F", "G"): 1.5}
    # Betweenness sums to the distances of all pairs.
    levels = graph.shortest_paths(seven).agg(F.sum("level")).first()[0]
    assert sum(got.values()) == pytest.approx(levels / 2)


@pytest.mark.parametrize("local_edges", [0, 100])
def test_girvan_newman_cuts_the_bridge(seven, local_edges):
    members = graph.girvan_newman(seven, steps=1, local_edges=local_edges)
    by = {}
    for r in members.collect():
        by.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, by.values())) == [["A", "B", "C"], ["D", "E", "F", "G"]]
    assert [r["line"] for r in sinks.community_report(members).collect()] == ["'A', 'B', 'C'", "'D', 'E', 'F', 'G'"]


def brute_girvan_newman(edges):
    """{node: component} and the number of cuts before modularity first falls."""

    def around():
        out = {x: set() for x in nodes}
        for a, b in left:
            out[a].add(b), out[b].add(a)
        return out

    def parts():
        adjacent, out = around(), {}
        for root in sorted(nodes):
            todo = [] if root in out else [root]
            while todo:
                x = todo.pop()
                out[x] = root
                todo += [y for y in adjacent[x] if y not in out]
        return out

    def quality(of):
        m, adjacent = len(left), around()
        inside = [(a, b) for a, b in combinations(sorted(nodes), 2) if of[a] == of[b]]
        return sum(((a, b) in left) - len(adjacent[a]) * len(adjacent[b]) / (2 * m) for a, b in inside) / (2 * m)

    def scores():
        adjacent, out = around(), dict.fromkeys(left, 0.0)
        for root in nodes:
            level, paths, order = {root: 0}, {root: 1}, [root]
            for x in order:
                for y in adjacent[x]:
                    if y not in level:
                        level[y], paths[y] = level[x] + 1, 0
                        order.append(y)
                    paths[y] += paths[x] * (level[y] == level[x] + 1)
            credit = dict.fromkeys(order, 1.0)
            for y in reversed(order):
                for x in adjacent[y]:
                    if level[x] == level[y] - 1:
                        flow = credit[y] * paths[x] / paths[y]
                        credit[x] += flow
                        out[min(x, y), max(x, y)] += flow / 2
        return out

    left, cuts = set(edges), 0
    nodes = {x for e in left for x in e}
    best = parts()
    q = quality(best)
    while len(left) > 1:
        found = scores()
        left.remove(min(left, key=lambda e: (-round(found[e], 9), e)))
        members = parts()
        if quality(members) < q - 1e-12:
            break
        best, q, cuts = members, quality(members), cuts + 1
    return best, cuts


@pytest.mark.parametrize("seed", range(6))
def test_girvan_newman_in_one_process_equals_brute_force(spark, seed):
    import random

    draw = random.Random(seed)
    edges = sorted({tuple(sorted(draw.sample(range(14), 2))) for _ in range(24)})
    want, _ = brute_girvan_newman(edges)
    got = graph.girvan_newman(spark.createDataFrame([*edges, (3, 3), edges[0][::-1]], "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_local_measures_equal_the_operators(spark, seven):
    local = graph.LocalGraph([(r["src"], r["dst"]) for r in seven.select("src", "dst").collect()])
    want = {(r["src"], r["dst"]): r["score"] for r in graph.edge_betweenness(seven).collect()}
    assert local.betweenness(local.near) == pytest.approx(want)
    members = graph.connected_components(seven)
    for variant in ("reference", "original", "newman"):
        assert local.modularity(local.components(), variant) == pytest.approx(graph.modularity(members, seven, seven, variant).first()["q"])


def test_the_girvan_newman_query_cuts_until_modularity_falls(spark, monkeypatch):
    edges = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6), (6, 7), (7, 8), (7, 9), (8, 9)]
    want, cuts = brute_girvan_newman(edges)
    df = spark.createDataFrame(edges, "src int, dst int")
    monkeypatch.setattr(catalog.fx, "edges", lambda spark, d: df)
    assert cuts == 2 and {r["node"]: r["component"] for r in catalog.QUERIES["girvan_newman"](spark, "").collect()} == want


def test_components_modularity_labels(spark, seven):
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51)], "src int, dst int")
    got = {r["node"]: r["component"] for r in graph.connected_components(chain).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 51: 50}
    one = graph.connected_components(seven)
    degree = {"A": 2, "B": 3, "C": 2, "D": 4, "E": 2, "F": 3, "G": 2}
    want = (9 - sum(degree[a] * degree[b] for a, b in combinations(degree, 2)) / 18) / 18
    assert graph.modularity(one, seven).first()["q"] == pytest.approx(want)
    assert graph.modularity(one, seven, variant="newman").first()["q"] == pytest.approx(0)
    assert len(graph.label_propagation(seven).collect()) == 7
    assert graph.remove_edge(seven, "D", "B").count() == 8


def test_betweenness_report(seven):
    lines = [r["line"] for r in sinks.betweenness_report(graph.edge_betweenness(seven)).collect()]
    assert lines[0] == "('B', 'D'),12.0" and len(lines) == 9


def test_clustering(spark):
    import random

    draw = random.Random(3)
    pts = [(k, [draw.gauss(20 * (k % 3), 1), draw.gauss(20 * (k % 3), 1)]) for k in range(300)]
    df = spark.createDataFrame(pts, "id int, vec array<double>").cache()
    rounds, labels = clustering.bfr(df, 3, 2)
    seen = df.transform(clustering.chunked).groupBy("chunk").count().collect()
    total = 0
    for r, n in zip(sorted(rounds.collect()), [x["count"] for x in sorted(seen)], strict=True):
        total += n
        assert r["n_ds"] + r["in_cs"] + r["n_rs"] == total
    found = {r["id"]: r["cluster"] for r in labels.collect()}
    pure = sum(len({found[k] for k in range(m, 300, 3)} - {-1}) for m in range(3))
    assert len(found) == 300 and pure <= 6 and sum(v == -1 for v in found.values()) < 60


def brute_bfr(chunks, k, d, factor, split):
    """The rounds and the discard summaries, point by point; ``split`` stands for k-means."""
    import numpy as np

    limit = factor * math.sqrt(d)
    several = lambda groups: ([g for g in groups if len(g) > 1], [p for g in groups if len(g) == 1 for p in g])
    total = lambda g: [len(g), sum(np.array(v) for _, v in g), sum(np.array(v) ** 2 for _, v in g)]
    centre = lambda c: c[1] / c[0]
    sd = lambda c: np.sqrt(np.maximum(c[2] / c[0] - centre(c) ** 2, 0))

    def far(x, c, s):
        return math.inf if ((s <= 1e-12) & (abs(x - c) >= 1e-9)).any() else math.sqrt(sum(((a - b) / e) ** 2 for a, b, e in zip(x, c, s, strict=True) if e > 1e-12))

    def near(a, b):
        return far(centre(a), centre(b), sd(a) if (sd(a) ** 2).sum() < (sd(b) ** 2).sum() else sd(b)) < limit

    def add(a, b):
        a[0], a[1], a[2] = a[0] + b[0], a[1] + b[1], a[2] + b[2]

    groups, outer = several(split(chunks[0], 5 * k))
    ds = [total(g) for g in split([p for g in groups for p in g], k)]
    cs, rs, reports = [], outer, []

    def gather(rest):
        if len(rest) < 5 * k:
            return [], rest
        groups, single = several(split(rest, 5 * k))
        return [total(g) for g in groups], single

    cs, rs = gather(outer)
    reports.append((1, sum(c[0] for c in ds), len(cs), sum(c[0] for c in cs), len(rs)))
    for n, chunk in enumerate(chunks[1:], 2):
        fixed, rest, taken = [(centre(c), sd(c)) for c in ds + cs], [], [[] for _ in ds + cs]
        for p in chunk:
            at = next((i for i, (c, s) in enumerate(fixed) if far(np.array(p[1]), c, s) < limit), None)
            (rest if at is None else taken[at]).append(p)
        for c, g in zip(ds + cs, taken, strict=True):
            if g:
                add(c, total(g))
        new, rs = gather(rs + rest)
        cs += new
        while pair := next(((i, j) for i in range(len(cs)) for j in range(i + 1, len(cs)) if near(cs[i], cs[j])), None):
            add(cs[pair[0]], cs.pop(pair[1]))
        if n == len(chunks):
            while pair := next(((i, j) for i in range(len(cs)) for j in range(len(ds)) if near(cs[i], ds[j])), None):
                add(ds[pair[1]], cs.pop(pair[0]))
        reports.append((n, sum(c[0] for c in ds), len(cs), sum(c[0] for c in cs), len(rs)))
    fixed = [(centre(c), sd(c)) for c in ds]
    labels = {p[0]: next((i for i, (c, s) in enumerate(fixed) if far(np.array(p[1]), c, s) < limit), -1) for chunk in chunks for p in chunk}
    return reports, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_bfr_equals_brute_force(spark, monkeypatch, seed):
    """Every step of the rounds, with a fixed split by the first coordinate in place of k-means."""
    import random

    draw = random.Random(seed)
    k = 2
    pts = [(3_500_000_000 + n, [draw.gauss(10 * (n % 2), 1), draw.uniform(0, 30) if n % 9 == 0 else draw.gauss(0, 1)]) for n in range(400)]
    df = spark.createDataFrame(pts, "id long, vec array<double>").cache()

    def split_frame(points, n, seed=0):
        return points.select("id", "vec", F.pmod(F.floor(F.col("vec")[0] * 4) + F.floor(F.col("vec")[1]) * 3, F.lit(n)).alias("cluster"))

    def split(points, n):
        groups = {}
        for p in points:
            groups.setdefault((math.floor(p[1][0] * 4) + math.floor(p[1][1]) * 3) % n, []).append(p)
        return [groups[c] for c in sorted(groups)]

    monkeypatch.setattr(clustering, "kmeans", split_frame)
    chunk = {r["id"]: r["chunk"] for r in clustering.chunked(df).collect()}
    rounds, labels = clustering.bfr(df, k, 2)
    want, want_labels = brute_bfr([[p for p in pts if chunk[p[0]] == c] for c in range(5)], k, 2, 2.0, split)
    assert rows(rounds) == want
    assert {r["id"]: r["cluster"] for r in labels.collect()} == want_labels


def test_zero_spread_rejects(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], "id int, vec array<double>")
    centre = spark.createDataFrame([(0, [1.0, 2.0], [0.0, 0.0])], "cluster long, c array<double>, sd array<double>")
    assert rows(clustering.assign(df, centre, 2).select("id", "cluster")) == [(1, 0), (2, -1)]


def stream(spark, n=600, values=80):
    import random

    draw = random.Random(9)
    return spark.createDataFrame([(k, k // 100, f"v{draw.randrange(values)}é") for k in range(n)], "seq long, batch long, value string").cache()


def test_text_hash(spark):
    for text in ("abc", "naïve €", ""):
        got = spark.createDataFrame([(text,)], "value string").select(hashing.text_mod(F.col("value"), 69_997).alias("h")).first()["h"]
        assert got == int.from_bytes(text.encode(), "big") % 69_997


def written(s, path, batches):
    for b in batches:
        s.filter(F.col("batch") == b).coalesce(1).write.parquet(f"{path}/b{b}")
    # A stream of files takes them by their times, and no folders that come in between.
    import os
    import shutil

    for b in batches:
        for part in (path / f"b{b}").glob("*.parquet"):
            shutil.copy(part, path / f"{b:03d}-{part.name}")
            os.utime(path / f"{b:03d}-{part.name}", (1_700_000_000 + b, 1_700_000_000 + b))
        shutil.rmtree(path / f"b{b}")


def test_live_sketches_stop_and_go_on(spark, tmp_path):
    """Each stream is stopped after half of its files; new objects take it up, and a micro-batch that runs again changes nothing."""
    s, path = stream(spark), tmp_path / "in"
    fpr = rows(sketches.bloom_fpr(s, bits=97).select("batch", "n", "false_positives"))
    slots = {r["slot"]: r["value"] for r in sketches.reservoir_slots(s, size=50, report=tuple(range(50))).filter("batch = 5").collect()}
    estimates = rows(sketches.fm_estimate(s).select("batch", "estimate"))
    assert any(r[2] for r in fpr) and len(slots) == 50
    folder = lambda name: live.Folder(spark, f"{name}-test", str(path))
    for half in (range(3), range(3, 6)):
        written(s, path, half)
        bloom, held, distinct = live.LiveBloom(folder("bloom"), bits=97), live.LiveReservoir(folder("reservoir"), size=50), live.LiveDistinct(folder("fm"))
        for sketch in (bloom, held, distinct):
            live.run(live.read_stream(spark, str(path)), sketch.fold, sketch.folder)
    for sketch in (bloom, held, distinct):  # the last micro-batch once more, as after a failure
        sketch.fold(s.filter("batch = 5"), 5)
    assert rows(bloom.results().select("batch", "n", "false_positives")) == fpr
    assert {r["slot"]: r["value"] for r in held.slots().collect()} == slots
    assert rows(distinct.estimates()) == estimates
    # Another source under the same name is another stream.
    other = live.Folder(spark, "reservoir-test", "elsewhere")
    assert live.LiveReservoir(other, size=50).slots().count() == 0


def test_a_batch_of_one_is_checked_before_it_is_added(spark):
    bloom = live.LiveBloom(live.Folder(spark, "single", "none"), bits=1, layers=1)  # one bit: any value looks like one seen before
    for epoch, value in enumerate(("a", "b", "a")):
        bloom.fold(spark.createDataFrame([(epoch, value)], "batch long, value string"), epoch)
    assert rows(bloom.results().select("batch", "false_positives")) == [(0, 0), (1, 1), (2, 0)]


def test_distinct_counts_by_window_with_late_rows(spark, tmp_path):
    import datetime as dt

    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    files = [[(at(1), "a"), (at(2), "b"), (at(6), "c")], [(at(3), "late"), (at(21), "d")], [(at(4), "too late"), (at(60), "e")]]
    got, query = {}, None

    def keep(part, _):
        for r in part.collect():
            got.setdefault(r["window"]["start"].minute, []).append((r["estimate"], r["hll"]))

    (tmp_path / "in").mkdir()
    for n, file in enumerate(files):  # stopped and started again for each file
        spark.createDataFrame(file, "at timestamp, value string").coalesce(1).write.parquet(f"{tmp_path}/f{n}")
        for part in (tmp_path / f"f{n}").glob("*.parquet"):
            part.rename(tmp_path / "in" / f"{n}.parquet")
        counts = live.fm_by_window(live.read_stream(spark, f"{tmp_path}/in", "at timestamp, value string"), "at")
        query = counts.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    values = {0: ["a", "b", "late"], 5: ["c"], 20: ["d"]}
    for start, x in values.items():
        rows_ = spark.createDataFrame([(0, v) for v in x], "batch long, value string")
        assert got[start] == [(sketches.fm_estimate(rows_).first()["estimate"], len(x))]


def test_fm(spark):
    got = sketches.fm_estimate(stream(spark)).collect()
    assert len(got) == 6 and all(math.log2(r["estimate"]).is_integer() and r["truth"] <= 80 for r in got)
    assert sketches.fm_score(sketches.fm_estimate(stream(spark))).first()["score"] > 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.csv").write_text("user_id,business_id,stars\na,b,3.0\nc,d\n")
    got = readers.read_csv(spark, str(tmp_path / "r.csv"))
    assert rows(got.select("user_id", "stars").filter("stars is not null")) == [("a", 3.0)] and got.count() == 2
    (tmp_path / "r.json").write_text('{"user_id": "a", "stars": 2.0}\n')
    assert readers.read_json(spark, str(tmp_path / "r.json")).first()["stars"] == 2.0
    t = spark.createDataFrame([('"2020"', '"7"', '"p"')], "d string, c string, p string")
    assert rows(readers.transactions(t, "d", "c", "p")) == [("2020-7", "p")]
    sets = spark.createDataFrame([(["a"],), (["b"],), (["a", "b"],)], "itemset array<string>")
    lines = [r["line"] for r in sinks.itemset_report(sets, sets).collect()]
    assert lines == ["Candidates:", "('a'),('b')", "", "('a', 'b')", "", "Frequent Itemsets:", "('a'),('b')", "", "('a', 'b')", ""]
    sinks.write_csv(got, str(tmp_path / "out"), "user_id")
    assert readers.read_csv(spark, str(tmp_path / "out")).count() == 2
    drawn = readers.draw(got, "user_id", "user_id", batch=5, batches=2)
    assert drawn.count() == 10 and {r["value"] for r in drawn.collect()} <= {"a", "c"}


def test_models(spark, tmp_path):
    train = spark.createDataFrame([(float(k % 7), float(k % 3), float(k % 7) / 2) for k in range(120)], "a double, b double, y double")
    model = models.boosted_trees(train, ["a", "b"], trees=5)
    assert models.r2(models.apply(model, train, ["a", "b"])) > 0.8
    sinks.write_model(model, str(tmp_path / "model"))
    als = models.factorise(spark.createDataFrame([(u, i, float(u % 3 + i % 2)) for u in range(6) for i in range(4)], "u int, i int, r double"), rank=3, iterations=3)
    assert models.factor_predictions(als, spark.createDataFrame([(1, 1), (99, 1)], "u int, i int"), 2.5).filter("u = 99").first()["p"] == 2.5


def test_reports_and_tables_read_back(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    read = lambda x: sorted(line for p in (tmp_path / x).glob("part-*") for line in p.read_text().splitlines())
    made = readers.from_rows(spark, [("Rome", 4.5), ("Bern", 4.5), ("Oslo", 1.0)], "place string, mean double")
    sinks.write_means(made, at("means"))
    (only,) = (tmp_path / "means").glob("part-*")
    assert only.read_text().splitlines() == ["city,stars", "Bern,4.5", "Rome,4.5", "Oslo,1.0"]
    sinks.write_metrics(summary.review_summary(spark.createDataFrame([("u", "i")], "u string, i string"), "u", "i", F.lit(True)), at("metrics"))
    assert read("metrics") == ['{"n_review":1,"n_when":1,"n_user":1,"n_item":1}']
    rounds, labels = spark.createDataFrame([(1, 5, 1, 2, 3)], "round int, n_ds long, n_cs long, in_cs long, n_rs long"), spark.createDataFrame([(10, 0), (9, -1)], "id long, cluster long")
    assert [r["line"] for r in sinks.cluster_report(rounds, labels).collect()] == ["Round 1: 5,1,2,3", "", "9,-1", "10,0"]
    table = features.vectors(spark.createDataFrame([("u", "b", 4.0, 1.0, None)], "user_id string, business_id string, stars_given double, x double, y double"))
    sinks.write_features(table.select("user_id", "features", F.array(F.lit(7), F.lit(8)).alias("z")), at("features"))
    assert set(read("features")) == {"user_id,features_0,features_1,z_0,z_1", "u,1.0,NaN,7,8"}  # each part has the header
    sinks.write_predictions(spark.createDataFrame([("u", "i", 3.5)], "u string, i string, p double"), at("predictions"))
    assert set(read("predictions")) == {"u,i,3.5", "user_id,business_id,prediction"}


def test_assembled_features(spark):
    checkins = spark.createDataFrame([("b", {"Mon-1": "2", "Tue-5": "1"})], "business_id string, time map<string,string>")
    photos, tips = spark.createDataFrame([("b", "p1"), ("b", "p2"), ("c", "p3")], "business_id string, photo_id string"), spark.createDataFrame([("u", "b", 2), ("u", "b", 3)], "user_id string, business_id string, likes long")
    by_item, likes = features.side_counts(checkins, photos, tips)
    assert rows(by_item.fillna(0)) == [("b", 2, 2), ("c", 0, 1)] and rows(likes) == [("u", "b", 5)]
    rated = spark.createDataFrame([("u", "b", 4.0), ("w", "c", 1.0)], "user_id string, business_id string, stars_given double")
    users, items = spark.createDataFrame([("u", 9)], "user_id string, fans long"), spark.createDataFrame([("b", 3.5)], "business_id string, stars double")
    got = {r["user_id"]: r for r in features.vectors(features.assemble(rated, users, items, (by_item, ["business_id"]), (likes, ["user_id", "business_id"]))).collect()}
    assert got["u"]["features"].toArray().tolist() == [9, 3.5, 2, 2, 5] and [got["w"][c] for c in ("fans", "stars", "slots", "photos", "likes")] == [None, None, None, 1, 0]


def test_partition_profiles_and_orders(spark, tmp_path):
    df = spark.range(0, 200, 1, 4).select((F.col("id") % 23).cast("string").alias("k"))
    got = {r["kind"]: r for r in summary.timed_profile(df, "k", 6).collect()}
    assert (got["default"]["n_partition"], got["default"]["n_items"]) == (4, [50] * 4)
    assert got["customized"]["n_partition"] == 6 and sum(got["customized"]["n_items"]) == 200 and got["customized"]["exe_time"] > 0
    dealt = df.repartition(6, "k").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert got["customized"]["n_items"] == [dict(dealt).get(p, 0) for p in range(6)]
    few = {r["kind"]: r["n_partition"] for r in summary.timed_profile(df.limit(9).coalesce(1), "k", 6).collect()}
    assert few == {"default": 1, "customized": 1}
    means = spark.createDataFrame([("a", 2.0), ("c", 5.0), ("b", 5.0)], "city string, stars double")
    tops = {r["way"]: r["keys"] for r in summary.timed_top(means, "city", "stars", 2).collect()}
    assert tops == {"m1": ["b", "c"], "m2": ["b", "c"]} and [r["way"] for r in summary.timed_top(means, "city", "stars", 2, most=1).collect()] == ["m2"]
    sinks.write_similar(spark.createDataFrame([(2, 3, 0.5), (1, 9, 0.6)], "a int, b int, similarity double").coalesce(1), str(tmp_path / "pairs"))
    lines = [x for p in sorted((tmp_path / "pairs").glob("part-*")) for x in p.read_text().splitlines() if not x.startswith("business")]
    assert lines == ["1,9,0.6", "2,3,0.5"]


def test_cluster_quality_by_hand(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 4
    got = clustering.quality(spark.createDataFrame(pairs, "label int, cluster int")).first()
    within = -(3 / 8 * math.log(3 / 4) + 1 / 8 * math.log(1 / 4))
    every = -(3 / 8 * math.log(3 / 8) + 5 / 8 * math.log(5 / 8))
    assert got["accuracy"] == pytest.approx(7 / 8) and got["completeness"] == pytest.approx(1 - within / every)
    assert clustering.quality(spark.createDataFrame([(0, 5), (1, 5)], "label int, cluster int")).first()["completeness"] == 1.0


def test_trees_part_missing_values_and_load_again(spark, tmp_path):
    from pyspark.ml import PipelineModel

    data = [(None if k % 4 == 0 else float(k % 4), float(k % 3), 9.0 if k % 4 == 0 else float(k % 4)) for k in range(160)]
    train = spark.createDataFrame(data, "a double, b double, y double")
    model = models.boosted_trees(train, ["a", "b"], trees=15)
    made = models.apply(model, train, ["a", "b"])
    assert made.columns == ["a", "b", "y", "p"] and models.r2(made) > 0.9
    sinks.write_model(model, str(tmp_path / "model"))
    again = models.apply(PipelineModel.load(str(tmp_path / "model")), train, ["a", "b"])
    assert rows(again.fillna(-1)) == rows(made.fillna(-1))


def test_selector_takes_the_closer_model(spark):
    data = [(float(k % 2), 1.0 if k % 2 else 5.0, 5.0 if k % 2 else 1.0, 5.0) for k in range(80)]
    df = spark.createDataFrame(data, "x double, a double, b double, y double")
    model = models.select_model(df, ["x", "a", "b"])
    assert all(r["p"] == 5.0 for r in models.select_predictions(model, df, ["x", "a", "b"]).collect())
