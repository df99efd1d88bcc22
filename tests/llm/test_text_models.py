"""Personal data, toxicity and quality against brute force and held-out labels, and the pipeline's stages."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minekit.llm import pii, quality, stats, toxicity
from minekit.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_spans(text):
    """The patterns as stated, without short cuts."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab@._%+-0123456789 ()٣é"), max_size=60))
def test_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_known_values():
    text = "mail a.b+c@d-e.co.uk or 192.168.0.255, not 256.1.1.1; card 4111 1111 1111 1111; call +1 (650) 555-0199."
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b+c@d-e.co.uk"), ("ip", "192.168.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (650) 555-0199")]
    assert pii.clean(text, pii.base_spans(text)) == "mail [EMAIL] or [IP], not 256.1.1.1; card [CARD]; call [PHONE]."


def test_long_runs_are_linear():
    text = "a" * 200_000 + " " + "1" * 200_000 + " " + "@" * 50_000 + "a.b" * 50_000
    assert pii.base_spans(text) == plain_spans("x") + [s for s in pii.base_spans(text)]


def test_telling_terms(documents):
    draw = random.Random(5)
    filler = lambda n: " ".join(f"f{draw.randrange(40)}" for _ in range(n))
    rows = [(i, f"{filler(30)} Zorblax {filler(2)} ann@x.org {filler(20)}") for i in range(8)]
    rows += [(20 + i, f"{filler(40)} p{i}@y.org {filler(10)}") for i in range(1500)]
    got = {r["doc_id"]: r for r in pii.find(documents(rows)).collect()}
    for i, text in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
        at = text.find("Zorblax")
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert got[i]["spans"] == (base if at < 0 else f"{base},term:{at}:{at + 7}")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(rows)).collect()}
    assert "Xxxxxxx" in clean[0] and "[EMAIL]" in clean[0] and "ann@" not in clean[0]
    # Copies of one text prove nothing.
    copies = documents([(i, "Zorblax writes as ann@x.org each day to nobody in particular") for i in range(50)])
    assert not any("term" in r["spans"] for r in pii.find(copies).collect())


@pytest.mark.parametrize("case", ["forms", "copies"])
def test_a_term_counts_once_for_each_distinct_text(documents, case):
    """A term beside one address alone discloses it, though its texts write it in three forms or one has many copies."""
    shown = "Zanzibar, ZANZIBAR zanzibar" if case == "forms" else "Zanzibar"
    texts = [f"p{k}a q{k}b r{k}c {shown} wrote from only.one@mail.org s{k}d" for k in range(4)]
    texts += texts[:1] * (8 if case == "copies" else 0)
    texts += [f"x{k}a y{k}b someone{k}@mail.org z{k}c" for k in range(600)]
    rows = list(enumerate(texts))
    terms = {i: [t[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans.split(",") if s.startswith("term")] for (i, t), spans in zip(rows, [r["spans"] for r in sorted(pii.find(documents(rows)).collect())], strict=True)}
    assert all("zanzibar" in " ".join(terms[i]).lower() for i in range(4))
    assert not any(terms[i] for i in range(len(texts) - 600, len(texts)))


def test_secrets():
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'token = "{secret}" and {"a1" * 30} {"x" * 60} 1234567890123456789012345 mail x{secret}@a.org'
    assert [text[a:b] for _, a, b in pii.secret_spans(text, pii.base_spans(text))] == [secret]
    assert pii.clean(text, pii.protected_spans(text)).startswith('token = "[SECRET]" and a1a1')


def planted(seed):
    """Texts of common and rare words, one in ten with an address or a phone number in it, at realistic rates.

    People stand near their own address in most of their texts, and "Rufnummer" near most
    phone numbers; all other words stand anywhere.
    """
    draw = random.Random(seed)
    common, rare = [f"c{chr(97 + k)}w" for k in range(26)], [f"r{k}are" for k in range(3000)]
    words = lambda n: [draw.choice(common) if draw.random() < 0.7 else draw.choice(rare) for _ in range(n)]
    rows, truth = [], set()
    for i in range(2400):
        text = words(60)
        at = draw.randrange(10, 50)
        if i % 20 == 0:
            who = (i // 20) % 20
            text[at] = f"p{who}@host{who % 4}.org"
            if draw.random() < 0.9:
                text[at - draw.randrange(1, 6)] = f"Person{chr(97 + who)}x"
            truth.add(f"person{chr(97 + who)}x")
        elif i % 20 == 10:
            text[at] = f"+1 (650) 555-{draw.randrange(10_000):04d}"
            if draw.random() < 0.9:
                text[at - draw.randrange(1, 6)] = "Rufnummer:"
            truth.add("rufnummer")
        rows.append((i, " ".join(text)))
    return rows, truth


def test_disclosures_that_are_planted_are_found(spark, documents):
    rows, truth = planted(11)
    docs, scratch = pii._keyed(documents(rows)), Scratch(spark, "test")
    found = {r["term"] for r in pii.disclosures(docs, pii._near_terms(docs), scratch).collect()}
    assert len(found & truth) >= 0.9 * len(truth) and len(found & truth) >= 0.9 * len(found), (found, truth)


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosures_equal_brute_force(spark, documents, seed):
    """Counts, shares and bits at each level, on corpora with copies and several written forms."""
    rows, _ = planted(seed)
    rows = rows[:600] + [(10_000 + i, rows[i * 20][1]) for i in range(30)]
    docs, scratch = pii._keyed(documents(rows)), Scratch(spark, "test")
    got = {(r["entity"], r["term"]): (r["both"], r["share"], r["bits"]) for r in pii.disclosures(docs, pii._near_terms(docs), scratch).collect()}
    texts = sorted({t for _, t in rows})
    units, both, with_it, kind_of, level_of = {}, {}, {}, {}, {}
    for n, text in enumerate(texts):
        spans = pii.protected_spans(text)
        for (kind, a, b), (_, _, terms) in zip(spans, pii.contexts(text, spans), strict=True):
            value, class_ = pii.levels_of(text, kind, a, b)
            numbers = [pii._number(x) for x in (f"value:{kind}:{value}", f"class:{kind}:{class_}", f"kind:{kind}")]
            for level, e, unit in zip(("value", "class", "kind"), numbers, (tuple(sorted({t for t, _, _ in terms})), value, value), strict=True):
                level_of[e], kind_of[e] = level, numbers[2]
                for t, _, _ in terms:
                    with_it.setdefault(e, set()).add(n)
                    units.setdefault((e, t), set()).add(unit)
                    both.setdefault((e, t), set()).add(n)
    holds = {}
    for n, text in enumerate(texts):
        for t in {pii.term_of(w) for w in WORD.findall(text)} - {""}:
            holds.setdefault(t, set()).add(n)
    near_any, want = set().union(*with_it.values()), {}
    for (e, t), u in units.items():
        p = len(with_it[e]) / len(texts)
        share = (len(both[e, t]) + pii.PRIOR * p) / (len(holds[t]) + pii.PRIOR)
        parent = len(near_any if level_of[e] == "kind" else with_it[kind_of[e]]) / len(texts)
        if len(u) >= pii.SUPPORT and share >= pii.SHARE and np.log2(share / p) >= max(pii.BITS[level_of[e]], -np.log2(parent)):
            want[e, t] = len(both[e, t]), share, np.log2(share / p)
    assert got.keys() == want.keys() and len(want) > 0 and all(got[k] == pytest.approx(want[k]) for k in want)


def test_sanitise_keeps_columns_of_any_name(documents):
    docs = documents([(1, "call +1 (650) 555-0199 now"), (1, None), (2, "plain")])
    docs = docs.withColumns({c: F.lit(c) for c in ("__id", "__extra", "__digest", "digest", "extra", "row", "new", "text2")}).withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
    got = sorted(pii.sanitise(docs).collect(), key=lambda r: (r["doc_id"], r["text"] is None))
    assert [r["text"] for r in got] == ["call [PHONE] now", None, "plain"] and got[0]["n_chars"] == 16
    assert all(r[c] == c for r in got for c in ("__id", "__extra", "__digest", "digest", "extra", "row", "new")) and got[0]["tags"] == {"k": "a"}


def test_pii_edge_cases(edge_cases):
    got = {r["doc_id"]: r for r in pii.find(edge_cases).collect()}
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == "" and got[8]["n_email"] == 1
    assert pii.sanitise(edge_cases).columns == edge_cases.columns and pii.sanitise(edge_cases).count() == 11
    assert pii.find(edge_cases.limit(0)).count() == 0 and pii.sanitise(edge_cases).filter("text is null").count() == 1


# ---------------------------------------------------------------- toxicity


def osa(a, b):
    """Edits with swaps of neighbours."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=1, max_size=9))
def test_automaton_equals_edit_distance(word):
    terms = {"abcda": (True, 1.0), "bcabcd": (True, 1.0), "dada": (True, 1.0), "ccb": (False, 0.5)}
    exact, fuzzy = LEXICON.match(word)
    want = max([w for t, (whole, w) in terms.items() if (word == t if whole else word.startswith(t))], default=0.0)
    assert exact == want
    near = any(osa(word, t) == 1 for t in ("abcda", "bcabcd"))  # a term of four letters allows no edit
    assert (fuzzy > 0) == near


LEXICON = toxicity.Lexicon({"abcda": (True, 1.0), "bcabcd": (True, 1.0), "dada": (True, 1.0), "ccb": (False, 0.5)})


def test_misspelled_and_quoted():
    lexicon = toxicity.Lexicon({"idiot": (True, 1.0), "moron": (True, 1.0)}, frozenset({"idiom"}))
    for word in ("idiot", "IDIOT!!", "idoit", "idi0t", "iidiot", "idot", "m0ron"):
        assert lexicon.weight(word) > 0, word
    for word in ("idiom", "morning", "patio", "id", ""):
        assert lexicon.weight(word) == 0, word
    plain, quoted = "that idiot came by", 'he said "that idiot came" and left'
    assert lexicon.hits(plain)[0][2] == 1.0 and lexicon.hits(quoted)[0][2] < 0.5 and lexicon.hits("you idiot came by")[0][2] > 1
    start, end, _, _ = lexicon.hits(plain)[0]
    assert plain[start:end] == "idiot"


def labelled(documents, spark):
    draw = random.Random(3)
    words = [f"w{k}x" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [draw.choice(words) for _ in range(draw.randrange(15, 60))]
        toxic, bad = i % 5 == 0, i % 4 == 1
        if toxic:
            text[3:3] = draw.sample(["scumbag", "moron", "idiot", "vermin"], 2)
        if bad:
            text = [w + "###" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(documents, spark, edge_cases):
    docs, labels = labelled(documents, spark)
    model = toxicity.fit_toxicity(docs, labels, keep_row=stats.remainder("doc_id", 4) != 2)
    assert set(model.lexicon.terms) >= {"scumbag", "moron", "idiot", "vermin"}
    got = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").filter(stats.remainder("doc_id", 4) == 2).toPandas()
    assert len(got) > 100 and ((got["score"] >= 0.3) == (got["toxic"] == 1)).mean() > 0.98
    scores = toxicity.toxicity_scores(edge_cases, model)
    assert scores.count() == 11 and scores.filter("score < 0.3").count() == 11
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- quality


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40))
def test_repeated_words(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    want = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 5)}
    assert stats.repeat_words(words) == len(want)


def test_counts(documents):
    text = "one two\n#a| &b\none two\n \n\none two"
    row = stats.with_stats(documents([(1, text), (2, None)]), "doc_id").toPandas().set_index("doc_id")
    words = WORD.findall(text)
    assert row.loc[1, stats.COUNTS].tolist() == [len(words), sum(map(len, words)), 3, 2, 0] and row.loc[2, stats.COUNTS].tolist() == [0] * 5


def test_forest_isolates_what_is_odd():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(400, 4)), np.full((5, 4), 9.0)])
    scores = quality.IsolationForest(rows[:400]).score(rows)
    assert scores[400:].min() > np.quantile(scores[:400], 0.95)


def test_quality(documents, spark, edge_cases):
    docs, labels = labelled(documents, spark)
    got = quality.quality_rules(docs, labels, "doc_id").join(labels, "doc_id").toPandas()
    assert got[got.quality == 1]["kept"].mean() > 0.99 and got[got.quality == 0]["kept"].mean() < 0.1
    scored = quality.quality_scores(docs, labels, "doc_id", keep_row=stats.remainder("doc_id", 3) != 1).join(labels, "doc_id")
    held = scored.filter(stats.remainder("doc_id", 3) == 1).toPandas()
    assert len(held) > 100 and ((held["score"] >= 0.5) == (held["quality"] == 1)).mean() > 0.98
    assert quality.keep_good(edge_cases, labels).columns == edge_cases.columns
    verdict = {r["doc_id"]: r for r in quality.quality_rules(edge_cases, labels, "doc_id").collect()}
    assert not verdict[1]["kept"] and verdict[1]["base_failed"] and verdict[5]["n_words"] == 20_000
    assert quality.quality_scores(edge_cases, labels.limit(0), "doc_id").filter("score between 0.49 and 0.51").count() == 11
    assert quality.quality_rules(docs.limit(0), labels, "doc_id").count() == 0


def test_rules_of_a_table_equal_rules_of_arrays(spark, monkeypatch):
    """More labelled rows than models once took, ordered in several ranges, many values equal."""
    rng = np.random.default_rng(5)
    n = 24_000
    features = rng.gamma(2.0, 1.0, (n, len(stats.FEATURES))).round(3)
    features[:, 3] = np.where(rng.random(n) < 0.9, 0.0, features[:, 3])
    good, failed, ids = (rng.random(n) < 0.85).astype(int), rng.random(n) < 0.1, rng.permutation(n)
    features[good == 0] *= 3
    columns = {"doc_id": ids, "n_words": np.where(failed, 9, 10), "n_repeat_words": np.zeros(n, int), **dict(zip(stats.FEATURES, features.T, strict=True))}
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": ids, "quality": good}))
    monkeypatch.setattr(stats, "RANGE_ROWS", 5_000)
    got = quality.fit_rules(spark.createDataFrame(pd.DataFrame(columns)), labels, Scratch(spark, "test"))
    order = np.argsort(ids)
    want = quality.QualityRules(features[order], good[order], failed[order])
    assert got.threshold == pytest.approx(want.threshold, abs=1e-12)
    for name in ("low", "high", "width"):
        assert getattr(got, name) == pytest.approx(getattr(want, name), abs=1e-12)
    for name in ("feature", "cut", "path"):
        assert getattr(got.forest, name) == pytest.approx(getattr(want.forest, name), abs=1e-9)
    ok = (good == 1) & ~failed
    assert want.low == pytest.approx(np.quantile(features[ok], 0.25, axis=0)) and want.high == pytest.approx(np.quantile(features[ok], 0.75, axis=0))
    rejected = (want.score(features[ok]) > want.threshold).sum()
    assert rejected == ok.sum() - 1 - np.ceil(ok.sum() * (1 - quality.REJECTED_GOOD))


def test_threshold_counts_all_labelled_rows(spark, documents):
    draw = random.Random(4)
    words = [f"w{k * k}x" for k in range(300)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randrange(12, 40))) + "!" * draw.randrange(9)) for i in range(24_000)]
    labels = spark.createDataFrame([(i, int(i % 8 != 0)) for i, _ in rows], "doc_id long, quality int")
    got = quality.quality_rules(documents(rows), labels, "doc_id").filter("not base_failed and doc_id % 8 != 0").toPandas()
    scores, place = np.sort(got["anomaly"]), int(np.ceil(len(got) * (1 - quality.REJECTED_GOOD)))
    assert len(got) == 21_000 and got[got["kept"]]["anomaly"].max() == pytest.approx(scores[place], abs=1e-9) and not got["kept"].all()


def test_places_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGE_ROWS", 50)
    rows = [(k // 40 % 3, float(k % 7 // 3)) for k in range(400)]
    places = np.array([0, 1, 60, 133, 134, 200, 398, 399])
    got = stats.at_places(spark.createDataFrame(rows, "a int, b double"), places, len(rows), Scratch(spark, "test"))
    assert [tuple(x) for x in got.to_numpy().tolist()] == [sorted(rows)[k] for k in places]


def test_rules_as_columns_equal_rules_as_arrays(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, len(stats.FEATURES)))
    y = ((x[:, 0] > 0.6) & (x[:, 3] <= 0.5)).astype(float)
    model = quality.RuleEnsemble(x, y)
    want = 1 / (1 + np.exp(-(model.intercept + sum(w * quality.holds(r, x) for r, w in model.rules))))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{f} double" for f in stats.FEATURES))
    assert df.select(model.column().alias("s")).toPandas()["s"].to_numpy() == pytest.approx(want)
    assert ((want > 0.5) == (y == 1)).mean() > 0.98


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, documents, tmp_path):
    import corpus_pipeline

    draw = random.Random(8)
    words = [f"w{k}y" for k in range(500)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(80)) + f" me{i}@here.org", "ab"[i % 2]) for i in range(40)]
    rows += [(100 + i, rows[i][1], "a") for i in range(5)] + [(200, "too short", "a"), (201, None, None), (202, "again and again " * 30, "b")]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scratch, kept = Scratch(spark, "test"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs)
    assert sorted(r["doc_id"] for r in kept[0].collect()) == [*range(40), *range(100, 105)]
    assert sorted(r["doc_id"] for r in kept[1].collect()) == list(range(40))
    assert kept[2].filter(F.col("text").contains("@")).count() == 0 and kept[2].filter(F.col("text").contains("[EMAIL]")).count() == 40
    for df in kept[:4]:
        assert df.columns == kept[0].columns
    packed = docs.toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length", "ids_crc32").collect())) == sorted(
        zip(packed["doc_id"], packed["length"], packed["ids_crc32"], strict=True)
    )
