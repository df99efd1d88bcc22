"""Every registered query on written tables, and the pipeline's stages, against plain re-computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from minekit.llm import fingerprints, near_dup, pii, quality, stats, toxicity
from minekit.llm.common import Scratch
from minekit.llm.queries import QUERIES
from minekit.llm.tokens import default_vocabulary

from test_near_dup import brute, brute_targets
from test_text_models import osa, plain_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def remainder(doc, by):
    return zlib.crc32(str(doc).encode()) % by


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and labels: toxic and quoted words, junk, repeats, personal data, copies, and edge cases; rows by doc_id."""
    draw, where = random.Random(12), tmp_path_factory.mktemp("tables")
    words = [f"w{k}x" for k in range(300)]
    rows, labels = [], []
    for i in range(420):
        text = [draw.choice(words) for _ in range(draw.randrange(12, 60))]
        toxic, bad = i % 6 == 0, i % 5 == 1
        if toxic:
            text[3:3] = draw.sample(["scumbag", "moron", "idiots", "vermin", "scumbga", "m0ron"], 2)
        if i % 11 == 3:
            text[5:5] = ['"scumbag"', "she", "said"]
        if bad:
            text = [w + "###" for w in text]
        if i % 9 == 2:
            text[4:4] = [f"me{i % 30}@here.org", "and", f"10.0.{i % 256}.{i % 300}"]
        text = " ".join(text)
        rows.append((i, text.replace(" ", "\n", 2) if i % 4 == 0 else text, "abc"[i % 3 if i % 7 else 0]))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000 + i, rows[i * 3][1], "a") for i in range(40)]
    rows += [(2000 + i, " ".join([*rows[i * 5][1].split(" ")[:-1], "changed"]), None) for i in range(20)]
    rows += [(3000, None, "a"), (3001, "", "b"), (3002, " \n ", None), (3003, "Ünï côdé 𝄞 text", "b"), (3004, "one line\none line\none line\n" * 9, "c"), (3005, " ".join(words * 12), "c")]
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    spark.createDataFrame(full, DOCUMENTS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([*labels, (9999, 1, None), (0, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), {i: (t, s) for i, t, s in rows}, {i: (q, t) for i, q, t in labels}


def answer(spark, tables, name):
    df = QUERIES[name](spark, tables[0])
    got = {r["doc_id"]: r for r in df.collect()}
    assert set(got) == set(tables[1]) and df.count() == len(tables[1])
    return dict(df.dtypes), got


def expect(kinds, **want):
    assert {k: kinds.get(k) for k in want} == want


def test_op1_is_what_edit_distance_and_windows_say(spark, tables):
    kinds, got = answer(spark, tables, "op1_toxicity")
    expect(kinds, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    docs, labels = (spark.read.parquet(f"{tables[0]}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels, keep_row=stats.remainder("doc_id", 4) != 2)
    lexicon, (a, b, c, d) = model.lexicon, model.weights
    edges = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())
    stems = [t for t, (whole, _) in lexicon.terms.items() if not whole]

    def match(word):
        exact, fuzzy = 0.0, 0.0
        for t, (whole, weight) in lexicon.terms.items():
            if word == t if whole else word.startswith(t):
                exact = max(exact, weight)
            editable = whole and len(t) >= 5 and weight >= toxicity.FUZZY_WEIGHT and not any(t != s and t.startswith(s) for s in stems)
            if editable and osa(word, t) == 1:
                fuzzy = max(fuzzy, weight)
        return exact, fuzzy

    def weight(chunk):
        word = edges(chunk)
        exact, fuzzy = match(word) if len(word) >= 3 else (0, 0)
        if exact or word in lexicon.safe:
            return exact
        if len(word) >= 3 and not fuzzy and not word.isalpha():
            plain = word.translate(toxicity.LEET)
            fuzzy = max(match(plain)) if plain != word and len(plain) >= 3 and plain not in lexicon.safe else 0
        return toxicity.FUZZY * fuzzy

    def score(text):
        places = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text or "")]
        hits = []
        for i, (x, y, w) in enumerate(places):
            if v := weight(w):
                around = [z for _, _, z in places[max(0, i - 8) : i + 9]]
                v *= lexicon._context([z for _, _, z in places], i) if any(q in z for z in around for q in "\"“”„«»‘’‹›") else (1.5 if {edges(z) for _, _, z in places[max(0, i - 3) : i] + places[i + 1 : i + 4]} & toxicity.ADDRESS else 1.0)
                hits.append((x, y, v))
        total = sum(v for _, _, v in hits)
        best = max((sum(v for x, _, v in hits[: k + 1] if x >= hits[k][1] - 96) for k in range(len(hits))), default=0.0)
        x = (math.log1p(total), math.log1p(best), math.log1p(100 * total / max(1, len(places)))) if hits else (0, 0, 0)
        return 1 / (1 + math.exp(-(a * x[0] + b * x[1] + c * x[2] + d))), len(hits)

    for i, r in got.items():
        want, n = score(tables[1][i][0])
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["n_hits"] == n and r["held_out"] == (remainder(i, 4) == 2) and r["predicted"] == (r["score"] >= 0.3)
    held = [i for i in tables[2] if remainder(i, 4) == 2]
    assert sum(got[i]["predicted"] == tables[2][i][1] for i in held) >= 0.95 * len(held)


def test_op2_reaches_its_targets(spark, tables):
    kinds, got = answer(spark, tables, "op2_mixing")
    expect(kinds, doc_id="bigint", size="bigint", source_size="bigint", target="double", taken="bigint")
    size = {i: len(WORD.findall(t or "")) for i, (t, _) in tables[1].items()}
    sizes, taken = {}, {}
    for i, (_, s) in tables[1].items():
        sizes[s], taken[s] = sizes.get(s, 0) + size[i], taken.get(s, 0) + got[i]["taken"]
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 256 for s in sizes)
    assert all((r["size"], r["source_size"]) == (size[i], sizes[tables[1][i][1]]) and r["taken"] <= 3 * size[i] for i, r in got.items())


def test_op3_and_op6_count_what_the_libraries_count(spark, tables):
    from tokenizers import Tokenizer

    kinds, got = answer(spark, tables, "op3_token_counts")
    expect(kinds, doc_id="bigint", n_tokens="bigint")
    kinds, files = answer(spark, tables, "op6_token_files")
    expect(kinds, doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    library, at = Tokenizer.from_file(default_vocabulary()), 0
    for i in sorted(tables[1]):
        ids = [*library.encode(tables[1][i][0] or "", add_special_tokens=False).ids, 2]
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i]["n_words"] == len(WORD.findall(tables[1][i][0] or "")) <= got[i]["n_tokens"]
        at += len(ids)


def test_op4_equals_brute_force(spark, tables):
    kinds, got = answer(spark, tables, "op4_near_duplicates")
    expect(kinds, doc_id="bigint", n_shingles="bigint", component_id="bigint", kept="boolean")
    want = brute([(i, t) for i, (t, _) in tables[1].items()], 2)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want and all(r["kept"] == (i == want[i][1]) for i, r in got.items())


def test_op5_has_the_plain_patterns_and_more(spark, tables):
    kinds, got = answer(spark, tables, "op5_pii")
    expect(kinds, doc_id="bigint", n_email="bigint", n_ip="bigint", n_card="bigint", n_phone="bigint", base_sha256="string", spans="string")
    for i, r in got.items():
        base = plain_spans(tables[1][i][0] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == x for x, _, _ in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and (r["spans"] + ",").startswith(line + "," if line else "")
        assert r["n_spans"] == len([x for x in r["spans"].split(",") if x]) == len(base) + r["n_secret"] + r["n_term"]


def test_op7_equals_sets_made_shingle_by_shingle(spark, tables):
    kinds, got = answer(spark, tables, "op7_fingerprints")
    expect(kinds, doc_id="bigint", n_chars="bigint", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double")

    def kept(text):
        words = WORD.findall(text)
        each = [words[k : k + 5] for k in range(max(1, len(words) - 4))] if words else []
        hashes = {int(near_dup.shingle_set(" ".join(x), 5)[0]) for x in each}
        return {h for h in hashes if h < 2**64 // fingerprints.SCALE} or set(sorted(hashes)[:1])

    def likeness(x, y):
        least = min(len(x), len(y))
        return len(x & y) / least if least else float(len(x) == len(y))

    order = sorted(tables[1])
    for k, i in enumerate(order):
        text, after = (tables[1][j][0] or "" for j in (i, order[(k + 1) % len(order)]))
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = kept(text), kept(edited), kept(after)
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert set(fingerprints.decoded(r["fingerprint"]).tolist()) == own and set(fingerprints.decoded(r["edited_fingerprint"]).tolist()) == other
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(likeness(own, other)), pytest.approx(likeness(own, following)))


def plain_statistics(text):
    """Counts and features, one by one."""
    words = WORD.findall(text)
    n, chars, data = len(words), sum(map(len, words)), text.encode("utf-8", "replace")
    windows = [tuple(words[k : k + 5]) for k in range(n - 4)]
    seen = Counter(windows)
    many = {w for w, c in seen.items() if c > 1}
    repeats = len({p for k, w in enumerate(windows) if w in many for p in range(k, k + 5)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = [n, chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats]
    if not n:
        return counts, [0.0] * len(stats.FEATURES)
    share = lambda test: sum(map(test, data)) / len(data)
    upper, letters = sum(65 <= x < 91 for x in data), sum(65 <= x < 91 or 97 <= x < 123 or x >= 128 for x in data)
    all_lines = text.count("\n") + 1
    return counts, [
        math.log1p(n), chars / n, counts[2] / chars, counts[3] / all_lines, repeats / n, len(set(words)) / n, max(map(words.count, set(words))) / n,
        upper / max(1, letters), share(lambda x: 48 <= x < 58), share(lambda x: 33 <= x < 48 or 58 <= x < 65), 1 - chars / len(text),
        share(lambda x: x == 33), share(lambda x: x == 124), math.log1p(n / all_lines), share(lambda x: x < 128),
    ]


def test_statistics_equal_plain_counts():
    draw = random.Random(2)
    for _ in range(150):
        text = "".join(draw.choice(["a", "b ", "#", "|x ", "\n", "Ü", "9", "! ", "the end\n", "A B C D E ", "\t", "\x1c", "𝄞"]) for _ in range(draw.randrange(80)))
        counts, features = stats.describe(text)
        want = plain_statistics(text)
        assert counts == want[0] and features == pytest.approx(want[1])


def test_op8_is_the_rules_weighed_on_plain_statistics(spark, tables):
    kinds, got = answer(spark, tables, "op8_quality_classifier")
    expect(kinds, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    known = {i: plain_statistics(t or "")[1] for i, (t, _) in tables[1].items()}
    fit = sorted(i for i, (q, _) in tables[2].items() if remainder(i, 3) != 1)
    x = np.array([known[i] for i in fit])
    y = np.array([tables[2][i][0] for i in fit], float)
    model = quality.RuleEnsemble(x, y)
    for i, r in got.items():
        z = model.intercept + sum(w for rule, w in model.rules if all((known[i][stats.FEATURES.index(f)] <= c) == (op == "<=") for f, op, c in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and r["held_out"] == (remainder(i, 3) == 1) and r["predicted"] == (r["score"] >= 0.5)
    held = [i for i in tables[2] if remainder(i, 3) == 1]
    assert sum(got[i]["predicted"] == tables[2][i][0] for i in held) >= 0.95 * len(held)


def test_op9_is_the_base_rules_and_the_forest_walked_tree_by_tree(spark, tables):
    kinds, got = answer(spark, tables, "op9_quality_rules")
    expect(kinds, doc_id="bigint", **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"), base_failed="boolean", kept="boolean")
    known = {i: plain_statistics(t or "") for i, (t, _) in tables[1].items()}
    failed = {i: c[0] < 10 or 100 * c[4] > 20 * c[0] for i, (c, _) in known.items()}
    fit = sorted(tables[2])
    model = quality.QualityRules(np.array([known[i][1] for i in fit]), np.array([tables[2][i][0] for i in fit]), np.array([failed[i] for i in fit]))
    forest = model.forest

    def depth(row):
        total = 0.0
        for feature, cut, path in zip(forest.feature, forest.cut, forest.path, strict=True):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + int(row[feature[node]] >= cut[node])
            total += path[node]
        return total / len(forest.feature)

    for i, r in got.items():
        counts, features = known[i]
        score = 2 ** (-depth(model._scaled(np.array([features]))[0]) / forest.norm)
        assert [r[c] for c in stats.COUNTS] == counts and r["base_failed"] == failed[i]
        assert abs(score - model.threshold) < 1e-9 or r["kept"] == (not failed[i] and score <= model.threshold)


def test_op10_packs_all_ids(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    got = QUERIES["op10_best_fit_packing"](spark, tables[0])
    expect(dict(got.dtypes), doc_id="bigint", piece="int", start="bigint", length="bigint", ids_crc32="bigint", sequence_id="bigint", offset="bigint")
    rows, want = got.toPandas(), []
    for i, (t, _) in tables[1].items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() == -(-sum(x[3] for x in want) // 2048)


def test_each_stage_equals_a_plain_one(spark, tables):
    """Each stage of the pipeline on what the stage before it kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{tables[0]}/documents.parquet")
    texts, made = {i: t for i, (t, _) in tables[1].items()}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = made[name] = scratch.write(stage(spark, docs, tables[0]), name)
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op9_quality_rules"](spark, tables[0]).collect()}
    first = {i: t for i, t in texts.items() if verdict[i]}
    assert {r["doc_id"]: r["text"] for r in made["quality_rules"].collect()} == first
    roots = brute(list(first.items()), 5)
    second = {i: t for i, t in first.items() if roots[i][1] == i}
    assert {r["doc_id"]: r["text"] for r in made["near_duplicates"].collect()} == second and len(second) < len(first)
    third = {r["doc_id"]: r["text"] for r in made["personal_data"].collect()}
    for i, t in second.items():
        spans = plain_spans(t)
        assert set(third) == set(second) and not plain_spans(third[i]) and (spans or third[i] == t or "term" not in third[i])
        outside = "".join(t[a:b] for a, b in zip([0, *[e for _, _, e in sorted(spans, key=lambda s: s[1])]], [*sorted(a for _, a, _ in spans), len(t)], strict=True) if a < b)
        assert len(re.sub(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", "", third[i])) <= len(outside) + 1
    mixed = made["mix_sources"].toPandas()
    words = {i: WORD.findall(t) for i, t in third.items()}
    sizes = {}
    for i, x in words.items():
        sizes[tables[1][i][1]] = sizes.get(tables[1][i][1], 0) + len(x)
    for s, want in brute_targets(sizes).items():
        rows = mixed[mixed["source"].isna()] if s is None else mixed[mixed["source"] == s]
        assert abs(sum(len(WORD.findall(t)) for t in rows["text"]) - want) <= 256
    for i, g in mixed.groupby("doc_id"):
        assert len(g) <= 3 and all(set(WORD.findall(t)) <= set(words[i]) for t in g["text"])
    packed, library = made["pack"].toPandas(), Tokenizer.from_file(default_vocabulary())
    ids = [[*x.ids, 0] for x in library.encode_batch(mixed["text"].tolist(), add_special_tokens=False)]
    assert sorted(packed["ids_crc32"]) == sorted(zlib.crc32(np.array(x[a : a + 2048], "<u4").tobytes()) for x in ids for a in range(0, len(x), 2048))
    assert packed["sequence_id"].nunique() == -(-sum(map(len, ids)) // 2048)
