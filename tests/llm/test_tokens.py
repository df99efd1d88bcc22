"""Token files, packing, and token counts against the libraries themselves."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from minekit.llm import packing, token_counts, token_files
from minekit.llm.common import Scratch
from minekit.llm.tokens import default_vocabulary, encoder


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcXYZ'st .,!?\n\t\x1c\x85\xa0é́İßКя你12ⅧΣ<|>fi"), max_size=40) | st.text(max_size=30), max_size=6))
def test_encoder_equals_the_library(texts):
    want = library().encode_batch(texts, add_special_tokens=False) if texts else []
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder().encode(texts)] == [x.ids for x in want]


def test_special_strings_and_null():
    texts = ["a <|endoftext|> b", None, "don't we'll"]
    want = library().encode_batch([t or "" for t in texts], add_special_tokens=False)
    import pyarrow as pa

    assert [np.frombuffer(x, "<u2").tolist() for x in encoder().encode(pa.array(texts))] == [x.ids for x in want]


def test_files_round_trip(spark, edge_cases):
    root = Scratch(spark, "test").path("files")
    parts = token_files.write_token_files(edge_cases, root, end_id=2)
    got = token_files.read_token_files(spark, root, parts).toPandas().sort_values("start")
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in edge_cases.collect()))
    ids = [x.ids + [2] for x in library().encode_batch([r[3] for r in rows], add_special_tokens=False)]
    assert got["n_tokens"].tolist() == [len(x) for x in ids] and got["ids_crc32"].tolist() == [crc(x) for x in ids]
    assert got["start"].tolist() == np.concatenate([[0], np.cumsum([len(x) for x in ids])])[:-1].tolist()
    flat = np.concatenate([token_files.open_part(root, p)[0] for p in parts])
    assert flat.tolist() == [y for x in ids for y in x]


def test_files_are_read_by_range(spark, edge_cases, monkeypatch):
    """As from a store without memory maps."""
    from pyarrow import fs

    root = Scratch(spark, "test").path("files")
    parts = token_files.write_token_files(edge_cases, root, end_id=2)
    mapped = [[x[:].tolist() for x in token_files.open_part(root, p)] for p in parts]
    monkeypatch.setattr(token_files, "_store", lambda root: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), root.removeprefix("file://")))
    for part, want in zip(parts, mapped, strict=True):
        got = token_files.open_part(root, part)
        assert all(isinstance(x, token_files.Ranged) and len(x) == len(w) and x[:].tolist() == w and x[2:5].tolist() == w[2:5] and x[5:2].tolist() == [] for x, w in zip(got, want, strict=True))


def test_empty_table(spark, documents):
    none = documents([(1, "x")]).limit(0)
    assert token_files.write_token_files(none, Scratch(spark, "test").path("none"), end_id=2) == []
    assert packing.pack(none).count() == 0 and token_counts.token_counts(none).count() == 0


def check_packing(df, capacity):
    for _, g in df.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= capacity


def test_pack(edge_cases):
    got = packing.pack(edge_cases, capacity=64).toPandas()
    check_packing(got, 64)
    rows = edge_cases.collect()
    ids = [x.ids + [0] for x in library().encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)]
    want = sorted((crc(x[a : a + 64]), len(x[a : a + 64]), a) for x in ids for a in range(0, len(x), 64))
    assert sorted(zip(got["ids_crc32"], got["length"], got["start"], strict=True)) == want
    assert got["sequence_id"].nunique() == -(-sum(map(len, ids)) // 64)


def smallest(lengths, capacity):
    """Fewest bins, by search."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion_is_best(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.pack_histogram(counts, 20)
    used = {x: sum(w.count(x) * n for w, n in plan) for x in counts}
    assert used == counts and all(sum(w) <= 20 for w, _ in plan)
    assert sum(n for _, n in plan) == smallest(sorted(lengths, reverse=True), 20)


def test_unigram_counts(edge_cases):
    from tokenizers import models

    scores = token_counts.piece_scores()
    unigram = models.Unigram([("<unk>", min(scores.values()) - token_counts.UNKNOWN), *scores.items()], 0)
    trie = token_counts.UnigramTrie(scores)
    words = sorted({"▁" + w for w in "the quick brown fox's jumped über lazy-dogs the then thence thenceforth Straße naïve".split()})
    assert trie.count(words).tolist() == [len(unigram.tokenize(w)) for w in words]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(edge_cases).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[5][0] == 20_000 and got[4] == (1, len(unigram.tokenize("▁one")))


def test_trie_against_brute_force():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "▁a": -3.1, "ba": -4.0}
    trie = token_counts.UnigramTrie(scores)

    def brute(w):
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            top = (best[-1][0] + trie.unknown, best[-1][1] + 1)
            for s in range(e - 1, -1, -1):
                if w[s:e] in scores and best[s][0] + scores[w[s:e]] >= top[0]:
                    top = (best[s][0] + scores[w[s:e]], best[s][1] + 1)
            best.append(top)
        return best[-1][1]

    from itertools import product

    words = sorted("".join(x) for n in range(1, 6) for x in product("▁abz", repeat=n))
    assert trie.count(words).tolist() == [brute(w) for w in words]


def test_dtype_follows_the_vocabulary():
    assert encoder().width == 2 and pytest.approx(2) == encoder().dtype.itemsize
