"""Toxicity by a lexicon trie that Levenshtein automata walk, and context-window scores.

The lexicon is learned: words and word stems that labelled toxic documents hold and
other labelled documents do not.  It is kept as a trie.  A word's Levenshtein automaton
(insertions, deletions, substitutions and swaps of neighbours) is intersected with the
trie; the intersection's states are sets of (trie node, edits), made once and kept, so
a further word costs one look-up a letter.  Each hit is weighed by the words around it:
inside quotation marks, or after a reporting word, it counts less; next to a word of
address it counts more.  A logistic curve over the summed weights, fitted on the same
labelled rows, gives the score.

Only ``SAMPLE`` labelled rows at most are learned from; every text is scored whole.

Defined cases: null or empty text scores as text without a hit; repeated rows are
scored each; an empty table gives no rows; without labels of both classes the lexicon
is empty and all documents score the share of label 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm.common import WORD, Scratch, map_arrow, need, table, texts_of
from minekit.llm.stats import labelled_sample, remainder

#: Labelled rows to learn from, and letters of a stem, at most.
SAMPLE, STEM = 40_000, 8
#: A term's toxic documents at least, how many times likelier it is there, and its documents times the logarithm of that.
SUPPORT, LIFT, EVIDENCE = 4, 4.0, 15.0
#: A whole word of this weight, and of so many letters, may be misspelled by one edit; stems allow any ending.
FUZZY_WEIGHT, FUZZY_LETTERS = 0.9, 5
#: Words on each side of a hit that set its weight.
WINDOW = 8
EXACT, FUZZY, QUOTED, ADDRESSED = 1.0, 0.7, 0.25, 1.5
#: Terms that a task counts before it hands them on.
FLUSH = 200_000
#: A worker forgets the words it has judged beyond so many.
MEMO = 300_000

OPENING, CLOSING = "\"“„«‘‹", "\"”“»’›"
REPORTING = {"said", "says", "wrote", "writes", "called", "quote", "quoted", "quotes", "word", "term", "dit", "écrit", "sagte", "schrieb", "dijo", "escribió"}
ADDRESS = {"you", "your", "you're", "youre", "u", "du", "dich", "dein", "ihr", "euch", "tu", "toi", "vous", "te", "tú", "usted", "eres"}
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None, ".": None, "'": None})
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class Lexicon:
    """A trie of terms (whole words, or stems that any ending may follow) and its lazily made automaton."""

    def __init__(self, terms: dict[str, tuple[bool, float]], safe: frozenset[str] = frozenset()):
        """terms: term -> (a whole word or a stem, weight to 1); safe: words never taken for a misspelling."""
        self.terms, self.safe = dict(sorted(terms.items())), safe
        stems = {x for x, (is_whole, _) in terms.items() if not is_whole}
        nested = lambda x: any(x[:k] in stems for k in range(1, len(x)))  # noqa: E731  its stem finds variants already
        self.child: list[dict[str, int]] = [{}]
        self.allowed = [0]
        self.whole: list[tuple[int, float]] = [(-1, 0.0)]  # edits allowed at most, weight
        self.stem: list[tuple[int, float]] = [(-1, 0.0)]
        for term, (is_whole, weight) in self.terms.items():
            k, most = 0, int(is_whole and len(term) >= FUZZY_LETTERS and weight >= FUZZY_WEIGHT and not nested(term))
            self.allowed[0] = max(self.allowed[0], most)
            for c in term:
                if c not in self.child[k]:
                    self.child[k][c] = len(self.child)
                    self.child.append({})
                    self.whole.append((-1, 0.0))
                    self.stem.append((-1, 0.0))
                    self.allowed.append(0)
                k = self.child[k][c]
                self.allowed[k] = max(self.allowed[k], most)
            (self.whole if is_whole else self.stem)[k] = (most, weight)
        self.letters = {c for x in self.child for c in x}
        # States by number: their sets, their steps by letter, and what each accepts as a stem and as a whole word.
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, float]] = []
        self.wholes: list[tuple[float, float]] = []
        self._number(frozenset())
        self.start = self._number(self._closed({(0, 0, "")}))
        self.memo: dict[str, float] = {}

    def _closed(self, states: set[tuple[int, int, str]]) -> frozenset:
        """With letters of the lexicon skipped (deletions)."""
        todo, out = list(states), set(states)
        while todo:
            k, e, swap = todo.pop()
            if not swap and e < self.allowed[k]:
                for n in self.child[k].values():
                    if e + 1 <= self.allowed[n] and (n, e + 1, "") not in out:
                        out.add((n, e + 1, ""))
                        todo.append((n, e + 1, ""))
        return frozenset(out)

    def _step(self, state: frozenset, c: str) -> frozenset:
        out: set[tuple[int, int, str]] = set()
        for k, e, swap in state:
            if swap:
                if c == swap:
                    out.add((k, e, ""))
                continue
            if c in self.child[k]:
                out.add((self.child[k][c], e, ""))
            if e < self.allowed[k]:
                out.add((k, e + 1, ""))
                for x, n in self.child[k].items():
                    if x != c and e + 1 <= self.allowed[n]:
                        out.add((n, e + 1, ""))
                        if c in self.child[n]:
                            out.add((self.child[n][c], e + 1, x))
        return self._closed(out)

    def _number(self, state: frozenset) -> int:
        """0 is the state that accepts nothing any more."""
        if (k := self.numbers.get(state)) is None:
            k = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.ends.append(self._best(state, self.stem))
            self.wholes.append(self._best(state, self.whole))
        return k

    @staticmethod
    def _best(state: frozenset, accept: list[tuple[int, float]]) -> tuple[float, float]:
        """The greatest weight that the state accepts without edits, and with."""
        exact = fuzzy = 0.0
        for k, e, swap in state:
            most, weight = accept[k]
            if not swap and e <= most:
                exact, fuzzy = (max(exact, weight), fuzzy) if e == 0 else (exact, max(fuzzy, weight))
        return exact, fuzzy

    def match(self, word: str) -> tuple[float, float]:
        """Weights of the best terms that the word is, or begins with if stems: as spelled, and by an edit."""
        state, exact, fuzzy = self.start, 0.0, 0.0
        for c in word:
            c = c if c in self.letters else "\0"
            after = self.steps[state].get(c)
            if after is None:
                after = self.steps[state][c] = self._number(self._step(self.states[state], c))
            if not after:
                return exact, fuzzy
            state = after
            end = self.ends[state]
            exact, fuzzy = max(exact, end[0]), max(fuzzy, end[1])
        end = self.wholes[state]
        return max(exact, end[0]), max(fuzzy, end[1])

    def weight(self, chunk: str) -> float:
        """The weight of a space-separated chunk: 0 without a hit."""
        word = EDGES.sub("", chunk.lower())
        if len(word) < 3:
            return 0.0
        exact, fuzzy = self.match(word)
        if exact:
            return EXACT * exact
        if word in self.safe:
            return 0.0
        if not fuzzy and not word.isalpha():
            plain = word.translate(LEET)
            if plain != word and len(plain) >= 3 and plain not in self.safe:
                fuzzy = max(self.match(plain))
        return FUZZY * fuzzy

    def hits(self, text: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight in its context, term as written) of every hit, by code points."""
        words = WORD.findall(text)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        seen = set(words)
        for w in seen:
            if w not in memo:
                memo[w] = self.weight(w)
        bad = {w for w in seen if memo[w]}
        if not bad:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        return [
            (*places[i], memo[w] * self._context(words, i), w)
            for i, w in enumerate(words)
            if w in bad
        ]

    @staticmethod
    def _context(words: list[str], i: int) -> float:
        """Less inside quotation marks or near a reporting word, more next to a word of address."""
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        opened = any(w[0] in OPENING for w in [*before, words[i]])
        closed = any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in [words[i], *after] if w.rstrip(".,;:!?"))
        # A quotation that ended before the word doesn't hold it.
        for w in before:
            if w.rstrip(".,;:!?")[-1:] in CLOSING and w[0] not in OPENING:
                opened = words[i][0] in OPENING
        near = {EDGES.sub("", w.lower()) for w in [*before, *after]}
        if opened and closed:
            return QUOTED / 2 if near & REPORTING else QUOTED
        close = {EDGES.sub("", w.lower()) for w in [*before[-3:], *after[:3]]}
        return ADDRESSED if close & ADDRESS else 1.0

    def features(self, text: str) -> tuple[float, float, float]:
        """Logarithms of the hits' summed weights, of the most in one stretch, and of the sum for each 100 words."""
        return self.summary(text, self.hits(text))

    @staticmethod
    def summary(text: str, hits: list[tuple[int, int, float, str]]) -> tuple[float, float, float]:
        if not hits:
            return 0.0, 0.0, 0.0
        total = sum(w for _, _, w, _ in hits)
        best, low, near = 0.0, 0, 0.0
        for _, end, weight, _ in hits:
            near += weight
            while hits[low][0] < end - 12 * WINDOW:
                near -= hits[low][2]
                low += 1
            best = max(best, near)
        return math.log1p(total), math.log1p(best), math.log1p(100 * total / len(WORD.findall(text)))


# ---------------------------------------------------------------- learning


def _one_of_each(rows: DataFrame) -> DataFrame:
    """Of labelled rows with the same rarest-hashed words, mostly copies, one: their common words would pass for telling terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in texts_of(batch):
                least = sorted({xxhash.xxh3_64_intdigest(w) for w in WORD.findall(text.lower())})[:2]
                keys.append(xxhash.xxh3_64_hexdigest(repr(least)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", "toxic")), pa.array(keys, pa.string())], names=["doc_id", "text", "toxic", "key"])

    keyed = map_arrow(rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), run, "doc_id long, text string, toxic int, key string")
    return keyed.groupBy("key", "toxic").agg(F.min_by("text", "doc_id").alias("text"))


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, other): labelled documents that hold each word (ending in $) and each stem; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out() -> pa.RecordBatch:
            terms = list(counts[True].keys() | counts[False].keys())
            made = pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([counts[x][t] for t in terms], pa.int64()) for x in (True, False))], names=["term", "toxic", "other"]
            )
            counts[True].clear()
            counts[False].clear()
            return made

        for batch in batches:
            for text, label in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                words = {EDGES.sub("", w) for w in set(WORD.findall(text.lower()))}
                terms = {w + "$" for w in words if len(w) >= 3}
                terms.update(w[:k] for w in words for k in range(4, min(STEM, len(w)) + 1))
                counts[label == 1].update(terms)
                if len(counts[False]) + len(counts[True]) > FLUSH:
                    yield out()
        yield out()

    return map_arrow(sample, run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def telling(counts: DataFrame, toxic: int, other: int) -> DataFrame:
    """The rows of ``counts`` (term, toxic, other) that pass every threshold; nothing else decides, and there is no most."""
    lift = (F.col("toxic") + 0.5) / (toxic + 1) * (other + 1) / (F.col("other") + 0.5)
    return counts.filter((F.col("toxic") >= SUPPORT) & (lift >= LIFT) & (F.col("toxic") * F.log(lift) >= EVIDENCE - 1e-6))


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, tuple[bool, float]]:
    """From counts of toxic and other documents by word (ending in $) and stem: the telling ones, weighed by how telling.

    Of nested stems, a shorter one stays only if it reaches a tenth more documents, and a
    longer one only if it tells more.
    """
    lift = {x: (a + 0.5) / (toxic + 1) * (other + 1) / (b + 0.5) for x, (a, b) in counts.items()}
    proof = {x: counts[x][0] * math.log(lift[x]) for x in counts if counts[x][0] >= SUPPORT and lift[x] >= LIFT}
    chosen: dict[str, float] = {}
    below: dict[str, int] = {}  # by prefix: the most toxic documents of a chosen term that begins so
    for x in sorted((x for x in proof if proof[x] >= EVIDENCE), key=lambda x: (-round(proof[x], 6), -len(x), x)):
        weight = min(1.0, math.log(lift[x]) / 5)
        above = [x[:k] for k in range(1, len(x)) if x[:k] in chosen]
        if any(weight <= chosen[y] + 0.1 for y in above) or below.get(x, 0) >= 0.9 * counts[x][0]:
            continue
        chosen[x] = weight
        for k in range(1, len(x) + 1):
            below[x[:k]] = max(below.get(x[:k], 0), counts[x][0])
    out: dict[str, tuple[bool, float]] = {}
    for x, weight in chosen.items():
        word = x.rstrip("$")
        if word not in out or out[word][0]:  # a stem covers the same whole word
            out[word] = (x.endswith("$"), weight)
    return out


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:3] + self.weights[3], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Ridge logistic regression by Newton's method; weights of the features are not negative."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag([ridge] * x.shape[1] + [1e-9])
        w = w - np.linalg.solve(h, z.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0))
    return np.append(np.maximum(w[:-1], 0), w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, keep_row: Column | None = None, sample: int = SAMPLE) -> ToxicityModel:
    """Learn the lexicon and the curve; all that reaches the driver comes from at most ``sample`` labelled rows."""
    rows = labelled_sample(docs, labels, "toxic", sample, keep_row=keep_row)
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write(rows, "rows")  # ``sample`` rows at most
    one = scratch.write(_one_of_each(rows), "one")
    counts = _term_counts(one)
    sizes = {bool(x["toxic"] == 1): x["n"] for x in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    known = {x["term"]: (x["toxic"], x["other"]) for x in telling(counts, sizes.get(True, 0), sizes.get(False, 0)).collect()}
    terms = choose_terms(known, sizes.get(True, 0), sizes.get(False, 0))
    draft = Lexicon(terms)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Near misses in documents that are not toxic: ordinary words that the automaton must leave alone."""
        for batch in batches:
            found: set[str] = set()
            for text, label in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                if label != 1:
                    for w in set(WORD.findall(text)):
                        word = EDGES.sub("", w.lower())
                        if draft.memo.setdefault(w, draft.weight(w)) and not draft.match(word)[0]:
                            found.update((word, word.translate(LEET)))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    near = map_arrow(rows, measure, "word string").distinct().collect() if terms else []
    lexicon = Lexicon(terms, frozenset(x["word"] for x in near))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([lexicon.features(t) for t in texts_of(batch)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[:, k]) for k in range(3)), batch.column("toxic").cast(pa.float64())], names=["doc_id", "a", "b", "c", "y"])

    got = map_arrow(rows, describe, "doc_id long, a double, b double, c double, y double").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(float)
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(lexicon, np.array([0.0, 0.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6))]))
    return ToxicityModel(lexicon, _logistic(got[["a", "b", "c"]].to_numpy(float), y))


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_hits, and spans: start:end of every hit, comma-joined."""
    lexicon, weights = model.lexicon, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = ToxicityModel(lexicon, weights)
        for batch in batches:
            texts = texts_of(batch)
            hits = [lexicon.hits(t) for t in texts]
            scores = mine.score(np.array([lexicon.summary(t, h) for t, h in zip(texts, hits, strict=True)]).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array([len(h) for h in hits], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b, _, _ in h) for h in hits], pa.string())],
                names=["doc_id", "score", "n_hits", "spans"],
            )

    return map_arrow(need(docs, "doc_id", "text"), run, "doc_id long, score double, n_hits long, spans string")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; rows whose crc32(doc_id) mod 4 is 2 are held out of the learning."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), keep_row=remainder("doc_id", 4) != 2)
    return toxicity_scores(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits", "spans",
    )
