"""Quality of documents: an isolation forest over rule statistics, and a sparse rule ensemble.

The forest's scales, box and threshold are exact over all labelled rows, and its trees
draw from all of them; only the rows drawn come to the driver.  The ensemble is fitted
on the driver from at most ``SAMPLE`` labelled rows.  Both see statistics only, never
texts, and every document is scored.

Defined cases: null text counts as empty and fails the base rules; it gets a score
from its all-zero statistics.  Repeated rows are scored each.  An empty table gives no
rows.  Without usable labels (none, or of one class) the forest keeps every document
that the base rules keep, and the ensemble scores the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm.common import Scratch, bound_batches, release, table
from minekit.llm.stats import COUNTS, FEATURES, at_places, labelled, labelled_sample, measured, remainder, with_stats

#: Labelled rows that the ensemble is fitted on, at most.
SAMPLE = 20_000
#: The share of labelled good rows that the forest's threshold may reject.
REJECTED_GOOD = 0.001

# ---------------------------------------------------------------- isolation forest


class IsolationForest:
    """Random axis splits of the box ``low`` to ``high``; what few splits part from the rows is anomalous.

    Cuts fall anywhere in a node's box, also where there are no rows, so that a value
    that usual rows never take ends in an empty leaf near the root.  Trees are arrays,
    scored in bulk.  ``drawn``: the rows of each tree, where they are drawn already.
    """

    def __init__(
        self, rows: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, trees: int = 200, sample: int = 256, seed: int = 7,
        drawn: np.ndarray | None = None,
    ):
        drawn, rng = self.draw(len(rows), trees, sample, seed) if drawn is None else drawn, np.random.default_rng([seed, 1])
        trees, size = drawn.shape
        low, high = (rows.min(0) if low is None else low).astype(float), (rows.max(0) if high is None else high).astype(float)
        self.depth = max(1, int(np.ceil(np.log2(max(2, size)))))
        self.norm = self._average(size)
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int32)
        self.cut = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        for t in range(trees):
            self._grow(t, 0, rows[drawn[t]], 0, low, high, rng)

    @staticmethod
    def draw(n: int, trees: int = 200, sample: int = 256, seed: int = 7) -> np.ndarray:
        """The rows of each tree, out of n: every tree draws from all of them."""
        rng = np.random.default_rng(seed)
        return np.stack([rng.choice(n, min(sample, n), replace=False) for _ in range(trees)])

    @staticmethod
    def _average(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, rows: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, rng) -> None:
        usable = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(usable):
            self.path[t, node] = depth + self._average(len(rows))
            return
        f = int(rng.choice(usable))
        cut = rng.uniform(low[f], high[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        left, under, over = rows[:, f] < cut, high.copy(), low.copy()
        under[f] = over[f] = cut
        self._grow(t, 2 * node + 1, rows[left], depth + 1, low, under, rng)
        self._grow(t, 2 * node + 2, rows[~left], depth + 1, over, high, rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; higher: more anomalous."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (rows[each, np.maximum(f, 0)] >= cut[node]))
            total += path[node]
        return np.power(2.0, -total / len(self.feature) / max(self.norm, 1e-9))


class LabelledArrays:
    """Labelled rows in memory, for ``QualityRules``."""

    def __init__(self, features: np.ndarray, labels: np.ndarray):
        self.features, self.good = features, features[labels == 1]
        self.counts = len(labels), len(self.good), int((labels == 0).sum())

    def extremes(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and most of each feature."""
        return self.features.min(0), self.features.max(0)

    def ordered(self, places: np.ndarray) -> np.ndarray:
        """Each feature's values of good rows at ``places`` of its own order."""
        return np.sort(self.good, axis=0)[places]

    def rows(self, places: np.ndarray) -> np.ndarray:
        """The good rows at ``places``, which ascend."""
        return self.good[places]

    def score_at(self, model: QualityRules, place: int) -> float:
        """The score of a good row at ``place`` in the order of scores."""
        return float(np.sort(model.score(self.good))[place])


class LabelledTable:
    """The same of a table (doc_id, quality, FEATURES) of any size, good rows in the order of doc_id."""

    def __init__(self, table: DataFrame, scratch: Scratch):
        self.scratch, self.good = scratch, table.filter(F.col("quality") == 1)
        bounds = [f(c) for f in (F.min, F.max) for c in FEATURES]
        *counts, self._bounds = table.agg(F.count("*"), F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0), F.array(*bounds)).first()
        self.counts = tuple(counts)

    def extremes(self) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.array(self._bounds).reshape(2, -1)
        return low, high

    def ordered(self, places: np.ndarray) -> np.ndarray:
        n, k = self.counts[1], len(FEATURES)
        wanted = np.unique((np.arange(k) * n + places[:, None]).ravel())
        values = self.good.select(F.posexplode(F.array(*FEATURES)).alias("feature", "value"))
        found = at_places(values, wanted, n * k, self.scratch)["value"].to_numpy()
        return found[np.searchsorted(wanted, np.arange(k) * n + places[:, None])]

    def rows(self, places: np.ndarray) -> np.ndarray:
        return at_places(self.good.select("doc_id", *FEATURES), places, self.counts[1], self.scratch)[FEATURES].to_numpy(float)

    def score_at(self, model: QualityRules, place: int) -> float:
        scores = self.good.select(anomaly(model).alias("score"))
        return float(at_places(scores, np.array([place]), self.counts[1], self.scratch)["score"].iloc[0])


class QualityRules:
    """The forest and its threshold, fitted on labelled rows (1: good)."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, failed: np.ndarray, **forest):
        self._fit(LabelledArrays(features[~failed], labels[~failed]), **forest)  # the base rules have seen to the others

    @classmethod
    def of(cls, rows: LabelledTable, **forest) -> QualityRules:
        """Fitted on a table of the rows that the base rules leave."""
        model = cls.__new__(cls)
        model._fit(rows, **forest)
        return model

    def _fit(self, rows: LabelledArrays | LabelledTable, **forest) -> None:
        self.forest, self.threshold = None, np.inf
        n, n_good, n_bad = rows.counts
        if n < 8 or not n_good or not n_bad:
            return
        # Good rows set what is usual, all rows the box; the threshold leaves all but REJECTED_GOOD of the good.
        at = np.array([0.01, 0.25, 0.75, 0.99]) * (n_good - 1)
        below = at.astype(np.int64)
        left, right = np.split(rows.ordered(np.concatenate([below, np.minimum(below + 1, n_good - 1)])), 2)
        first, self.low, self.high, last = left + (right - left) * (at - below)[:, None]
        self.width = np.maximum(last - first, 1e-3)
        box = self._scaled(np.array(rows.extremes()))
        drawn = IsolationForest.draw(n_good, **forest)
        places = np.unique(drawn)
        self.forest = IsolationForest(self._scaled(rows.rows(places)), box.min(0), box.max(0), drawn=np.searchsorted(places, drawn), **forest)
        self.threshold = rows.score_at(self, min(n_good - 1, int(np.ceil(n_good * (1 - REJECTED_GOOD))))) + 1e-9

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        """Distance of each feature from the good rows' middle half, in its widths and by logarithm, each side by itself."""
        return np.log1p(np.clip(np.hstack([(rows - self.high) / self.width, (self.low - rows) / self.width]), 0, 20))

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.zeros(len(rows)) if self.forest is None else self.forest.score(self._scaled(rows))


def base_failed(of: str = "") -> Column:
    return (F.col(of + "n_words") < 10) | (100 * F.col(of + "n_repeat_words") > 20 * F.col(of + "n_words"))


def anomaly(model: QualityRules, of: str = "") -> Column:
    """The model's score of the features beside, or of those within a struct."""

    @F.arrow_udf("double")
    def score(*features):
        return pa.array(model.score(np.column_stack([x.to_numpy(zero_copy_only=False) for x in features])))

    return score(*[of + c for c in FEATURES])


def fit_rules(stats: DataFrame, labels: DataFrame, scratch: Scratch, *, keep_row: Column | None = None) -> QualityRules:
    """The forest and its threshold from all labelled rows of ``stats`` (doc_id, counts, features); ``keep_row``: labels that it may learn from."""
    left = stats.filter(~base_failed()).select("doc_id", *FEATURES).join(labelled(labels, "quality", keep_row=keep_row), "doc_id")
    return QualityRules.of(LabelledTable(scratch.write(left, "labelled"), scratch))


def quality_rules(docs: DataFrame, labels: DataFrame, *keep: str, keep_row: Column | None = None) -> DataFrame:
    """The columns ``keep``, the counts, base_failed, anomaly (double) and kept of every document, whose text is measured once."""
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.write(with_stats(docs, *dict.fromkeys([*keep, "doc_id"])), "stats")
    model = fit_rules(stats, labels, scratch, keep_row=keep_row)
    scratch.drop_but(stats)
    return (
        stats.withColumn("anomaly", anomaly(model))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(float(model.threshold))))
        .select(*keep, *COUNTS, "anomaly", "base_failed", "kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps; only texts go to Python, once.

    It reads a table of the rows and their statistics, for ``Scratch.drop`` once its own are written.
    """
    scratch = Scratch(docs.sparkSession, "good")
    bound_batches(docs.sparkSession)
    names = [*COUNTS, *FEATURES]

    @F.arrow_udf(", ".join(f"{c} {'long' if c in COUNTS else 'double'}" for c in names))
    def measure(texts):
        counts, features = measured([x or "" for x in texts.to_pylist()])
        release()
        return pa.StructArray.from_arrays([pa.array(x) for x in (*counts.T, *features.T)], names)

    rows = scratch.write(docs.withColumn("measured_text", measure("text")), "measured")
    model = fit_rules(rows.select("doc_id", "measured_text.*"), labels, scratch)
    scratch.drop_but(rows)
    of = "measured_text."
    out = rows.filter(~base_failed(of)).filter(anomaly(model, of) <= F.lit(float(model.threshold))).drop("measured_text")
    out._scratch_path = rows._scratch_path
    return out


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


# ---------------------------------------------------------------- sparse rule ensemble

Rule = tuple[tuple[str, str, float], ...]


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 11) -> list[Rule]:
    """Conjunctions along the paths of regression trees, each grown on random rows and features and the last ones' residuals."""
    rng, score, rules = np.random.default_rng(seed), np.full(len(y), y.mean()), set()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])

    def grow(at: np.ndarray, path: Rule, left: int, usable: np.ndarray, target: np.ndarray, fit: np.ndarray) -> None:
        if path:
            rules.add(path)
        best = (1e-9, None, None)
        if left and len(at) >= 20:
            for f in usable:
                k = len(edges[f]) + 1
                n, s = np.bincount(bins[at, f], minlength=k), np.bincount(bins[at, f], target[at], minlength=k)
                cn, cs = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = cs**2 / cn + (s.sum() - cs) ** 2 / (len(at) - cn) - s.sum() ** 2 / len(at)
                gain[(cn < 5) | (len(at) - cn < 5)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        _, f, k = best
        if f is None:
            fit[at] = target[at].mean() if len(at) else 0
            return
        low = bins[at, f] <= k
        name, cut = FEATURES[f], float(edges[f][k])
        grow(at[low], (*path, (name, "<=", cut)), left - 1, usable, target, fit)
        grow(at[~low], (*path, (name, ">", cut)), left - 1, usable, target, fit)

    for _ in range(trees):
        at = rng.choice(len(y), max(20, len(y) // 2))
        fit = np.zeros(len(y))
        grow(at, (), depth, rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False), y - score, fit)
        score = score + 0.3 * fit
    return sorted(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, cut in rule:
        value = x[:, FEATURES.index(name)]
        out &= value <= cut if op == "<=" else value > cut
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of l1-penalised logistic regression, by accelerated proximal gradient."""
    n = len(y)
    rate = 4.0 / max(1e-9, np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2 / n)
    w = look = np.zeros(z.shape[1] + 1)
    t = 1.0
    w[-1] = look[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ look[:-1] + look[-1], -30, 30)))
        new = look - rate * np.append(z.T @ (p - y), (p - y).sum()) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


class RuleEnsemble:
    """Weighted conjunctive rules over statistics; ``column()`` is the score as a Spark expression."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 5e-4):
        self.rules: list[tuple[Rule, float]] = []
        if len(y) < 8 or len(np.unique(y)) < 2:
            share = float(y.mean()) if len(y) else 0.5
            self.intercept = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
            return
        rules = grow_rules(x, y)
        z = np.column_stack([holds(r, x) for r in rules]).astype(float)
        use = np.flatnonzero((z.mean(0) > 0.001) & (z.mean(0) < 0.999))
        if len(use):
            _, first = np.unique(z[:, use].T, axis=0, return_index=True)  # rules that hold for the same rows count once
            use = use[np.sort(first)]
        weights, self.intercept = lasso_logistic(z[:, use], y, penalty)
        self.rules = [(rules[k], float(w)) for k, w in zip(use, weights, strict=True) if abs(w) > 1e-6]

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = None
            for name, op, cut in rule:
                one = F.col(name) <= F.lit(cut) if op == "<=" else F.col(name) > F.lit(cut)
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, *keep: str, keep_row: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """The columns ``keep`` and the ensemble's score of every document; ``keep_row``: labels that it may learn from."""
    fitted = with_stats(labelled_sample(docs, labels, "quality", sample, keep_row=keep_row), "doc_id", "quality").toPandas()
    fitted = fitted.sort_values("doc_id", kind="stable")
    model = RuleEnsemble(fitted[FEATURES].to_numpy(float), fitted["quality"].to_numpy(float))
    return with_stats(docs, *keep).withColumn("score", model.column()).select(*keep, "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; rows whose crc32(doc_id) mod 3 is 1 are held out of the fit."""
    scored = quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", keep_row=remainder("doc_id", 3) != 1
    )
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
