"""Personal data: patterns with validity tests, and information-theoretic sanitisation of what gives it away.

Protected are the values that the patterns find, and secrets: long runs of letters and
digits that hold too many bits to be words.  Each is protected at three levels: the
value, its class (the domain of an address, the first half of an ip, the issuer of a
card, the area of a phone number, the length of a secret), and its kind.  Terms near
protected values are counted over the corpus; a term discloses a value, class or kind e
where

* P(e | term), the share of the distinct texts holding the term in which it stands near
  e, smoothed by ``PRIOR`` texts at the base rate, is ``SHARE`` or more,
* log2(P(e | term) / P(e)) is at least ``BITS`` of the level and what e's generalisation
  tells, -log2 P(kind) for a value or class and -log2 P(any kind) for a kind, and
* ``SUPPORT`` units bear it out: distinct contexts of a value, distinct values of a class or kind.

Such terms are spans of kind ``term`` wherever they stand near e, and are generalised (to
a word shape) in sanitised texts; values become their kind.  The base spans of the
patterns do not depend on any of this.

Texts and contexts are counted once each, so copies of a document prove nothing.
Counts are over all documents; nothing is sampled.

Defined cases: null or empty text has no spans; repeated rows are handled each and are
one context; an empty table gives no rows; extra columns are ignored by ``find`` and
kept by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm.common import WORD, Scratch, bound_batches, map_arrow, need, release, table, texts_of

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: Words on each side of an entity that are its context.
NEAR = 8
#: Units that bear a disclosure out, share of the term's texts, and bits of information by level, at least; texts of the prior.
SUPPORT, SHARE, BITS, PRIOR = 3, 0.5, {"value": 6.0, "class": 3.0, "kind": 3.0}, 1.0
#: Letters and digits of a secret, and the bits that their frequencies within it make, in all and for each, at least.
SECRET_LENGTH, SECRET_BITS, SECRET_RATE = 20, 60.0, 2.5
#: Written forms whose terms a task remembers, and rows that it hands on at once.
FLUSH = 200_000
#: Bits of the map of the terms that may disclose.
MARKS = 1 << 22

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can begin within a run of digits: the run's first digit would have matched or failed alike.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
RUN = re.compile(f"[A-Za-z0-9]{{{SECRET_LENGTH},}}")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; each @ is looked at once, so that long runs cost no more than their length."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if any(map(text.__contains__, "0123456789")):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs with three letters and three digits or more and enough bits, apart from base spans."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        digits = sum(map(run.count, "0123456789"))
        if 3 <= digits <= len(run) - 3 and _entropy(run) >= max(SECRET_RATE, SECRET_BITS / len(run)) and not any(a < m.end() and m.start() < b for _, a, b in base):
            out.append((SECRET, *m.span()))
    return out


def _entropy(run: str) -> float:
    """Bits a character, by the characters' frequencies."""
    n = np.array(list(Counter(run).values()), float) / len(run)
    return float(-(n * np.log2(n)).sum())


def protected_spans(text: str) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return base + secret_spans(text, base)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def term_of(word: str) -> str:
    """A word as a term: lower case without edges; empty where it is too short or has no letter."""
    out = EDGES.sub("", word).lower()
    return out if len(out) >= 3 and any(c.isalpha() for c in out) and "@" not in out else ""


def contexts(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    """(start, end, terms with their places) around each span; terms inside any span don't count."""
    if not spans:
        return
    words = [m.span() for m in WORD.finditer(text)]
    taken = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in words]
    from bisect import bisect_left, bisect_right

    first = [a for a, _ in taken]
    for _, a, b in spans:
        low, high = bisect_right(starts, a) - 1, bisect_left(starts, b)
        around = [*range(max(0, low - NEAR), max(0, low)), *range(high, min(len(words), high + NEAR))]
        terms = []
        for i in around:
            x, y = words[i]
            k = bisect_left(first, y) - 1
            if (k < 0 or taken[k][1] <= x) and (t := term_of(text[x:y])):
                terms.append((t, x, y))
        yield a, b, terms


def _number(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def levels_of(text: str, kind: str, a: int, b: int) -> tuple[str, str]:
    """The protected value (digits alone, or letters in lower case) and its class."""
    value = text[a:b].lower()
    if kind == "email":
        return value, value.rpartition("@")[2]
    if kind == "ip":
        return value, ".".join(value.split(".")[:2])
    if kind == SECRET:
        return value, str(len(value))
    digits = NOT_DIGIT.sub("", value)
    return digits, digits[: 6 if kind == "card" else 4]


NEAR_COLUMNS = [
    ("doc_id", pa.int64()), ("digest", pa.int64()), ("value", pa.int64()), ("class", pa.int64()), ("kind", pa.int64()), ("context", pa.int64()),
    ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and its digest, which with doc_id names a row, should a doc_id have several texts."""
    return need(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.xxhash64("text"))


def _near_terms(docs: DataFrame) -> DataFrame:
    """Every term near a protected value, with its place; context: a digest of the context's terms.

    The other terms of such a text follow once each, without value or place: they show how
    little of a term's texts the near ones are, before all texts are asked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in NEAR_COLUMNS]
            for doc, digest, text in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), texts_of(batch), strict=True):
                spans, near = protected_spans(text), set()
                for (kind, a, b), (_, _, terms) in zip(spans, contexts(text, spans), strict=True):
                    near.update(t for t, _, _ in terms)
                    value, class_ = levels_of(text, kind, a, b)
                    entity = _number(f"value:{kind}:{value}"), _number(f"class:{kind}:{class_}"), _number(f"kind:{kind}")
                    context = _number(" ".join(sorted({t for t, _, _ in terms})))
                    for t, x, y in terms:
                        for column, item in zip(rows, (doc, digest, *entity, context, t, x, y), strict=True):
                            column.append(item)
                if spans:
                    for t in {term_of(w) for w in set(WORD.findall(text))} - near - {""}:
                        for column, item in zip(rows, (doc, digest, None, None, None, None, t, None, None), strict=True):
                            column.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(rows, NEAR_COLUMNS, strict=True)], names=[n for n, _ in NEAR_COLUMNS])

    return map_arrow(docs, run, ", ".join(f"`{n}` {'string' if n == 'term' else 'long'}" for n, _ in NEAR_COLUMNS))


def _mark(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) % MARKS


def _marks(terms: DataFrame) -> bytes:
    """A bitmap of ``MARKS`` bits, set where a term of ``terms`` (term) falls: of one size for any number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(MARKS, np.bool_)
        for batch in batches:
            held[[_mark(t) for t in batch.column("term").to_pylist()]] = True
        at = np.flatnonzero(held)
        for k in range(0, len(at), FLUSH):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + FLUSH], pa.int64())], names=["mark"])

    out = np.zeros(MARKS, np.bool_)
    found = map_arrow(terms, run, "mark long").distinct()
    out[[r["mark"] for r in found.toLocalIterator()]] = True
    return np.packbits(out).tobytes()


def _documents_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, docs): the distinct texts that hold each of ``terms`` (term), in any of its written forms.

    The tasks hand on terms whose bit is set alone; the join leaves out those that share a bit.
    """
    marks = _marks(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(marks, np.uint8)).astype(np.bool_)
        known: dict[str, str] = {}
        for batch in batches:
            found, digests = [], []
            for text, digest in zip(texts_of(batch), batch.column("digest").to_pylist(), strict=True):
                own = set()
                for w in set(WORD.findall(text)):
                    t = known.get(w)
                    if t is None:
                        if len(known) > FLUSH:
                            known.clear()
                        t = term_of(w)
                        t = known[w] = t if t and held[_mark(t)] else ""
                    if t:
                        own.add(t)
                found += own
                digests += [digest] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(digests, pa.int64())], names=["term", "digest"])

    held = map_arrow(docs, run, "term string, digest long").join(terms, "term", "left_semi").distinct()
    return held.groupBy("term").agg(F.count("*").alias("docs"))


def _by_level(near: DataFrame) -> DataFrame:
    """(level, entity, kind, term, digest, unit) of each near term, at each level; unit: what bears a disclosure out."""
    at = lambda level, unit: F.struct(F.lit(level).alias("level"), F.col(level).alias("entity"), F.col(unit).alias("unit"))
    each = near.withColumn("e", F.explode(F.array(at("value", "context"), at("class", "value"), at("kind", "value"))))
    return each.select("e.level", "e.entity", "kind", "term", "digest", "e.unit")


def disclosures(docs: DataFrame, near: DataFrame, scratch: Scratch) -> DataFrame:
    """(level, entity, term, both, share, bits) of the terms ``near`` protected values that disclose them."""
    # Texts with any value that hold the term are some of those that hold it: where they leave too small a share, so do all.
    around = near.select("term", "digest").distinct().groupBy("term").agg(F.count("*").alias("around"))
    near = near.filter("value is not null")
    rows = _by_level(near)
    pairs = rows.groupBy("level", "entity", "kind", "term").agg(F.count_distinct("unit").alias("units"), F.count_distinct("digest").alias("both")).filter(F.col("units") >= SUPPORT)
    pairs = pairs.join(around, "term").filter((F.col("both") + PRIOR) / (F.col("around") + PRIOR) >= SHARE).drop("around")
    pairs = scratch.write(pairs, "pairs")
    # Texts of each entity, and of any: how likely each is anyway.
    texts = lambda of, name: of.distinct().groupBy("entity").agg(F.count("*").alias(name))
    entities = texts(rows.select("entity", "digest"), "with_it").join(pairs.select("entity").distinct(), "entity", "left_semi")
    kinds = texts(rows.select(F.col("kind").alias("entity"), "digest"), "with_kind").withColumnRenamed("entity", "kind")  # as many rows as kinds
    any_kind = near.select("digest").distinct().count()
    total = float(max(1, docs.select("digest").distinct().count()))
    held = _documents_with(docs, pairs.select("term").distinct())
    base, parent = F.col("with_it") / total, F.when(F.col("level") == "kind", F.lit(float(any_kind))).otherwise(F.col("with_kind")) / total
    least = F.create_map(*[F.lit(x) for kv in BITS.items() for x in kv])[F.col("level")]
    judged = (
        pairs.join(held, "term").join(entities, "entity").join(F.broadcast(kinds), "kind")
        .withColumn("share", (F.col("both") + PRIOR * base) / (F.col("docs") + PRIOR))
        .withColumn("bits", F.log2(F.col("share") / base))
        .filter((F.col("share") >= SHARE) & (F.col("bits") >= F.greatest(least, -F.log2(parent))))
    )
    return scratch.write(judged.select("level", "entity", "term", "both", "share", "bits"), "disclosures")


def _telling(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, extra): the sorted places of each document's disclosing terms, only for documents with any."""
    near = scratch.write(_near_terms(docs), "near")
    told = disclosures(docs, near, scratch).select("entity", "term")
    each = near.filter("value is not null").select("doc_id", "digest", "term", "start", "end", F.explode(F.array("value", "class", "kind")).alias("entity"))
    places = each.join(told, ["entity", "term"]).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("extra"))
    return scratch.write(places, "telling")


def shape(word: str) -> str:
    """What a term is generalised to: its letters and digits by class."""
    return "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word)


def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its base values as [KIND] and its telling terms as shapes; overlapping values are replaced as one."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < last:
            if b > last:
                last = b
            continue
        out += [text[last:a], shape(text[a:b]) if kind == "term" else f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


RESULT = "doc_id long, digest long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, own array<string>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, and n_secret, n_term and n_spans of every document."""
    chosen = _keyed(docs)
    extra = _telling(chosen, Scratch(docs.sparkSession, "pii"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            spans = [base_spans(t) for t in texts]
            counts = [Counter(k for k, _, _ in x) for x in spans]
            own = [[f"{k}:{a}:{b}" for k, a, b in [*x, *secret_spans(t, x)]] for t, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("digest"), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in spans], pa.string()), pa.array(own, pa.list_(pa.string())),
                ],
                names=["doc_id", "digest", *(f"n_{k}" for k in KINDS), "base_sha256", "own"],
            )

    none = F.array().cast("array<string>")
    terms = F.coalesce(F.transform("extra", lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["end"])), none)
    base = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))
    size = lambda x: F.size(x).cast("long")
    rows = map_arrow(chosen, run, RESULT).join(extra, ["doc_id", "digest"], "left")  # a null doc_id has no extra places
    return rows.select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.array_join(F.concat("own", terms), ",").alias("spans"),
        (size("own") - base).alias("n_secret"), size(terms).alias("n_term"), (size("own") + size(terms)).alias("n_spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with protected values as [KIND] and disclosing terms as their shapes in ``text``; n_chars follows.

    Extra columns of any name stay as they are.
    """
    bound_batches(docs.sparkSession)
    extra = _telling(_keyed(docs), Scratch(docs.sparkSession, "pii"))

    @F.arrow_udf("string")
    def cleaned(texts, extras):
        out = [
            t if t is None else clean(t, protected_spans(t) + [("term", p["start"], p["end"]) for p in e or ()])
            for t, e in zip(texts.to_pylist(), extras.to_pylist(), strict=True)
        ]
        release()
        return pa.array(out, pa.string())

    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")).join(extra, ["doc_id", "digest"], "left")
    own = {"text": F.col("new"), "n_chars": F.length("new")}
    rows = rows.select("row", cleaned("row.text", "extra").alias("new"))
    return rows.select(*[own.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(table(spark, sf_dir, "documents"))
