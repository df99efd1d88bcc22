"""The helpers of the tests beside."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, source]) as a documents table."""

    def make(rows):
        full = [(i, t, "en", s[0] if s else "a", len(t) if t is not None else None) for i, t, *s in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def edge_cases(documents):
    """Null, empty and blank texts, a very long one, repeated rows, ties, and null keys; extra columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{k % 997}x{k % 31}" for k in range(20_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, "the same words in both of these rows here today"), (6, "the same words in both of these rows here today"),
        (7, "the same words in both of these rows here today"), (8, "Ünï côdé 𝄞 text, with marks!! and mail a.b@c.de"), (None, "no key at all in this row"), (9, "x", None),
    ]
    extra = {c: F.lit("extra") for c in ("size", "start", "score", "n_words", "digest", "node", "key", "term", "row", "target")}
    return documents(rows).withColumns(extra)
