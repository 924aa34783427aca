import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Texts that operators must not stumble on.
ODD_TEXTS = [None, "", "   \n\t\n", "word", "Ab aB AB x", "x" * 60_000, "a b c d e f g h i j " * 4_000, "é ß 漢字 ▁ \ufdd0 🙂 \x00 end"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns that clash with names in use."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("score", "key", "part", "pos", "fps", "ids", "kept", "spans", "group", "node", "word", "n"):
                docs = docs.withColumn(name, F.lit("clash"))
        return docs

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Odd texts with null and repeated ids, and two equal rows."""
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)]
    return make_docs([*rows, (None, "no id here"), (None, None), (3, "word"), (3, "another text of the same id")])
