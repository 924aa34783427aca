import random

import pytest
from pyspark.sql import functions as F

from ballotframe.llm import catalogue, toxicity_gbt

WORDS = "the of and to in that on we walk river stone green light early house open table".split()
BAD = "vile rotten scum".split()


def text_of(rng, toxic, hide=False):
    words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
    if toxic:
        for _ in range(3):
            bad = rng.choice(BAD)
            words.insert(rng.randrange(len(words)), "you " + (bad.replace("i", "1").replace("o", "0") if hide else bad))
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark, make_docs):
    rng = random.Random(2)
    truth = [(k, rng.random() < 0.3) for k in range(600)]
    docs = make_docs([(k, text_of(rng, toxic)) for k, toxic in truth] + [(1000, text_of(rng, True, True)), (1001, text_of(rng, False))])
    labels = spark.createDataFrame([(k, 1, int(t)) for k, t in truth], "doc_id long, quality int, toxic int")
    return docs, labels, dict(truth)


def test_learns_held_out_rows(tables):
    docs, labels, truth = tables
    rows = toxicity_gbt.score_documents(docs, labels, F.col("doc_id") % 4 != 0).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id < 600 and r.doc_id % 4 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held) > 0.95
    kept = {r.doc_id for r in toxicity_gbt.keep_clean(docs, labels).collect()}
    assert 1001 in kept and sum(k in kept for k, t in truth.items() if t) < 10


def test_labels_are_no_input(tables, spark):
    """Other labels, languages and sources of held-out rows leave every score as it is."""
    docs, labels, _ = tables
    scores = lambda d, x: {r.doc_id: r.score for r in toxicity_gbt.score_documents(d, x, F.col("doc_id") % 4 != 0).collect()}
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("zz"))
    assert scores(docs, labels) == scores(moved, flipped)


def test_odd_rows(odd_docs, tables):
    _, labels, _ = tables
    docs, _, _ = tables
    rows = toxicity_gbt.score_documents(docs.unionByName(odd_docs), labels.unionByName(labels.selectExpr("CAST(NULL AS long) doc_id", "quality", "toxic")))
    assert rows.count() == docs.count() + odd_docs.count() and rows.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_without_labels_or_rows(odd_docs, make_docs, tables):
    _, labels, _ = tables
    none, good = labels.limit(0), labels.where("toxic = 0")
    assert {r.score for r in toxicity_gbt.score_documents(odd_docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity_gbt.score_documents(odd_docs, good).collect()} == {0.0}
    assert toxicity_gbt.score_documents(make_docs([]), labels).count() == 0


def test_features_of_hidden_words():
    values = dict(zip(toxicity_gbt.FEATURES, toxicity_gbt.text_features("You are v1le and s-c-u-m!!!", {"vile": 4.0, "scum": 4.0}), strict=True))
    assert values["strong"] == 0 and values["hidden"] > 0 and values["near_hidden"] > 0 and values["obfuscated"] > 0


def test_query_on_whole_table(spark, sf_dir):
    rows = catalogue.op6_toxicity_gbt(spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
