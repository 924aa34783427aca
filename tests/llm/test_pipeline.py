import os
import re
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ballotframe.llm import ffd_packing, line_rules, pii_crf, simhash_vp
from ballotframe.llm.shared import stored

TESTDATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata"))


@pytest.fixture(scope="module")
def sf_dir():
    """Tables with enough labels to learn from."""
    path = TESTDATA / "sf0.01"
    if not path.exists():
        pytest.skip("no test tables")
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir)))
    return out


def test_stages_keep_the_columns_of_documents(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "personal_data", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    sizes = [s.select("doc_id").distinct().count() for s in steps]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5] > 0


def test_quality_stage_drops_what_the_rules_reject(steps):
    texts = {r.doc_id: r.text for r in steps[0].collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    for doc_id, text in texts.items():
        n, *_, again, lines = line_rules.text_stats(text)
        if n < 20 or 100 * again > 30 * n:
            assert doc_id not in kept


def test_toxic_documents_go(spark, sf_dir, steps):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    before, after = (s.join(labels, "doc_id").groupBy().agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first() for s in steps[1:3])
    assert after[0] < 0.5 * before[0] and after[1] > 0.9 * before[1]


def test_no_copies_stay(steps):
    left = simhash_vp.near_duplicates(steps[3], simhash_vp.NEAR_COPIES)
    assert left.where("component_id <> doc_id").count() == 0
    assert steps[3].select("text").distinct().count() == steps[3].count()


def test_personal_data_is_gone(steps):
    for r in steps[4].collect():
        assert not pii_crf.base_spans(re.sub(r"\[[A-Z]+\]", "#", r.text)) and r.n_chars == len(r.text)


def test_all_that_is_left_is_packed(spark, sf_dir, steps):
    want = ffd_packing.pack_documents(steps[4])
    assert sorted(map(str, steps[5].collect())) == sorted(map(str, want.collect()))
    assert corpus_pipeline.run(spark, sf_dir).count() == steps[5].count()


def test_odd_documents(spark, sf_dir, odd_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, odd_docs.limit(0)):
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            found = out.collect()
            if not docs.count() or name == "toxicity":
                assert len(found) <= docs.count()
            elif name == "quality_rules":
                assert {r.text.split()[0] for r in found} <= {"a"}  # the only odd text with 20 words repeats them
            elif name == "near_duplicates":  # one of each text that differs, and the rows without an id
                assert sorted((r.doc_id is None, r.text or "") for r in found) == sorted(
                    [(False, t) for t in {r.text or "" for r in docs.where("doc_id IS NOT NULL").collect() if (r.text or "").split()}]
                    + [(False, next(r.text or "" for r in found if r.doc_id is not None and not (r.text or "").split()))]
                    + [(True, r.text or "") for r in docs.where("doc_id IS NULL").collect()]
                )
            elif name == "personal_data":  # nothing in these texts is personal
                assert sorted(map(str, found)) == sorted(map(str, docs.withColumn("n_chars", F.char_length("text").cast("long")).collect()))
            else:
                assert {r.doc_id for r in found} == {r.doc_id for r in docs.collect()}
                assert sum(r.doc_tokens for r in found if r.start == 0) == sum(r.length for r in found)
