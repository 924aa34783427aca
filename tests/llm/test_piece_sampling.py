from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotframe.llm import catalogue, piece_sampling
from ballotframe.llm.piece_sampling import SamplingParams


@pytest.fixture(scope="module")
def units():
    return piece_sampling.Units(piece_sampling.Vocabulary(SamplingParams()))


def lattice(u, text):
    found = np.array([u.get(x) for x in piece_sampling.units_of(text)], np.int64)
    u.solve()
    return found


def every_segmentation(v, text):
    """Pieces and log weight of all segmentations, by brute force over the marked text."""
    ids = {p: i for i, p in enumerate(v.pieces) if i not in v.byte_of and v.scores[i] < 0}
    marked = "▁" + text.replace(" ", "▁")
    out = [[] for _ in range(len(marked) + 1)]
    out[0] = [((), 0.0)]
    for a in range(len(marked)):
        for b in range(a + 1, len(marked) + 1):
            known = ids.get(marked[a:b])
            if known is not None:
                out[b] += [((*before, known), w + v.scores[known]) for before, w in out[a]]
    total = np.logaddexp.reduce([w for _, w in out[-1]])
    return {found: w - total for found, w in out[-1]}


def test_probabilities_equal_enumeration(units):
    want = every_segmentation(units.v, "ab cd")
    n = 20_000
    samples = piece_sampling.sample_block(units, list(range(n)), [lattice(units, "ab cd")] * n, 3)
    first, pair = Counter(), Counter()
    for one in samples:
        ids = [tuple(piece_sampling.piece_ids(units, runs).tolist()) for runs, *_ in one]
        assert len(set(ids)) == 3 and one[0][2] > one[1][2] > one[2][2]
        for i, (_, log_p, *_) in zip(ids, one, strict=True):
            assert log_p == pytest.approx(want[i])
        first[ids[0]] += 1
        pair[tuple(ids[:2])] += 1
    for ids, times in first.items():
        assert times / n == pytest.approx(np.exp(want[ids]), abs=0.01)
    for (a, b), times in pair.most_common(4):  # without replacement
        assert times / n == pytest.approx(np.exp(want[a] + want[b]) / (1 - np.exp(want[a])), abs=0.01)
    weights = [sum(np.exp(log_p - inclusion) for _, log_p, _, inclusion in one) for one in samples]
    assert np.mean(weights) == pytest.approx(1.0, abs=0.02)


def test_whole_table_comes_back(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = piece_sampling.sample_segmentations(docs, SamplingParams(samples=3))
    back = piece_sampling.decode(samples).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.where("text <> was").count() == 0 and back.count() == 3 * docs.count()
    rows = catalogue.op2_piece_sampling(spark, sf_dir)
    assert rows.groupBy("doc_id").agg(F.countDistinct("ids_crc32").alias("n")).where("n < 2").count() == 0


def test_odd_rows(odd_docs):
    rows = piece_sampling.sample_segmentations(odd_docs).collect()
    by_doc = Counter(r.doc_id for r in rows)
    assert by_doc[0] == by_doc[1] == 1 and by_doc[3] == 6 and by_doc[None] == 3
    empty = [r for r in rows if r.doc_id in (0, 1)]
    assert all(r.n_pieces == 0 and r.log_prob == 0 and r.log_inclusion == 0 for r in empty)
    word = [(r.rank, bytes(r.ids)) for r in rows if r.doc_id == 3]
    assert all(word.count(x) >= 2 for x in word if word.count(x) > 1) and len(set(word)) == 4
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id IS NOT NULL AND doc_id <> 3").collect()}
    for r in piece_sampling.decode(piece_sampling.sample_segmentations(odd_docs).where("doc_id <> 3")).collect():
        assert r.text == (texts[r.doc_id] or "")


def test_samples_do_not_depend_on_blocks(make_docs):
    docs = make_docs([(k, f"some words to cut number {k}, again and again {k * k}") for k in range(40)])
    rows = lambda d, p: sorted((r.doc_id, r.rank, bytes(r.ids)) for r in piece_sampling.sample_segmentations(d, p).collect())
    assert rows(docs.coalesce(1), SamplingParams()) == rows(docs.repartition(5), SamplingParams(block_chars=50, held=10))


def test_empty_table(make_docs):
    assert piece_sampling.sample_segmentations(make_docs([])).count() == 0
