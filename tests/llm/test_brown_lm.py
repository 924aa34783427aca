import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotframe.llm import brown_lm, catalogue, shared

SMALL = brown_lm.BrownParams(frequent=200, own_units=50, shared_units=16, classes=8, rounds=2)


def brute_base(rows):
    counts = Counter()
    for _, held, text in rows:
        if not held:
            counts.update([*shared.ascii_lower_words(text or ""), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, _, text in rows:
        words = [*shared.ascii_lower_words(text or ""), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((doc_id, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    return sorted(out, key=str)


def test_base_equals_brute_force_on_whole_table(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents").withColumn("held", shared.id_remainder(7) == 2)
    want = brute_base([(r.doc_id, r.held, r.text) for r in docs.collect()])
    rows = catalogue.op1_brown_lm(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str) == want
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd_docs):
    held = F.coalesce(F.col("doc_id") == 6, F.lit(False))
    rows = brown_lm.score_documents(odd_docs, SMALL, held).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    want = brute_base([(r.doc_id, r.doc_id == 6, r.text) for r in odd_docs.collect()])
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str) == want


def trained(docs, params):
    rows = docs.selectExpr("doc_id", "false AS held_out", "coalesce(text, '') AS text")
    vocabulary = brown_lm.build_vocabulary(brown_lm.word_counts(rows), params)
    encoded = brown_lm.encode(rows, vocabulary)
    model, rare = brown_lm.train_model(encoded, vocabulary)
    return encoded, model, rare


def word_classes(model, rare):
    """Count and class of every training word."""
    v = model.vocabulary
    out = {w: (int(v.counts[k]), int(model.classes[k])) for w, k in v.index.items()}
    out[b""] = (int(v.counts[v.end]), int(model.classes[v.end]))
    out.update({bytes(r.word): (r.n, r["class"]) for r in rare.collect()})
    return out


@pytest.mark.parametrize("frequent", [12, 1_000])
def test_scores_equal_a_plain_class_model(spark, make_docs, frequent):
    """Counts, transitions and scores by the formulas of the module, from the classes of the words alone."""
    import random

    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["long" * 30, "long" * 29 + "lang"]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(62)], k=rng.randint(0, 40))) for _ in range(60)]
    docs = make_docs(list(enumerate(texts)))
    c = 5
    params = brown_lm.BrownParams(frequent=frequent, own_units=8, shared_units=6, classes=c, rounds=3)
    encoded, model, rare = trained(docs, params)
    of = word_classes(model, rare)
    counts = Counter(w for t in texts for w in [*brown_lm.word_keys(t), b""])
    assert {w: n for w, (n, _) in of.items()} == dict(counts)
    is_rare = {w for w in of if w and w not in model.vocabulary.index}
    assert bool(is_rare) == (frequent == 12)
    pairs, first, second, both = np.zeros((c, c)), np.zeros(c), np.zeros(c), 0
    stream = [b""] + [w for t in texts for w in [*brown_lm.word_keys(t), b""]]
    inner = [[b"", *brown_lm.word_keys(t), b""] for t in texts]
    assert sum(len(x) - 1 for x in inner) == len(stream) - 1
    for x, y in zip(stream, stream[1:]):
        if x in is_rare and y in is_rare:
            first[of[x][1]] += 1
            second[of[y][1]] += 1
            both += 1
        else:
            pairs[of[x][1], of[y][1]] += 1
    pairs += np.outer(first, second) / max(both, 1)
    tokens, types = np.zeros(c), np.zeros(c)
    for n, k in of.values():
        tokens[k] += n
        types[k] += 1
    share, kinds = (tokens + 1) / (tokens.sum() + c), np.maximum((pairs > 0).sum(1, keepdims=True), 1)
    transitions = (pairs + kinds * share) / (pairs.sum(1, keepdims=True) + kinds)
    assert np.allclose(10**model.transitions, transitions) and np.allclose(transitions.sum(1), 1)
    got = {r.doc_id: r.score for r in brown_lm.score_texts(encoded, model, rare).collect()}
    for doc_id, words in enumerate(inner):
        want = 0.0
        for x, y in zip(words, words[1:]):
            n, k = of[y]
            want += math.log10(transitions[of[x][1], k] * (n + 1) / (tokens[k] + types[k] + 1))
        assert got[doc_id] == pytest.approx(want)


def test_probabilities_sum_to_one(spark, make_docs):
    docs = make_docs([(1, "a b c a b d"), (2, "b c d e"), (3, "the cat and the dog")])
    _, model, rare = trained(docs, brown_lm.BrownParams(frequent=4, own_units=3, shared_units=4, classes=3, rounds=1))
    assert np.allclose((10**model.transitions).sum(1), 1)
    of_class = 10**-model.shares  # one unknown word a class
    for n, k in word_classes(model, rare).values():
        of_class[k] += 10 ** (math.log10(n + 1) - model.shares[k])
    assert np.allclose(of_class, 1)


def test_rare_words_go_with_their_neighbours(spark, make_docs):
    """Words seen twice each, with endings that say nothing, stand either between a and b or between c and d."""
    import random

    rng = random.Random(3)
    words = rng.sample(range(10**5, 10**6), 400)
    texts = [f"a x{w} b" if w % 2 else f"c x{w} d" for w in words for _ in range(2)] + ["a b a b", "c d c d"] * 400
    params = brown_lm.BrownParams(frequent=4, own_units=4, shared_units=64, classes=12, rounds=8)
    _, model, rare = trained(make_docs(list(enumerate(texts))), params)
    of = {bytes(r.word).decode(): r["class"] for r in rare.collect()}
    assert len(of) == 400
    odd, even = ({of[f"x{w}"] for w in words if w % 2 == k} for k in (1, 0))
    assert not odd & even


def test_exchange_raises_the_likelihood(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents")
    _, model, _ = trained(docs, brown_lm.BrownParams(frequent=2000, own_units=500, shared_units=64, classes=16, rounds=3))
    assert model.history[-1] > model.history[0]


@pytest.mark.parametrize("held", [True, False])
def test_empty_tables_and_no_training(make_docs, held):
    assert brown_lm.score_documents(make_docs([]), SMALL, F.lit(held)).count() == 0
    rows = brown_lm.score_documents(make_docs([(1, "a b")]), SMALL, F.lit(True)).collect()
    assert rows[0].base_score == 0 and rows[0].n_known == 0 and rows[0].train_tokens == 0
