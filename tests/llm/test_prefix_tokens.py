import numpy as np
import pytest
from conftest import ODD_TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ballotframe.llm import catalogue, prefix_tokens
from ballotframe.llm.prefix_tokens import PrefixParams

TEXTS = [
    "it's they're I'LL 'tis 'r 're x'd !'s '''s 'S we've'", "<|endoftext|>a<|endoftext|>!!<|startoftext|><|endoftex <|ENDOFTEXT|> <||endoftext|>",
    "漢字かな123４５ ½²", "a  b\x0bc\x1cd e\u0085f　g  h", "🙂🙂‍👩 é ▁ ﷐ \x00 end", "  lead and trail \n\n",
    "internationally antidisestablishmentarianism aaaaaaaaaaaaa hahahahahaha ---___====!!!???", "straße ÀÉÎ Ωμέγα",
]
MARKS = ["éá x̧́y", "각가", "İstanbul ΣΑΣ ǅ ﬀ", "a ̈́b q̣̇ Å Ω"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(prefix_tokens.default_vocabulary())
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def prefixes():
    return prefix_tokens.counter(PrefixParams())


def test_whole_table_against_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalogue.op12_prefix_tokens(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = library(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix_against_the_library(prefixes, library, text):
    assert prefixes.of_texts([text])[0].tolist() == [library(text[:k]) for k in range(len(text) + 1)]


@pytest.mark.parametrize("text", MARKS)
def test_no_cut_within_a_character_and_its_marks(prefixes, library, text):
    got = prefixes.of_texts([text])[0].tolist()
    assert got[0] == 0 and got[-1] == library(text)
    for k in range(1, len(text)):
        exact = got[k] == library(text[:k])
        assert exact or (got[k] == got[k - 1] and not prefix_tokens.starts_anew(text[k]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abehinorst'!-.0é ü\n", max_size=30), max_size=4))
def test_prefixes_of_any_texts(prefixes, library, texts):
    for text, got in zip(texts, prefixes.of_texts(texts), strict=True):
        assert got.tolist() == [library(text[:k]) for k in range(len(text) + 1)]


def test_small_caches_and_parts_change_nothing(prefixes, library):
    small = prefix_tokens.PrefixCounter(PrefixParams(chunks=3, pairs=4))
    texts = [t or "" for t in ODD_TEXTS] + TEXTS
    parts = [c for _, counts in small.in_parts(texts, 50) for c in counts]
    assert all((a == b).all() for a, b in zip(parts, prefixes.of_texts(texts), strict=True))
    assert [int(c[-1]) for c in parts] == [library(t) for t in texts]


def test_odd_rows_and_budgets(spark, odd_docs, library):
    rows = prefix_tokens.prefix_counts(odd_docs)
    asked = rows.select("doc_id", "n_bytes", prefix_tokens.token_count().alias("n"), prefix_tokens.count_at(F.lit(4)).alias("four"),
                        prefix_tokens.longest_prefix(F.lit(2)).alias("two"), prefix_tokens.longest_prefix(F.lit(None)).alias("none")).collect()
    texts = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=str)
    want = []
    for i, t in texts:
        every = [library(t[:k]) for k in range(min(len(t), 300) + 1)]
        last = max(k for k, n in enumerate(every) if n <= 2)
        want.append((i, len(t.encode()), library(t), library(t[:4]), last))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in asked), key=key) == sorted(want, key=key)
    assert {r.none for r in asked} <= {r[4] for r in want} and min(r.none for r in asked) == 0


def test_truncate(spark, make_docs, library):
    text = "some words here, and internationally more of them"
    rows = prefix_tokens.truncate(make_docs([(1, text), (2, "short"), (3, None)]), 6).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].cut and text.startswith(by[1].text) and by[1].n_tokens == library(by[1].text) <= 6
    assert all(library(text[:k]) > 6 for k in range(len(by[1].text) + 1, len(text) + 1))
    assert (by[2].text, by[2].cut, by[3].text, by[3].n_tokens) == ("short", False, "", 0)


def test_empty_table(spark, make_docs):
    assert prefix_tokens.token_report(make_docs([]), 5).count() == 0


def test_table_of_integers():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 500))
    table = prefix_tokens.Table(600)
    table.put(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.get(keys) == np.arange(len(keys))).all() and (table.get(keys + (1 << 41)) == -1).all()
