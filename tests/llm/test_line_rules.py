import re
from collections import Counter

import pytest

from ballotframe.llm import catalogue, line_rules
from ballotframe.llm.line_rules import LineRuleParams

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_equals_brute_force_on_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalogue.op9_line_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert base(r) == brute_base(texts[r.doc_id]), r.doc_id


def test_odd_rows(odd_docs, make_docs):
    want = sorted((str(r.doc_id), brute_base(r.text)) for r in odd_docs.collect())
    got = line_rules.judge_documents(odd_docs).collect()
    assert sorted((str(r.doc_id), base(r)) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert line_rules.judge_documents(make_docs([])).count() == 0
    assert line_rules.clean_documents(odd_docs).columns == odd_docs.columns


NOTICE = "All rights of this site are reserved by its owners for ever"


def own_words(k, n):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_shared_lines_go_and_depleted_documents_are_rejected(make_docs):
    rows = [(k, f"{own_words(k, 30)}\n{NOTICE.upper() if k % 2 else NOTICE}\n{own_words(f"{k}b", 12)}", "a") for k in range(40)]
    rows += [(100, f"{NOTICE}\n{own_words(100, 10)}", "a"), (101, f"{NOTICE}\n{own_words(101, 10)}", "b")]
    copies = "\n".join(own_words(f"c{j}", 9) for j in range(6))
    rows += [(200 + k, copies, "a") for k in range(60)]
    docs = make_docs(rows)
    got = {r.doc_id: r for r in line_rules.judge_documents(docs, LineRuleParams(host_least=10)).collect()}
    assert all(got[k].kept and got[k].words_left == 42 for k in range(40))
    assert not got[100].kept and not got[100].base_failed  # depleted
    assert got[101].kept  # the line is rare in its host
    assert all(got[200 + k].kept for k in range(60))  # copies do not make each other boilerplate
    clean = {r.doc_id: r.text for r in line_rules.clean_documents(docs, LineRuleParams(host_least=10)).collect()}
    assert clean[3] == f"{own_words(3, 30)}\n{own_words('3b', 12)}" and 100 not in clean and clean[200] == copies


def test_documents_of_shared_passages_count_one_by_one(make_docs):
    pool = [own_words(f"p{j}", 12) for j in range(8)]
    rows = [(k, "\n".join(pool[j] for j in range(8) if (k + 1) >> j & 1), "a") for k in range(255)]
    stats = line_rules.stored(line_rules.document_stats(make_docs(rows + rows)))
    found = line_rules.common_lines(stats, LineRuleParams()).collect()
    assert sorted((r.h, r.docs_with) for r in found) == sorted((line_rules.line_hash(x), 128) for x in pool)


def brute_kept(docs, p):
    """Verdicts from plain dictionaries: normalised lines themselves instead of hashes."""
    def lines_of(text):
        out = Counter()
        for line in (text or "").split("\n"):
            if WORD.search(line):
                out[" ".join(WORD.findall(line.lower()))] += len(WORD.findall(line))
        return out

    held = [(i, s or "", lines_of(t), brute_base(t)) for i, s, t in docs]
    apart = {(host, frozenset(lines)) for _, host, lines, _ in held}
    sizes = Counter(host for host, _ in apart)
    times = Counter((host, line) for host, lines in apart for line in lines)
    common = {k for k, n in times.items() if n > p.host_least and n > p.host_share * sizes[k[0]]}
    for i, host, lines, base in held:
        gone = sum(n for line, n in lines.items() if (host, line) in common)
        left = base[0] - gone
        yield i, not base[5] and not (2 * left < base[0] and left < p.min_words), left


@pytest.mark.parametrize("p", [LineRuleParams(), LineRuleParams(host_least=2, host_share=0.001, sent_lines=0, salts=3)])
def test_verdicts_equal_brute_force_on_whole_table(spark, sf_dir, p):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(brute_kept([(r.doc_id, r.source, r.text) for r in docs.collect()], p))
    found = line_rules.judge_documents(docs, p).collect()
    assert sorted((r.doc_id, r.kept, r.words_left) for r in found) == want
    assert any(n < r[0] for r, n in zip(((x.n_words,) for x in found), (x.words_left for x in found), strict=True)) or p.host_least == 20


def test_rows_that_differ_in_where_a_null_is(spark):
    text = own_words(1, 30)
    rows = [(1, None, text), (1, text, None), (None, "", text), (None, None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = line_rules.clean_documents(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.where("text is not null").collect()))
