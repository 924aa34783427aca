import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import oracle_check
import pytest

from ballotframe.llm import bit_sliced_resampling as bits
from ballotframe.llm import catalogue
from ballotframe.llm.bit_sliced_resampling import ResamplingParams

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_matches_sql_on_whole_table(spark, sf_dir):
    con = oracle_check.duck(sf_dir)
    assert oracle_check.compare(catalogue.op11_bit_sliced_resampling(spark, sf_dir), con, bits.ORACLE) is None


def features(text, p):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[k : k + n]) for n in range(1, p.n + 1) for k in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % p.buckets for r in runs)


def brute(docs, target, p):
    raw, want = Counter(), Counter()
    for _, t in docs:
        raw += features(t, p)[1]
    for t in target:
        want += features(t, p)[1]
    s, t = sum(raw.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + p.buckets) / ((raw[b] + 1) * (t + p.buckets))))
    rows = []
    for i, text in docs:
        n, f = features(text, p)
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(c * gain(b) for b, c in f.items())
        rows.append([n >= p.least_words, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), i, sum(f.values()), weight])
    rows.sort(key=lambda r: (not r[0], -r[1], r[2] is not None, r[2] or 0))
    draws = sum(r[0] for r in rows) * p.percent // 100
    return Counter((i, n, w, s, k if k <= draws else None) for k, (_, s, i, n, w) in enumerate(rows, 1))


@pytest.mark.parametrize("p", [ResamplingParams(), ResamplingParams(buckets=70, n=2, least_words=2, percent=60, texts_at_once=3)])
def test_odd_rows_against_brute_force(spark, odd_docs, make_docs, p):
    hot = [(900 + k % 7, "Same words again and again " * 9) for k in range(60)]
    docs = odd_docs.unionByName(make_docs(hot))
    target = ["word again", None, "", "é 漢字 AB ab 7 7 7"]
    table = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, rank int")
    got = Counter(map(tuple, bits.resample(docs, table, p).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], target, p)


def test_planes_give_the_plain_sum():
    rng = np.random.default_rng(3)
    p = ResamplingParams(buckets=130)
    gain = rng.integers(-9_000, 9_000, p.buckets)
    lists = [rng.integers(0, p.buckets, n) for n in (0, 1, 5, 4_000)] + [np.full(1_025, 129)]
    assert bits.weights(lists, bits.signed_planes(gain), p).tolist() == [int(gain[x].sum()) for x in lists]
    assert bits.weights(lists, bits.signed_planes(np.zeros(p.buckets, np.int64)), p).tolist() == [0] * 5
    low = np.array([-8, 7, -1, 0])
    assert sum(w * ((q[0] >> np.uint64(7 - k)) & np.uint64(1)).astype(int) for w, q in bits.signed_planes(low) for k in [0]) == -8


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert bits.resample(make_docs([]), none).count() == 0
    rows = bits.resample(make_docs([(1, "a b"), (2, "a " * 30)]), none).collect()
    assert {r.doc_id: r["rank"] for r in rows} == {1: None, 2: None}  # a tenth of one document is none
