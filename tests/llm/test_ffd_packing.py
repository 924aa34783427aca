import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ballotframe.llm import catalogue, ffd_packing
from ballotframe.llm.ffd_packing import PackingParams


@pytest.fixture(scope="module")
def ids_of():
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, docs, ids_of, length=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    for doc_id, text in docs:
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return by_sequence


def test_whole_table(spark, sf_dir, ids_of):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = catalogue.op7_ffd_packing(spark, sf_dir).collect()
    sequences = check(rows, docs, ids_of)
    assert sum(r.length for r in rows) > 0.97 * 2048 * len(sequences)


def test_odd_rows(odd_docs, ids_of, make_docs):
    some = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 3").unionByName(make_docs([(50, "a<|endoftext|>b <|endoftext|>")]))
    check(ffd_packing.pack_documents(some).collect(), [(r.doc_id, r.text) for r in some.collect()], ids_of)
    rows = ffd_packing.pack_documents(odd_docs)
    assert rows.where("doc_id IS NULL").count() == 2 and rows.where("doc_id = 3").count() == 3
    assert ffd_packing.pack_documents(make_docs([])).count() == 0


def test_tournament_equals_a_plain_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 200):
        lengths = np.sort(rng.integers(1, 100, n))[::-1]
        room, want = [], []
        for x in lengths:
            k = next((k for k, r in enumerate(room) if r >= x), len(room))
            if k == len(room):
                room.append(100)
            room[k] -= x
            want.append(k)
        assert ffd_packing.first_fit_decreasing(lengths, 100)[0].tolist() == want


def test_sequences_hold_their_ids(make_docs, ids_of):
    params = PackingParams(length=16, group_pieces=5)
    docs = make_docs([(k, "some words " * k) for k in range(12)])
    from ballotframe.llm.shared import stored

    packed = stored(ffd_packing.pack(stored(ffd_packing.cut(ffd_packing.tokenize(docs, params), params)), params))
    check(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), [(k, "some words " * k) for k in range(12)], ids_of, 16)
    for r in ffd_packing.packed_sequences(packed, params).collect():
        assert len(r.ids) == 4 * r.used <= 64


def test_equal_pieces_are_spread_over_groups(spark):
    """Pieces without an id, or of one id, do not fall into one group."""
    params = PackingParams(group_pieces=60)
    for doc_id in ("cast(null as bigint)", "7"):
        pieces = spark.range(3000).selectExpr(f"{doc_id} as doc_id", "0L as start", "5L as length", "9L as ids_crc32", "5L as doc_tokens")
        groups = ffd_packing.pack(ffd_packing.stored(pieces), params).selectExpr("sequence_id >> 32 as g").groupBy("g").count().collect()
        assert len(groups) == 50 and max(r["count"] for r in groups) < 150
