"""Importance resampling towards a target distribution, with weights by bit-sliced aggregation.

The features of a text are its runs of up to ``n`` words; each falls into one of ``buckets`` buckets by its CRC-32. Two
passes over the texts: the first counts buckets over all texts of the raw and of the target table (partial counts in each
task, one row for each bucket after the shuffle), from which each bucket's gain, an integer, follows on the driver. The
second finds the weight of a text, the sum of gains over its features, from bit planes:

* the counts of a text's buckets are written as planes of one bit for each bucket, plane b holding bit b of each count;
* the gains are written in two's complement the same way, the highest plane being the sign's;
* the weight is the sum over pairs of planes of 2^(b+g) times the number of bits set in both, negative for the sign's plane.

Planes are rows of 64-bit words; a batch of texts is one matrix for each plane, so a pair of planes is one AND and one
population count over it. Only planes that have a bit set are formed. Everything is exact integer arithmetic.

A text's score adds noise that depends on its id and the seed alone (Gumbel's distribution, from a SHA-256), and the highest
scores are drawn. Their ranks come from ranges of the order, not from one sorted task.

Nulls: a null text has no words; a null id counts as an empty string in the noise and comes before all others among equal
scores. Rows of one id are documents each; equal rows have equal scores and ranks that follow each other. Texts
with too few words get a weight and a score but are never drawn. Empty tables: no documents give no rows; without target
texts all gains follow from the raw counts. Very long texts are taken whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import with_ordinal
from .shared import small, stored, text_or_empty

#: Letters and digits stay, A-Z in lower case; other ASCII characters part words; bytes of other characters stay.
LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
SCALE = 1000


@dataclass(frozen=True)
class ResamplingParams:
    """``n``: longest run of words; ``percent`` of the texts with ``least_words`` words are drawn; texts of one matrix."""

    buckets: int = 10_000
    n: int = 1
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    texts_at_once: int = 256


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


def bucket_list(text: str, p: ResamplingParams) -> tuple[np.ndarray, int]:
    """The bucket of each feature of a text, and its number of words."""
    words = words_of(text)
    hashes = [crc32(w) for w in words]
    for run in range(2, p.n + 1):
        hashes += [crc32(b" ".join(words[k : k + run])) for k in range(len(words) - run + 1)]
    return np.array(hashes, np.int64) % p.buckets, len(words)


def bucket_counts(texts: DataFrame, p: ResamplingParams) -> np.ndarray:
    """How often each bucket occurs in all texts. Only counts by bucket reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for batch in small(batches):
            for text in batch.column("text").to_pylist():
                total += np.bincount(bucket_list(text, p)[0], minlength=p.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select(text_or_empty().alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(p.buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to the weight, in thousandths of a natural logarithm, rounded down."""
    k, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    ratio = [((t + 1) * (all_raw + k)) / ((s + 1) * (all_target + k)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def planes_of(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = -(-bits.shape[-1] // 64) * 64
    full = np.zeros((*bits.shape[:-1], wide), bool)
    full[..., : bits.shape[-1]] = bits
    return np.packbits(full, axis=-1).view(np.uint64)


def signed_planes(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(weight, plane) of integers in two's complement; the plane of the sign weighs negatively."""
    bits = int(max(values.max(initial=0), -values.min(initial=0) - 1, 0)).bit_length()
    planes = [((1 << b) * (-1 if b == bits else 1), planes_of(values >> b & 1 > 0)) for b in range(bits + 1)]
    return [(w, p) for w, p in planes if p.any()]


def count_planes(rows: np.ndarray, buckets: np.ndarray, texts: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(weight, texts, planes): for each bit of the counts, the texts that have it set in some bucket, and their planes."""
    keys, counts = np.unique(rows * width + buckets, return_counts=True)
    bit = 0
    while len(keys):
        odd = keys[counts & 1 > 0]
        if len(odd):
            some, at = np.unique(odd // width, return_inverse=True)
            bits = np.zeros((len(some), width), bool)
            bits[at, odd % width] = True
            yield 1 << bit, some, planes_of(bits)
        more = counts > 1
        keys, counts, bit = keys[more], counts[more] >> 1, bit + 1


def weights(lists: list[np.ndarray], gain_planes: list[tuple[int, np.ndarray]], p: ResamplingParams) -> np.ndarray:
    """The sum of gains over each text's features."""
    out = np.zeros(len(lists), np.int64)
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    buckets = np.concatenate(lists) if lists else rows
    for times, texts, planes in count_planes(rows, buckets, len(lists), p.buckets):
        for worth, plane in gain_planes:
            out[texts] += times * worth * np.bitwise_count(planes & plane).sum(axis=1, dtype=np.int64)
    return out


def weigh(docs: DataFrame, target: DataFrame, params: ResamplingParams | None = None) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    p = params or ResamplingParams()
    planes = signed_planes(gains(bucket_counts(docs, p), bucket_counts(target, p)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, p.texts_at_once):
            found = [bucket_list(t, p) for t in batch.column("text").to_pylist()]
            lists = [b for b, _ in found]
            columns = [
                batch.column("doc_id"),
                pa.array([n for _, n in found], pa.int64()),
                pa.array([len(b) for b in lists], pa.int64()),
                pa.array(weights(lists, planes, p), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_score(rows: DataFrame, p: ResamplingParams) -> DataFrame:
    """Adds the weight with the noise of the id."""
    key = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(float(1 << 32)))))
    return rows.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, params: ResamplingParams | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all documents; the rank is null for those that are not drawn."""
    p = params or ResamplingParams()
    rows = stored(with_score(weigh(docs, target, p), p).withColumn("fit", F.col("n_words") >= p.least_words))
    draws = rows.where("fit").count() * p.percent // 100
    drawn = with_ordinal(rows, [F.desc("fit"), F.desc("score"), F.asc_nulls_first("doc_id")])
    rank = F.when(F.col("fit") & (F.col("ordinal") <= draws), F.col("ordinal")).alias("rank")
    return drawn.select("doc_id", "n_features", "weight", "score", rank)


#: CRC-32 of words is found by table steps over the bytes of all distinct words at once.
ORACLE = """
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), steps AS MATERIALIZED (
  SELECT i, c FROM bits WHERE k = 8
), texts AS MATERIALIZED (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), words AS MATERIALIZED (
  SELECT kind, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts
), forms AS (
  SELECT word, hex(word) AS h FROM (SELECT DISTINCT word FROM words)
), crc AS (
  SELECT word, h, 4294967295::BIGINT AS c, 0 AS k FROM forms
  UNION ALL
  SELECT word, h, xor(c >> 8, s.c2), k + 1
  FROM crc JOIN (SELECT i, c AS c2 FROM steps) s ON s.i = xor(c & 255, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)
  WHERE k * 2 < length(h)
), hashed AS MATERIALIZED (
  SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE k * 2 = length(h)
), placed AS MATERIALIZED (
  SELECT kind, r, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL
), sums AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t
  FROM range(10000) x(b) LEFT JOIN placed ON bucket = b GROUP BY b
), gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE)
         / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums
), weighed AS (
  SELECT x.doc_id, coalesce(sum(n), 0)::BIGINT AS n_features, coalesce(sum(n * gain), 0)::BIGINT AS weight, x.r
  FROM texts x LEFT JOIN placed p ON p.kind = 'd' AND p.r = x.r LEFT JOIN gains USING (bucket)
  WHERE x.kind = 'd' GROUP BY x.doc_id, x.r
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
         / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS FIRST) AS k,
         count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * fit // 100 THEN k END AS rank FROM ordered
"""
