"""Quality rules: word and repetition rules of one document, and lines that too many documents of a host share.

Lines are normalised (lower case, single spaces) and hashed. For each host (the ``source`` column) and line, distinct
documents are counted. Copies must not make each other look like boilerplate, so documents count as distinct by a digest
of their whole set of lines: exact copies count once, near copies each. A line above the host's limit is removed; a
document that loses more than half of its words and keeps too few is depleted and rejected.

Counts cover every line of every document. They are summed in the tasks before the shuffle, so a frequent line or a
large host is never gathered anywhere.

Nulls: a null text has no words and fails; a null source is the same host as an empty one. Repeated rows are copies, each
with its own row in the result. An empty table gives none. There are no ties: limits are compared with ">", a document that
keeps just half of its words is kept. Texts of any length are taken whole; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, small, stored, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class LineRuleParams:
    """``min_words`` and ``max_repeat_percent``: base rule; ``host_share`` and ``host_least``: a line is common in
    more than this share of a host's documents, and more than this number; ``sent_lines``: common lines that are sent to all
    tasks, at most, beyond which each is joined in ``salts`` parts."""

    min_words: int = 20
    max_repeat_percent: int = 30
    host_share: float = 0.02
    host_least: int = 20
    sent_lines: int = 200_000
    salts: int = 16


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words which occurs at least twice."""
    n = len(words)
    if n < WINDOW:
        return 0
    index: dict[bytes, int] = {}
    grams, span = np.array([index.setdefault(w, len(index)) for w in words], np.int64), 1
    while span < WINDOW:
        pairs = grams[:-span] * (n + 1) + grams[span:]
        _, grams, times = np.unique(pairs, return_inverse=True, return_counts=True)
        span *= 2
        if len(times) == len(pairs):
            return 0
    starts = np.flatnonzero(times[grams] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + WINDOW, 1)
    return int((np.cumsum(edge) > 0).sum())


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(line.lower().split()).encode("utf-8", "surrogatepass")) - (1 << 63)


def lines_digest(hashes: Iterable[int]) -> int:
    """Equal for documents with the same set of lines."""
    return xxhash.xxh64_intdigest(np.array(sorted(hashes), np.int64).tobytes()) - (1 << 63)


def text_stats(text: str) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each distinct line by its hash."""
    words: list[bytes] = []
    lines: dict[int, int] = {}
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            continue
        words += own
        again += line in seen
        seen.add(line)
        key = line_hash(line)
        lines[key] = lines.get(key, 0) + len(own)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words), lines


STATS = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), ("key", pa.int64()), ("key2", pa.int64()), ("part", pa.int32()), ("pos", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "digest")]
    + [("lines", pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())])))]
)
STATS_DDL = (
    "doc_id long, host string, key long, key2 long, part int, pos long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, digest long, lines array<struct<h: long, words: long>>"
)


def row_keys() -> list[Column]:
    """Two hashes (``key``, ``key2``) that are equal for equal rows of documents; null and empty differ."""
    parts = [x for c in ("doc_id", "source", "text") for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias("key"), F.xxhash64(F.lit("second"), *parts).alias("key2")]


def document_stats(docs: DataFrame) -> DataFrame:
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for batch in small(batches):
            rows = []
            for doc_id, host, *keys, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "host", "key", "key2", "text")), strict=True):
                *numbers, lines = text_stats(text)
                rows.append((doc_id, host, *keys, part, pos, *numbers, lines_digest(lines), [{"h": h, "words": n} for h, n in lines.items()]))
                pos += 1
            yield batch_of(STATS, [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in STATS])

    columns = F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), *row_keys()
    return docs.select(*columns, text_or_empty().alias("text")).mapInArrow(run, STATS_DDL)


def common_lines(stats: DataFrame, params: LineRuleParams) -> DataFrame:
    """(host, h): lines above the limit of their host. There are at most (lines of a document / host_share) for a host."""
    host = F.coalesce("host", F.lit(""))
    sizes = stats.groupBy(host.alias("host"), "digest").agg(F.lit(1).alias("x")).groupBy("host").agg(F.count("*").alias("docs"))
    lines = stats.select(host.alias("host"), "digest", F.explode("lines.h").alias("h"))
    apart = lines.groupBy("host", "h", "digest").agg(F.lit(1).alias("x"))
    counts = apart.groupBy("host", "h").agg(F.count("*").alias("docs_with"))
    counts = counts.where(F.col("docs_with") > params.host_least)
    return counts.join(sizes, "host").where(F.col("docs_with") > params.host_share * F.col("docs")).select("host", "h", "docs_with")


def judge_documents(docs: DataFrame, params: LineRuleParams | None = None) -> DataFrame:
    """One row for each row of ``docs``: the statistics, ``base_failed``, ``common`` (hashes of the lines to remove),
    ``words_left``, ``kept``, ``key`` and ``key2`` (see row_keys)."""
    params = params or LineRuleParams()
    stats = stored(document_stats(docs))
    common = stored(common_lines(stats, params).select("host", "h"))
    lines = stats.select(F.coalesce("host", F.lit("")).alias("host"), "part", "pos", F.explode("lines").alias("l"))
    lines = lines.select("host", "part", "pos", F.col("l.h").alias("h"), F.col("l.words").alias("words"))
    if common.count() <= params.sent_lines:
        met = lines.join(F.broadcast(common), ["host", "h"])
    else:  # the lines that are joined are the most frequent of all: each is spread over some tasks
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("part", "pos"), F.lit(params.salts)).cast("int"))
        met = salted.join(common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1)))), ["host", "h", "salt"])
    hit = met.groupBy("part", "pos").agg(F.sum("words").alias("gone"), F.collect_list("h").alias("common"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    depleted = (2 * left < F.col("n_words")) & (left < params.min_words)
    return stats.join(hit, ["part", "pos"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"), left.alias("words_left"), "key", "key2", F.coalesce("common", F.array().cast("array<long>")).alias("common"),
    )


def remove_lines(texts: pd.Series, common: pd.Series) -> pd.Series:
    """The texts without the lines whose hash is in ``common``."""

    def one(text: str, hashes) -> str:
        if text is None or hashes is None or not len(hashes):
            return text
        gone = set(hashes)
        return "\n".join(x for x in text.split("\n") if not x.strip() or line_hash(x) not in gone)

    return pd.Series([one(t, h) for t, h in zip(texts, common, strict=True)])


def clean_documents(docs: DataFrame, params: LineRuleParams | None = None) -> DataFrame:
    """The kept rows of ``docs``, all columns, with common lines removed from ``text``."""
    keys = ["__key", "__key2"]
    verdicts = judge_documents(docs, params).where("kept").select(
        F.col("key").alias(keys[0]), F.col("key2").alias(keys[1]), F.col("common").alias("__common")
    )
    verdicts = verdicts.dropDuplicates(keys)
    strip = F.pandas_udf(remove_lines, "string")
    joined = docs.select("*", *(c.alias(k) for c, k in zip(row_keys(), keys, strict=True))).join(verdicts, keys)
    text = F.when(F.size("__common") > 0, strip("text", "__common")).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*docs.columns)
