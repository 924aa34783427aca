"""Packing documents into token sequences: first-fit decreasing with a tournament tree, in randomised groups.

A document is the ids of its text and one end id. It is cut into pieces of the sequence length; what is left over is a
shorter last piece. Pieces are dealt to groups by a hash of their document and place, so groups are alike in size and mix
whatever the input's order or skew; groups that equal keys make large are cut once more. In a group, pieces are placed longest first into the first sequence with room; a
tournament tree over the free space of the sequences finds it in a logarithmic number of steps. Groups are packed
independently, one task each at a time, with about ``group_pieces`` pieces, so memory is bounded.

Nulls: a null text is empty (its end id is packed); a null doc_id is an id like any other. Repeated rows are packed as
often as they occur. An empty table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, stored, text_or_empty

WIDTH = 4  # bytes of an id


@dataclass(frozen=True)
class PackingParams:
    """``vocabulary``: a file of byte-level BPE ranks; ``special``: strings that are one id wherever they stand."""

    vocabulary: str = ""
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)
    end_id: int = 1
    length: int = 2_048
    group_pieces: int = 8_192


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(params: PackingParams):
    """A function from text to ids. The ranks give the same ids as the byte_bpe_50k.json vocabulary, several times faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(params.vocabulary or default_vocabulary(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    special = dict(params.special)
    coder = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    names = list(special)

    def encode(text: str) -> np.ndarray:
        if any(n in text for n in names):
            return np.array(coder.encode(text, allowed_special="all"), "<u4")
        return coder.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    return encode


def tokenize(docs: DataFrame, params: PackingParams) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(params), np.array([params.end_id], "<u4").tobytes()
        for batch in small(batches):
            ids = [encode(t).tobytes() + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def cut(tokens: DataFrame, params: PackingParams) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): the pieces of every document."""
    size = (F.octet_length("ids") / WIDTH).cast("long")
    rows = tokens.select("doc_id", "ids", size.alias("doc_tokens"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(params.length).cast("long"))
    rows = rows.select("doc_id", "doc_tokens", "ids", F.explode(starts).alias("start"))
    length = F.least(F.lit(params.length).cast("long"), F.col("doc_tokens") - F.col("start"))
    piece = F.substring("ids", (F.col("start") * WIDTH + 1).cast("int"), F.lit(params.length * WIDTH))
    return rows.select("doc_id", "start", length.alias("length"), "doc_tokens", piece.alias("ids"))


class Tournament:
    """Free space of sequences 0, 1, 2, ...; each inner node holds the most of its two halves."""

    def __init__(self, sequences: int, space: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.most = [space] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """The first sequence with room for ``need``, which is then taken."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < need:
                at += 1
        most[at] -= need
        found = at - self.leaves
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def first_fit_decreasing(lengths: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset in it of each piece; ``lengths`` are in decreasing order."""
    tree = Tournament(len(lengths), space)
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    filled = [0] * len(lengths)
    for k, need in enumerate(lengths.tolist()):
        found = tree.place(need)
        sequence[k], offset[k] = found, filled[found]
        filled[found] += need
    return sequence, offset


def pack(pieces: DataFrame, params: PackingParams) -> DataFrame:
    """``pieces`` with sequence_id and offset. It has doc_id, start, length and any other columns, and is stored."""
    count = pieces.count()
    groups = max(1, -(-count // params.group_pieces))
    columns = pieces.columns
    tie = [c for c in ("doc_id", "start") if c in columns]

    def run(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in tie)]
        group = table.column("group")[0].as_py()
        table = table.select(columns).sort_by(order)
        sequence, offset = first_fit_decreasing(table.column("length").to_numpy(), params.length)
        return table.append_column("sequence_id", pa.array(group * (1 << 32) + sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    own = [c for c in ("doc_id", "start") if c in columns]
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(*own), F.lit(groups)))
    # a group grown large by equal keys, such as null ids, is cut by the place of its stored rows
    parts = F.ceil(F.count(F.lit(1)) / params.group_pieces).cast("int").alias("parts")
    large = dealt.groupBy("group").agg(parts).where("parts > 2")  # a row for each two groups' worth of pieces at most
    dealt = dealt.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(large), "group", "left")
    part = F.pmod(F.xxhash64("place"), F.coalesce("parts", F.lit(1)))
    dealt = dealt.select(*columns, (F.col("group") + F.lit(groups) * part).alias("group"))
    return dealt.groupBy("group").applyInArrow(run, schema)


def packed_sequences(pieces: DataFrame, params: PackingParams) -> DataFrame:
    """(sequence_id, used, ids): whole sequences of packed pieces with ``ids``."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(rows, F.lit(b""), lambda out, r: F.concat(out, r["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"), ids.alias("ids"))


def pack_documents(docs: DataFrame, params: PackingParams | None = None) -> DataFrame:
    """Pieces of all documents with their place, and digests instead of ids."""
    params = params or PackingParams()
    pieces = cut(tokenize(docs, params), params)
    pieces = stored(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return pack(pieces, params)
