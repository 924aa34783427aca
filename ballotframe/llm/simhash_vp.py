"""SimHash near duplicates through vantage-point trees.

A fingerprint has 64 bits. Two fingerprints that differ in at most r bits differ in at most r // 2 bits
in one of their 32-bit halves. So there are two metric trees, one for each half: an inner node holds a
vantage point and a distance t; halves at most t away go left, the others right. Every fingerprint lies in
one leaf (shard) of each tree, and asks all leaves that its ball of radius r // 2 can reach by the triangle
inequality: left if d - r // 2 <= t, right if d + r // 2 > t. A shard compares whole fingerprints, so the
pairs are exact. Trees are fitted on a sample of fingerprints, a few for each shard; every fingerprint is indexed and asked.

A shard is as large as a task can well hold: each level of a tree sends more fingerprints to both sides, so the finer
splits, by more vantage points, are made within a task. Larger shards are split into a grid of chunks across tasks.
A task passes on a spanning forest of the pairs it found, never all pairs of a group.

With ``check``, links of fingerprints only say which texts to compare: within each of their components, all texts are
compared by the Jaccard similarity of their sets of shingles, and components of the similar pairs are the result.

Nulls: a null text is empty. Its fingerprint is zero, linked like any other. A row without doc_id keeps its
fingerprint, has no component and links no others. Repeated rows are copies; each has its row in the result. Of equally
small ids there is one component; an empty table gives no rows; texts are taken whole, and only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_stars
from .shared import ascii_lower_words, stored, text_or_empty

SHINGLES_AT_ONCE = 65_536
BRUTE = 1_024
PAIRS_AT_ONCE = 4_000_000


@dataclass(frozen=True)
class SimHashParams:
    """``shingle``: words of a shingle, 0 for the set of distinct words; ``prints``: fingerprints of a text, from
    different hashes of the features; texts are linked if one of them links; ``radius``: differing bits; ``leaf``: fingerprints wanted in a shard;
    ``sample``: fingerprints a tree is fitted on, or 32 for each ``chunk`` where that is more; ``chunk``: fingerprints of a shard in one task;
    ``check``: words of the shingles that linked texts are compared by, 0 for no check; ``similar``: least Jaccard
    similarity of their sets; ``compared``: shingles of a chunk of texts in one task, a text counts as 1,000 at least."""

    shingle: int = 3
    seed: int = 42
    prints: int = 1
    radius: int = 3
    leaf: int = 32_768
    sample: int = 32_768
    chunk: int = 100_000
    check: int = 0
    similar: float = 0.8
    compared: int = 2_000_000


def rehashed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same features; for k = 0 the hashes themselves."""
    if k == 0:
        return hashes
    x = (hashes ^ np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def fingerprints_of(features: list[bytes], seed: int, prints: int = 1) -> list[int]:
    """A bit is one if it is set in more than half of the features' hashes (XXH64); zero without features."""
    ones = np.zeros((prints, 64), np.int64)
    for at in range(0, len(features), SHINGLES_AT_ONCE):
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in features[at : at + SHINGLES_AT_ONCE]], "<u8")
        for k in range(prints):
            bits = np.unpackbits(rehashed(hashes, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(features), axis=1, bitorder="little").view("<i8").ravel().tolist()


def features_of(text: str, shingle: int) -> list[bytes]:
    words = ascii_lower_words(text)
    if shingle == 0:
        return sorted(set(words))
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)]


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The hashes of the distinct shingles of a text, sorted; a shorter text is one shingle."""
    words = ascii_lower_words(text)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    if len(words) < shingle:
        return hashes[:0] if not words else np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    n = len(words) - shingle + 1
    out = np.zeros(n, np.uint64)
    for k in range(shingle):
        out = rehashed(out ^ hashes[k : k + n], k + 1)
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> int:
    """Equal for texts with equal sets of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def fingerprints(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """(doc_id, fps array<long>), one row per input row; with ``check`` also the digest and size of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests, sizes = [], [], []
            for text in batch.column("text"):
                features = features_of(text.as_py(), params.shingle)
                rows.append(fingerprints_of(features, params.seed, params.prints))
                if params.check:
                    shingles = shingle_set(text.as_py(), params.check)
                    digests.append(set_digest(shingles))
                    sizes.append(len(shingles))
            columns = [batch.column("doc_id"), pa.array(rows, pa.list_(pa.int64()))]
            more = [pa.array(digests, pa.int64()), pa.array(sizes, pa.int64())] if params.check else []
            yield pa.RecordBatch.from_arrays(columns + more, names=["doc_id", "fps", "digest", "size"][: 2 + len(more)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fps array<long>" + (", digest long, size long" if params.check else ""))


def halves(fps: np.ndarray, half: int) -> np.ndarray:
    return (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)


@dataclass
class Node:
    """An inner node has a vantage point; a leaf has a number."""

    leaf: int = -1
    vantage: np.uint32 = np.uint32(0)
    within: int = 0
    left: Node | None = None
    right: Node | None = None


def choose_vantage(points: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[np.uint32, int] | None:
    """Of some vantage points and all distances, the split that leaves least work; None if none helps."""
    best, found = 0.85, None
    for v in points[rng.integers(0, len(points), 12)]:
        for vantage in (v, ~v, np.uint32(rng.integers(0, 2**32))):
            at = np.bincount(np.bitwise_count(points ^ vantage), minlength=33) / len(points)
            up_to = np.cumsum(at)
            for t in range(32):
                asks_left = up_to[min(t + reach, 32)]
                asks_right = 1 - (up_to[t - reach] if t >= reach else 0)
                work = up_to[t] * asks_left + (1 - up_to[t]) * asks_right
                if work < best:
                    best, found = work, (vantage, t)
    return found


def build_tree(points: np.ndarray, weight: float, leaf: int, reach: int) -> tuple[Node, int]:
    """A tree over a sample of halves, each standing for ``weight`` of them, and its number of leaves."""
    rng, count = np.random.default_rng(7), 0

    def grow(part: np.ndarray) -> Node:
        nonlocal count
        if len(part) * weight > leaf and len(part) >= 32 and (split := choose_vantage(part, reach, rng)):
            near = np.bitwise_count(part ^ split[0]) <= split[1]
            return Node(vantage=split[0], within=split[1], left=grow(part[near]), right=grow(part[~near]))
        count += 1
        return Node(leaf=count - 1)

    return grow(points), count


def route(node: Node, points: np.ndarray, rows: np.ndarray, reach: int, out: list[tuple[int, np.ndarray]]) -> None:
    """Adds (leaf, rows) for each leaf that a ball of radius ``reach`` around the points meets; 0: the home leaf."""
    if not len(rows):
        return
    if node.leaf >= 0:
        out.append((node.leaf, rows))
        return
    d = np.bitwise_count(points[rows] ^ node.vantage).astype(np.int64)
    route(node.left, points, rows[d - reach <= node.within], reach, out)
    route(node.right, points, rows[d + reach > node.within], reach, out)


class Forest:
    """Labels of nodes that pairs have joined."""

    def __init__(self, n: int):
        self.label, self.parent = np.arange(n), np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, one: int, others: np.ndarray) -> None:
        """Joins ``one`` with all ``others``."""
        top = self.root(self.label[one])
        labels = self.label[others]
        for x in np.unique(labels[labels != top]):
            low, high = sorted((self.root(x), top))
            self.parent[high] = low
            top = low
        self.label[others] = top
        self.label[one] = top

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in self.label], np.int64)


def join_within(fps: np.ndarray, data: np.ndarray, asked: np.ndarray, half: int, radius: int, forest: Forest, rng: np.random.Generator) -> None:
    """Joins every pair of a row of ``data`` and a row of ``asked`` at most ``radius`` bits apart."""
    if not len(data) or not len(asked):
        return
    if len(data) > BRUTE and (split := choose_vantage(halves(fps[data], half)[rng.integers(0, len(data), 2_048)], radius // 2, rng)):
        near = np.bitwise_count(halves(fps[data], half) ^ split[0]).astype(np.int64) <= split[1]
        d = np.bitwise_count(halves(fps[asked], half) ^ split[0]).astype(np.int64)
        join_within(fps, data[near], asked[d - radius // 2 <= split[1]], half, radius, forest, rng)
        join_within(fps, data[~near], asked[d + radius // 2 > split[1]], half, radius, forest, rng)
        return
    step = max(1, PAIRS_AT_ONCE // len(data))
    bits = fps.view(np.uint64)
    for k in range(0, len(asked), step):
        some = asked[k : k + step]
        close = np.bitwise_count(bits[some][:, None] ^ bits[data][None, :]) <= radius
        for i in np.flatnonzero(close.sum(1) > 0):
            forest.join(some[i], data[close[i]])


def close_links(points: DataFrame, params: SimHashParams) -> DataFrame:
    """(a, b), a > b: a spanning forest of the links between fingerprints at most ``radius`` bits apart.

    ``points``: (print, fp, node), stored, each fingerprint once; only fingerprints of one ``print`` are compared.
    """
    spark, reach = points.sparkSession, params.radius // 2
    n = points.count() // params.prints
    share = min(1.0, max(params.sample, 32 * n // params.chunk) / max(n, 1))  # enough for leaves of a chunk
    chosen = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    sample: list[list[int]] = [[] for _ in range(params.prints)]
    for r in points.where(chosen).select("print", "fp").collect():
        sample[r["print"]].append(r.fp)
    trees = []
    for own in sample:
        weight = n / max(len(own), 1)
        trees.append([build_tree(halves(np.array(own, np.int64), h), weight, params.leaf, reach)[0] for h in range(2)])
    sent = spark.sparkContext.broadcast(trees)
    kinds = [("print", pa.int32()), ("half", pa.int32()), ("leaf", pa.int32()), ("asks", pa.bool_()), ("fp", pa.int64()), ("node", pa.int64())]
    schema = pa.schema(kinds)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, fps, nodes = (batch.column(k).to_numpy() for k in ("print", "fp", "node"))
            for k, half in product(range(params.prints), range(2)):
                values, own = halves(fps, half), np.flatnonzero(prints == k)
                for asks in (False, True):
                    met: list[tuple[int, np.ndarray]] = []
                    route(sent.value[k][half], values, own, reach if asks else 0, met)
                    if not met:
                        continue
                    leaf = np.concatenate([np.full(len(rows), leaf, np.int32) for leaf, rows in met])
                    rows = np.concatenate([rows for _, rows in met])
                    same = [np.full(len(rows), x, np.int32) for x in (k, half)]
                    columns = [*same, leaf, np.full(len(rows), asks), fps[rows], nodes[rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    leaf = ["print", "half", "leaf"]
    sent_rows = stored(points.select("print", "fp", "node").mapInArrow(send, "print int, half int, leaf int, asks boolean, fp long, node long"))
    sizes = sent_rows.groupBy(leaf).agg(F.count_if("asks").alias("asking"), F.count_if(~F.col("asks")).alias("held"))
    sizes = sizes.select(*leaf, *(F.ceil(F.col(k) / params.chunk).cast("int").alias(f"{k}_chunks") for k in ("asking", "held")))
    # one row for each leaf of trees that a bounded sample was grown to
    cut = sent_rows.join(F.broadcast(sizes), leaf)
    own, other = F.col("asking_chunks"), F.col("held_chunks")
    at = F.xxhash64("fp")
    cells = F.when(
        F.col("asks"), F.transform(F.sequence(F.lit(0), other - 1), lambda k: F.struct(F.pmod(at, own).cast("int").alias("q"), k.alias("d")))
    ).otherwise(F.transform(F.sequence(F.lit(0), own - 1), lambda k: F.struct(k.alias("q"), F.pmod(at, other).cast("int").alias("d"))))
    cut = cut.where((own > 0) & (other > 0)).withColumn("cell", F.explode(cells))
    cut = cut.select(*leaf, F.col("cell.q").alias("q"), F.col("cell.d").alias("d"), "asks", "fp", "node")
    radius = params.radius

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        fps, first, place = np.unique(group["fp"].to_numpy(), return_index=True, return_inverse=True)
        nodes, asks = group["node"].to_numpy()[first], group["asks"].to_numpy()
        forest = Forest(len(fps))
        join_within(fps, place[~asks], place[asks], int(group["half"].iloc[0]), radius, forest, np.random.default_rng(7))
        roots = forest.roots()
        least = np.full(len(fps), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, nodes)
        least = least[roots]
        return pd.DataFrame({"a": nodes[nodes != least], "b": least[nodes != least]})

    return cut.groupBy(*leaf, "q", "d").applyInPandas(pairs, "a long, b long")


def linked(nodes: DataFrame, params: SimHashParams) -> DataFrame:
    """(a, b): each node but the smallest of its component, with that node. ``nodes``: (fps, node), stored."""
    every = nodes.select(F.posexplode("fps").alias("print", "fp"), "node")
    points = stored(every.groupBy("print", "fp").agg(F.min("node").alias("node")))
    edges = close_links(points, params)
    if params.prints > 1 or params.check:
        least = points.withColumnRenamed("node", "least")
        same = every.join(least, ["print", "fp"]).where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
        edges = edges.unionByName(same)
    return component_stars(edges)


def join_similar(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, similar: float, forest: Forest) -> None:
    """Joins every pair of a row and a column whose sets have at least this Jaccard similarity.

    Sets of n elements with that similarity share one of the n - ceil(similar * n) + 1 elements that come first in any
    common order; here rare ones come first. Pairs that are joined already are not compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not len(ends) or not ends[-1]:
        return
    _, tokens, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(times), np.int64)
    place[np.argsort(times, kind="stable")] = np.arange(len(times))
    tokens = place[tokens]
    for s, e in zip(starts, ends, strict=True):
        tokens[s:e].sort()
    first = sizes - np.ceil(similar * sizes - 1e-9).astype(np.int64) + 1
    held = np.flatnonzero(columns & (sizes > 0))
    of = np.repeat(held, first[held])
    key = np.concatenate([tokens[starts[k] : starts[k] + first[k]] for k in held]) if len(held) else tokens[:0]
    order = np.argsort(key, kind="stable")
    of, bounds = of[order], np.searchsorted(key[order], np.arange(len(times) + 1))
    mark, met = np.zeros(len(times), np.int64), np.zeros(len(sets), bool)
    for k in np.flatnonzero(rows & (sizes > 0)):
        for t in tokens[starts[k] : starts[k] + first[k]]:
            met[of[bounds[t] : bounds[t + 1]]] = True
        others = np.flatnonzero(met)
        met[others] = False
        # a pair of two rows that are columns too is compared once
        others = others[~(rows[others] & columns[k]) | (others > k)]
        low, high = np.minimum(sizes[others], sizes[k]), np.maximum(sizes[others], sizes[k])
        others = others[(low >= similar * high - 1e-9) & (others != k)]
        top = forest.root(forest.label[k])
        others = others[[forest.root(x) != top for x in forest.label[others]]] if len(others) else others
        mark[tokens[starts[k] : ends[k]]] = 1
        alike = []
        for j in others:
            both = int(mark[tokens[starts[j] : ends[j]]].sum())
            if both >= similar * (sizes[k] + sizes[j] - both) - 1e-9:
                alike.append(j)
        mark[tokens[starts[k] : ends[k]]] = 0
        if alike:
            forest.join(k, np.array(alike))


def similar_links(docs: DataFrame, nodes: DataFrame, stars: DataFrame, params: SimHashParams) -> DataFrame:
    """(a, b), a > b: a spanning forest of the similar pairs within each component of ``stars``.

    ``nodes``: (node, size), a node is the digest of a shingle set. A component with more shingles than a chunk is cut
    by size first: sizes of a similar pair lie in one class or in two that follow each other. Classes that are still
    larger are compared in a grid of chunks. Every pair of texts that can be similar meets in a task.
    """
    near = stars.select(F.col("a").alias("node"), F.col("b").alias("top"))
    near = stored(near.unionByName(near.select(F.col("top").alias("node"), "top").distinct()).join(nodes, "node"))
    weight = F.sum(F.greatest("size", F.lit(1_000)))
    big = near.groupBy("top").agg(weight.alias("all")).where(F.col("all") > params.compared).select("top", F.lit(True).alias("big"))
    # neighbouring classes overlap by a little, so that rounding loses no pair
    step = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.log(F.lit(1.001 / params.similar))).cast("int")
    near = stored(near.join(big, "top", "left").withColumn("class", F.when(F.col("big"), step).otherwise(0)))
    lower = near.where("big").withColumn("class", F.col("class") + 1).withColumn("row", F.lit(False))
    both = near.withColumn("row", F.lit(True)).unionByName(lower)
    ceil = lambda c: F.ceil(c / params.compared).cast("int")
    held = F.greatest("size", F.lit(1_000))
    sizes = both.groupBy("top", "class").agg(ceil(F.sum(F.when(F.col("row"), held))).alias("qs"), ceil(F.sum(held)).alias("ds"))
    at = F.xxhash64("node")
    cut = both.join(sizes.where("qs > 0"), ["top", "class"]).withColumn("q", F.pmod(at, "qs").cast("int")).withColumn("d", F.pmod(at, "ds").cast("int"))
    cell = lambda q, d, row, column: F.struct(q.alias("q"), d.alias("d"), row.alias("row"), column.alias("column"))
    own, yes, no = F.col("row"), F.lit(True), F.lit(False)
    as_row = F.when(own, F.transform(F.sequence(F.lit(0), F.col("ds") - 1), lambda d: cell(F.col("q"), d, yes, d == F.col("d"))))
    as_column = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: cell(q, F.col("d"), no, yes))
    as_column = F.when(own, F.filter(as_column, lambda c: c["q"] != F.col("q"))).otherwise(as_column)
    cells = F.when(own, F.concat(as_row, as_column)).otherwise(as_column)
    cut = cut.select("node", "top", "class", F.explode(cells).alias("c")).select("node", "top", "class", "c.*")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            digests = [set_digest(shingle_set(t.as_py(), params.check)) for t in batch.column("text")]
            new = [k for k, x in enumerate(digests) if not (x in seen or seen.add(x))]
            yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in new], pa.int64()), batch.column("text").take(pa.array(new, pa.int64()))], names=["node", "text"])

    texts = docs.where("doc_id IS NOT NULL").select(text_or_empty().alias("text")).mapInArrow(once, "node long, text string")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[np.ndarray, bool, bool]] = {}
        for batch in batches:
            for node, row, column, text in zip(*(batch.column(k).to_pylist() for k in ("node", "row", "column")), batch.column("text"), strict=True):
                if node not in sets:
                    sets[node] = shingle_set(text.as_py(), params.check), row, column
        nodes = np.array(list(sets), np.int64)
        shingles, rows, columns = zip(*sets.values(), strict=True)
        forest = Forest(len(nodes))
        join_similar(list(shingles), np.array(rows), np.array(columns), params.similar, forest)
        roots = forest.roots()
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, nodes)
        least = least[roots]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != least]), pa.array(least[nodes != least])], names=["a", "b"])

    return cut.join(texts, "node").select("top", "class", "q", "d", "node", "row", "column", "text").groupBy("top", "class", "q", "d").applyInArrow(compare, "a long, b long")


def labelled_sets(docs: DataFrame, params: SimHashParams) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fps, digest, size) of each row, and (node, id, top): each shingle set's least doc_id and component; stored."""
    prints = stored(fingerprints(docs, params))
    nodes = prints.where("doc_id IS NOT NULL").groupBy(F.col("digest").alias("node"))
    nodes = stored(nodes.agg(F.first("fps").alias("fps"), F.first("size").alias("size"), F.min("doc_id").alias("id")))
    edges = similar_links(docs, nodes.select("node", "size"), linked(nodes.select("fps", "node"), params), params)
    stars = component_stars(edges)
    labels = nodes.join(stars.select(F.col("a").alias("node"), "b"), "node", "left").select("node", "id", F.coalesce("b", "node").alias("top"))
    return prints, stored(labels)


def checked_duplicates(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """near_duplicates with ``check``."""
    prints, labels = labelled_sets(docs, params)
    least = labels.groupBy("top").agg(F.min("id").alias("least"))
    labels = labels.join(least, "top").select(F.col("node").alias("digest"), "least")
    return prints.join(labels, "digest", "left").select("doc_id", "fps", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, params: SimHashParams | None = None) -> DataFrame:
    """(doc_id, fps, component_id) for each row: the smallest doc_id that links reach from it."""
    params = params or SimHashParams()
    if params.check:
        return checked_duplicates(docs, params)
    prints = stored(fingerprints(docs, params))
    nodes = stored(prints.where("doc_id IS NOT NULL").groupBy("fps").agg(F.min("doc_id").alias("node")))
    stars = linked(nodes, params)
    labels = nodes.join(stars.select(F.col("a").alias("node"), "b"), "node", "left").select("fps", F.coalesce("b", "node").alias("least"))
    return prints.join(labels, "fps", "left").select(
        "doc_id", "fps", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id")
    )


#: For removing near copies: near copies share most of their words, so fingerprints of the word set stay close when
#: shingles do not; eight of them catch nearly all texts whose five-word shingles are similar to 0.8 or more. They also
#: join many that are not, so all linked texts are compared by their shingles.
NEAR_COPIES = SimHashParams(shingle=0, prints=8, check=5)


def one_of_each(docs: DataFrame, params: SimHashParams = NEAR_COPIES) -> DataFrame:
    """One row of each component of ``docs``, one with its smallest doc_id; rows without doc_id stay.

    Rows are told apart by their id and their shingle set: of rows with one id and texts that are not similar, each component
    keeps its own. ``params`` must have a ``check``.
    """
    if not params.check:
        raise ValueError("rows are told apart by the shingles of a check")
    prints, labels = labelled_sets(docs, params)
    chosen = labels.groupBy("top").agg(F.min(F.struct("id", "node")).alias("c"))
    chosen = chosen.select(F.col("c.id").alias("__id"), F.col("c.node").alias("__digest"))
    shared = prints.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__rows"))
    shared = shared.where("__rows > 1").select("__id", F.lit(True).alias("__shared"))
    chosen = stored(chosen.join(shared, "__id", "left"))
    named = docs.where("doc_id IS NOT NULL").withColumn("__id", F.col("doc_id").cast("long"))
    kept = named.join(chosen.where("__shared IS NULL").select("__id"), "__id", "left_semi").select(*docs.columns)
    kept = kept.unionByName(docs.where("doc_id IS NULL"))
    several = chosen.where("__shared")
    if several.isEmpty():
        return kept

    @F.pandas_udf("long")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([set_digest(shingle_set(t, params.check)) for t in texts], dtype="int64")

    again = named.join(several.select("__id").distinct(), "__id", "left_semi").withColumn("__digest", digest(text_or_empty()))
    again = again.join(several.select("__id", "__digest"), ["__id", "__digest"], "left_semi").dropDuplicates(["__id", "__digest"])
    return kept.unionByName(again.select(*docs.columns))


def fingerprint_components(docs: DataFrame, params: SimHashParams | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): the fingerprint in 16 hexadecimal digits."""
    return near_duplicates(docs, params).select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")
