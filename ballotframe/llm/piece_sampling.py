"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

All segmentations of a text into pieces form a lattice. No piece crosses from a character to a space mark, so the lattice
is a chain of small lattices, one for each *unit* (space marks and the word after them). A segmentation's weight is the
product of its pieces' probabilities, which follow Zipf's law in the order of the vocabulary. Sums over all endings of a
unit turn the weights into decisions: at each place, the probability of every piece that may come next.

Sampling is a best-first search over the tree of decisions. A node's priority is the largest Gumbel-perturbed log
probability among the segmentations below it. The best segmentation of a subtree follows its probabilities and has the
subtree's priority; at each decision on its way it leaves the other choices behind as one new node, whose priority is a
Gumbel of their probability, truncated at the parent's. Taking the best node again and again gives distinct segmentations,
an exact sample without replacement. The priority of the first one not taken gives each its inclusion probability.

Random numbers are a hash of a row's key, the sample, the place and the step, so they depend on nothing else. All texts of
a block take a step at once in numpy. Units are cut from whole texts; a long unit is a long lattice and nothing is cut off.

Nulls: a null text is empty: one segmentation without pieces. A null doc_id is a key like any other. A text with fewer
segmentations than asked for gives all of them, each included for certain. Repeated rows give the same samples again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, text_or_empty

# A space, and a space mark that stands in the text itself: a lone surrogate, which no text holds.
MARK, PLAIN_MARK = "▁", "\ud800"
UNIT = re.compile(f"{MARK}*[^{MARK}]*")
NONE = -np.inf


@dataclass(frozen=True)
class SamplingParams:
    """``model``: a SentencePiece model file; ``sharpness``: power of the probabilities; ``held``: places kept at once."""

    model: str = ""
    samples: int = 2
    seed: int = 0
    sharpness: float = 1.0
    held: int = 2_500_000
    block_chars: int = 1_000_000


def processor(params: SamplingParams):
    import sentencepiece

    if params.model:
        return sentencepiece.SentencePieceProcessor(model_file=params.model)
    import public_tokenizers

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


class Vocabulary:
    """Pieces with their ids and log probabilities; ids of the byte pieces."""

    def __init__(self, params: SamplingParams):
        sp = processor(params)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        silent = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        ordinary = [i for i in range(n) if not silent[i] and i not in self.byte_of]
        log_p = -np.log(np.arange(len(ordinary)) + 2.7)
        log_p -= np.log(np.exp(log_p).sum())
        self.scores = np.zeros(n)
        self.scores[ordinary] = params.sharpness * log_p
        self.byte_score = params.sharpness * (float(log_p[-1]) - 1.0)
        #: The pieces of one character by code point, -1 for none.
        self.single = np.full(0x110000, -1, np.int32)
        #: Finds all longer pieces in a text; a found piece is its id and its length.
        self.matches = ahocorasick.Automaton()
        for i in ordinary:
            if len(self.pieces[i]) == 1:
                self.single[ord(self.pieces[i])] = i
            else:
                self.matches.add_word(self.pieces[i], i << 8 | len(self.pieces[i]))
        self.matches.make_automaton()

    def decode(self, ids) -> str:
        """The text that pieces stand for; byte pieces are joined and read as UTF-8."""
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            else:
                out += self.pieces[i].replace(MARK, " ").encode("utf-8", "surrogatepass")
        text = out.decode("utf-8", "surrogatepass" if b"\xed" in out else "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def vocabulary(params: SamplingParams) -> Vocabulary:
    """The vocabulary, kept for the tasks that a worker runs one after the other."""
    return Vocabulary(params)


class Units:
    """The lattices of units. Places are numbered through: one for each character of a unit and one for its end. A place's
    edges lie together, each with its probability. New units are collected and solved together."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.places = 0
        self.several: dict[int, tuple[int, ...]] = {}  # edges that stand for more than one id
        self.begin, self.to, self.ids = (np.zeros(n, np.int32) for n in (1, 0, 0))
        self.log_p = np.zeros(0)
        self._new: list[str] = []

    def get(self, unit: str) -> int:
        """The first place of a unit."""
        found = self.index.get(unit)
        if found is None:
            found = self.index[unit] = self.places
            self.places += len(unit) + 1
            self._new.append(unit)
        return found

    def _edges(self, text: str, unit_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[int, ...]]]:
        """First character, length, id and score of all edges of the joined new units, by first character."""
        found = np.fromiter((end << 32 | code for end, code in self.v.matches.iter(text)), np.int64)
        ids, size = (found & 0xFFFFFFFF) >> 8, found & 0xFF
        first = (found >> 32) - size + 1
        inside = unit_of[first] == unit_of[found >> 32]
        single = self.v.single[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        alone, bare = np.flatnonzero(single >= 0), np.flatnonzero(single < 0)  # what is no piece stands as its bytes
        raw = [[self.v.byte_ids[x] for x in (MARK if text[k] == PLAIN_MARK else text[k]).encode("utf-8", "surrogatepass")] for k in bare]
        known = np.concatenate([ids[inside], single[alone]])
        score = np.concatenate([self.v.scores[known], [len(r) * self.v.byte_score for r in raw]])
        first = np.concatenate([first[inside], alone, bare])
        size = np.concatenate([size[inside], np.ones(len(text), np.int64)])
        ids = np.concatenate([known, np.array([r[0] for r in raw], np.int64)])
        order = np.argsort(first, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[len(place) - len(bare) :].tolist()
        several = {k: tuple(r) for k, r in zip(at, raw, strict=True) if len(r) > 1}
        return first[order], size[order], ids[order], score[order], several

    def solve(self) -> None:
        """Edges and probabilities of new units, from sums over their endings."""
        if not self._new:
            return
        sizes = np.array([len(x) for x in self._new], np.int64)
        unit_of = np.repeat(np.arange(len(sizes)), sizes)
        first, size, ids, score, several = self._edges("".join(self._new), unit_of)
        place = first + unit_of[first]  # of the new places
        to = place + size
        begin = np.searchsorted(place, np.arange(int(sizes.sum()) + len(sizes) + 1))
        rest = np.zeros(len(begin) - 1)
        ends = np.cumsum(sizes + 1) - 1
        order = np.argsort(-sizes, kind="stable")
        ends, longest = ends[order], int(sizes[order[0]])
        live = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
        for back, n in enumerate(live, 1):
            at = ends[:n] - back
            count = begin[at + 1] - begin[at]
            offsets = np.cumsum(count) - count
            edges = np.repeat(begin[at] - offsets, count) + np.arange(int(count.sum()))
            rest[at] = np.logaddexp.reduceat(score[edges] + rest[to[edges]], offsets)
        log_p = score + rest[to] - rest[place]
        old_places, old_edges = len(self.begin) - 1, len(self.to)
        self.several |= {old_edges + k: r for k, r in several.items()}
        self.begin = np.concatenate([self.begin, (old_edges + begin[1:]).astype(np.int32)])
        self.to = np.concatenate([self.to, (old_places + to).astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.log_p = np.concatenate([self.log_p, log_p])
        self._new = []


GOLDEN, M1, M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(key: np.ndarray, *parts) -> np.ndarray:
    """A hash of unsigned 64-bit keys and small integers."""
    x = key
    for part in parts:
        x = (x + np.asarray(part).astype(np.uint64) + np.uint64(1)) * GOLDEN
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        x = x ^ (x >> np.uint64(31))
    return x


def uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers strictly between 0 and 1, from the hash."""
    return ((mixed(key, *parts) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def truncated(value, top):
    """A Gumbel's value, given that it is at most ``top``, from its value without that limit. It keeps the order."""
    return -np.logaddexp(-top, -value)


class Walk:
    """The decisions of one sample after it left an earlier one, and what it left behind: the largest perturbed log
    probability of the other choices at each decision, before it is truncated at the sample's own (``top``)."""

    def __init__(self, edges, places, units, left, top, parent, at):
        self.edges, self.places, self.units, self.left, self.top = edges, places, units, left, top
        self.parent, self.at = parent, at  # the first ``at`` decisions of ``parent`` come before
        self.gone: dict[int, list[int]] = {}

    def best(self) -> tuple[float, int]:
        at = int(self.left.argmax())
        value = float(self.left[at])
        return (float(truncated(value, self.top)) if value > NONE else NONE), at

    def keep(self, at: int, value: float) -> None:
        """Puts what is left at a decision to ``value``, which is truncated already."""
        gap = self.top - value
        self.left[at] = self.top - (gap if gap > 30 else float(np.log(np.expm1(max(gap, 1e-300)))))


def walk_block(u: Units, key: np.ndarray, row: np.ndarray, unit: np.ndarray, place: np.ndarray, sample: int, step: int = 0):
    """Walks from the given places to the ends of their units; returns (which walk, edges, places) in order."""
    which, edges, places = [], [], []
    own = mixed(key[row], sample, unit)
    active = np.flatnonzero(u.begin[place] < u.begin[place + 1])
    at = place[active]
    while len(active):
        r = uniform(own[active], step)
        e = u.begin[at].copy()
        last = u.begin[at + 1] - 1
        share = np.exp(u.log_p[e])
        open_ = np.flatnonzero((r > share) & (e < last))
        share = share[open_]
        while len(open_):
            r[open_] -= share
            e[open_] += 1
            share = np.exp(u.log_p[e[open_]])
            more = (r[open_] > share) & (e[open_] < last[open_])
            open_, share = open_[more], share[more]
        which.append(active)
        edges.append(e)
        places.append(at)
        at = u.to[e]
        more = u.begin[at] < u.begin[at + 1]
        active, at, step = active[more], at[more], step + 1
    if not which:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    which, edges, places = map(np.concatenate, (which, edges, places))
    order = np.argsort(which, kind="stable")
    return which[order], edges[order], places[order]


def sample_block(u: Units, keys: list[int], units: list[np.ndarray], k: int) -> list[list[tuple[list[np.ndarray], float, float, float]]]:
    """For each text its samples, best first: (runs of edges, log probability, perturbed log probability, log inclusion)."""
    n = len(keys)
    key = np.array(keys, np.uint64)
    sizes = np.array([len(x) for x in units], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    all_units = np.concatenate([*units, np.zeros(0, np.int64)]).astype(np.int64)
    local = np.arange(len(all_units)) - np.repeat(starts[:-1], sizes)
    row = np.repeat(np.arange(n), sizes)
    tops = [[float(g)] for g in gumbel(uniform(key, 0, 1 << 40, 0))]
    walks: list[list[Walk]] = [[] for _ in range(n)]
    #: What to walk in this round: text, first unit, place in it, and the walk it leaves.
    todo = [(i, 0, -1, None, 0) for i in range(n)]
    for sample in range(k):
        if not todo:
            break
        texts = np.array([t[0] for t in todo], np.int64)
        from_unit = np.array([t[1] for t in todo], np.int64)
        count = sizes[texts] - from_unit
        offsets = np.concatenate([[0], np.cumsum(count)])
        index = np.repeat(starts[texts] + from_unit - offsets[:-1], count) + np.arange(int(count.sum()))
        place = all_units[index] if len(index) else np.zeros(0, np.int64)
        for j, (_, _, p, _, _) in enumerate(todo):
            if p >= 0:
                place[offsets[j]] = p
        which, edges, places = walk_block(u, key, row[index], local[index], place, sample, 1 if sample else 0)
        of_todo = np.repeat(np.arange(len(todo)), count)[which]
        bounds = np.searchsorted(of_todo, np.arange(len(todo) + 1))
        log_p = u.log_p[edges]
        before = np.concatenate([[0.0], np.cumsum(log_p)[:-1]]) if len(log_p) else log_p
        at_start = before[np.minimum(bounds[:-1], max(len(before) - 1, 0))] if len(before) else np.zeros(len(todo))
        shift = np.array([0.0 if w is None else w_log(w, at, u) for _, _, _, w, at in todo])
        prefix = before - np.repeat(at_start - shift, np.diff(bounds))
        with np.errstate(divide="ignore"):
            others = np.log1p(-np.minimum(np.exp(log_p), 1.0))
        others[np.diff(u.begin)[places] == 1] = NONE
        steps = np.arange(len(edges)) - np.repeat(bounds[:-1], np.diff(bounds))
        left = prefix + others + gumbel(uniform(mixed(key[texts], sample, 1 << 41)[of_todo], steps))
        unit_of = local[index][which]
        again = []
        for j, (i, _, _, parent, at) in enumerate(todo):
            s = slice(bounds[j], bounds[j + 1])
            walks[i].append(Walk(edges[s], places[s], unit_of[s], left[s], tops[i][-1], parent, at))
            best, where, at = NONE, None, 0
            for w in walks[i]:
                if len(w.left) and (found := w.best())[0] > best:
                    (best, at), where = found, w
            tops[i].append(best)
            if where is not None and sample + 1 < k:
                again.append((i, sample + 1, where, at))
        todo = [turn(u, key, sizes, x, tops[x[0]][-1]) for x in again]
    return [finish(u, walks[i], tops[i]) for i in range(n)]


def w_log(w: Walk, at: int, u: Units) -> float:
    """The log probability of a walk's decisions before ``at``, with all that came before the walk."""
    own = float(u.log_p[w.edges[:at]].sum())
    return own if w.parent is None else own + w_log(w.parent, w.at, u)


def turn(u: Units, key: np.ndarray, sizes: np.ndarray, x, top: float):
    """Takes another choice at a decision; returns what is left to walk. The choice is kept as a walk of one decision."""
    i, sample, w, at = x
    place = int(w.places[at])
    low, high = int(u.begin[place]), int(u.begin[place + 1])
    gone = w.gone.setdefault(at, [int(w.edges[at])])
    open_ = [e for e in range(low, high) if e not in gone]
    p = np.exp(u.log_p[open_])
    r = float(uniform(key[i : i + 1], sample, int(w.units[at]), 1 << 42)[0]) * p.sum()
    edge = open_[min(int(np.searchsorted(np.cumsum(p), r)), len(open_) - 1)]
    gone.append(edge)
    rest = float(p.sum() - np.exp(u.log_p[edge])) if len(open_) > 1 else 0.0
    prefix = w_log(w, at, u)
    if rest > 0:
        number = uniform(key[i : i + 1], sample, int(w.units[at]), 1 << 43)
        w.keep(at, float(truncated(prefix + np.log(rest) + gumbel(number)[0], top)))
    else:
        w.left[at] = NONE
    one = np.array([edge], np.int64)
    bridge = Walk(one, w.places[at : at + 1], w.units[at : at + 1], np.array([NONE]), top, w, at)
    return i, int(w.units[at]), int(u.to[edge]), bridge, 1


def finish(u: Units, walks: list[Walk], tops: list[float]):
    """The samples of a text with their log probabilities; the last priority is that of the first one not taken."""
    out = []
    for w, perturbed in zip(walks, tops, strict=False):
        runs, log_p, at, now = [], 0.0, len(w.edges), w
        while now is not None:
            run = now.edges[:at]
            runs.append(run)
            log_p += float(u.log_p[run].sum())
            at, now = now.at, now.parent
        gap = log_p - tops[len(walks)]
        inclusion = 0.0 if gap == np.inf or gap > 700 else float(np.log(-np.expm1(-np.exp(gap)))) if gap > -30 else gap
        out.append((runs[::-1], log_p, perturbed, inclusion))
    return out


def piece_ids(u: Units, runs: list[np.ndarray]) -> np.ndarray:
    edges = np.concatenate([*runs, np.zeros(0, np.int64)]).astype(np.int64)
    if u.several and (places := [k for k, e in enumerate(edges.tolist()) if e in u.several]):
        parts, done = [], 0
        for k in places:
            parts += [u.ids[edges[done:k]], np.array(u.several[int(edges[k])])]
            done = k + 1
        return np.concatenate([*parts, u.ids[edges[done:]]]).astype("<u4")
    return u.ids[edges].astype("<u4")


def units_of(text: str) -> list[str]:
    """The units of a text after a space mark."""
    marked = (MARK + text.replace(MARK, PLAIN_MARK).replace(" ", MARK)) if text else ""
    return UNIT.findall(marked)[:-1]


def blocks_of(rows: Iterator[tuple], chars: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += len(row[1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


SAMPLES = pa.schema(
    [("doc_id", pa.int64()), ("rank", pa.int32()), ("ids", pa.binary()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()),
     ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]
)
SAMPLES_DDL = "doc_id long, rank int, ids binary, n_pieces long, log_prob double, perturbed double, log_inclusion double"


def sample_segmentations(docs: DataFrame, params: SamplingParams | None = None) -> DataFrame:
    """(doc_id, rank, ids, n_pieces, log_prob, perturbed, log_inclusion): distinct segmentations of each text, best first.

    ``ids``: piece ids as little-endian unsigned 32-bit integers.
    """
    p = params or SamplingParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = Units(vocabulary(p))
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for block in blocks_of(rows, p.block_chars):
                if u.places > p.held:
                    u.clear()
                get = u.get
                units = [np.array([get(x) for x in units_of(text)], np.int64) for _, text in block]
                u.solve()
                keys = [xxhash.xxh64_intdigest(str(doc_id), p.seed) for doc_id, _ in block]
                out: list[list] = [[] for _ in SAMPLES]
                for (doc_id, _), samples in zip(block, sample_block(u, keys, units, p.samples), strict=True):
                    for rank, (runs, log_p, perturbed, inclusion) in enumerate(samples, 1):
                        ids = piece_ids(u, runs)
                        for column, x in zip(out, (doc_id, rank, ids.tobytes(), len(ids), log_p, perturbed, inclusion), strict=True):
                            column.append(x)
                yield batch_of(SAMPLES, out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SAMPLES_DDL)


def decode(samples: DataFrame, params: SamplingParams | None = None) -> DataFrame:
    """``samples`` (doc_id, rank, ids) with the text that the ids stand for."""
    p = params or SamplingParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(p)
        for batch in batches:
            texts = [v.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rank"), pa.array(texts, pa.string())], names=["doc_id", "rank", "text"])

    return samples.select("doc_id", "rank", "ids").mapInArrow(run, "doc_id long, rank int, text string")
