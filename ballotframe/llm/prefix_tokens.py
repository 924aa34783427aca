"""Token counts by prefix dynamic programming: the exact count of tokens of every prefix of a text, in one pass.

A byte-pair encoding is a sequence of tokens of which every two neighbours, encoded together, stay as they are. So the
encoding of a word's first i letters ends in the one token t for which the encoding of the letters before t ends in a
token compatible with t, and

    tokens(i) = tokens(i - |t|) + 1

Going over i from left to right finds the last token and the count of every prefix with a few look-ups for each letter,
and no prefix is encoded anew. Two tokens are compatible if no merge across their border would come before the merges that
made the symbols at the border. The vocabulary marks the last symbol of a word, so each prefix has a second last token,
with the mark, which nothing follows; counts are those of the prefixes as whole texts.

Counts are kept as one binary value for each text (32-bit integers, big-endian, one for each number of code points from
0 on). ``count_at`` and ``longest_prefix`` answer how many tokens a prefix has and how much of a text a budget holds from
these values alone. A longer prefix can have fewer tokens than a shorter one; ``longest_prefix`` is the longest of all
prefixes that fit. In a word that normalisation changes there is no cut within a character and the marks that may be
joined to it: such places count as the place before the character. Texts are split at white space, which no token holds, so a cache of chunks spares
most of the work; it is emptied when full.

Nulls: a null text is empty and has no tokens; a null doc_id is kept as it is. Repeated rows are counted each, ties cannot
arise, other columns are not read, an empty table gives an empty table. Texts of any length are taken whole: work grows
with their length, memory with that of one batch.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, text_or_empty

UNIT = re.compile("[^ \t\n\r]*[ \t\n\r]+|[^ \t\n\r]+")
WIDTH = 4  # bytes of a count
NEVER = 1 << 60
FEW = 16


@dataclass(frozen=True)
class PrefixParams:
    """``vocabulary``: a byte-pair vocabulary with word ends; chunks and pairs of tokens a worker remembers; code points at a time."""

    vocabulary: str = ""
    chunks: int = 400_000
    pairs: int = 2_000_000
    chars_at_once: int = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Table:
    """A map from integers to integers that looks up arrays: open addressing, -1 for what it does not hold."""

    def __init__(self, size: int):
        self.bits = max(4, (2 * size - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.n, self.size = 0, size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are not there yet, each once."""
        if self.n + len(keys) > self.size:
            self.__init__(max(self.size, len(keys)))
        mask = (1 << self.bits) - 1
        slots = self._slot(keys).tolist()
        for slot, key, value in zip(slots, keys.tolist(), values.tolist(), strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) & mask
            self.keys[slot], self.values[slot] = key, value
        self.n += len(keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((held != keys) & (held != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (held != -1)]
        return out


class Merges:
    """Tokens in a trie of bytes, and which of them can stand side by side."""

    def __init__(self, merges: list, symbols: list[str], end: str, pairs: int):
        made = {a + b: (rank, a, b) for rank, (a, b) in enumerate(merges)}
        names = [*(s for s in symbols if s not in made), *made]
        number = {name: k for k, name in enumerate(names)}
        self.rank = {(number[a], number[b]): rank for rank, (a, b) in enumerate(merges)}
        self.left = [self._edge(n, made, number, 1) for n in names]
        self.right = [self._edge(n, made, number, 2) for n in names]
        self.known = Table(pairs)
        byte = byte_of_symbol()
        edges: dict[int, int] = {}
        inner, last = {}, {}
        for name, k in number.items():
            ended = name.endswith(end)
            node = 0
            for c in name[: -len(end)] if ended else name:
                node = edges.setdefault(node << 8 | byte[c], len(edges) + 1)
            (last if ended else inner)[node] = k
        self.edges = Table(len(edges))
        self.edges.put(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        self.tokens = {}
        for kind, found in (("inner", inner), ("last", last)):
            self.tokens[kind] = np.full(len(edges) + 1, -1, np.int32)
            self.tokens[kind][list(found)] = list(found.values())

    @staticmethod
    def _edge(name: str, made: dict, number: dict, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of a token while it is made, each with the merge that ends it."""
        out, ends = [(number[name], NEVER)], NEVER
        while name in made:
            ends, name = made[name][0], made[name][side]
            out.append((number[name], ends))
        return out

    def compatible(self, a: int, b: int) -> bool:
        rank = self.rank
        # among equal merges the leftmost comes first: one that ends x lies before the border, one that ends y after it
        return not any(
            (r := rank.get((x, y))) is not None and r < x_ends and r <= y_ends for x, x_ends in self.right[a] for y, y_ends in self.left[b]
        )

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which tokens ``a`` are compatible with the tokens ``b`` after them."""
        keys = a.astype(np.int64) << 20 | b
        out = self.known.get(keys)
        new = out < 0
        if new.any():
            fresh, back = np.unique(keys[new], return_inverse=True)
            found = np.array([self.compatible(k >> 20, k & 0xFFFFF) for k in fresh.tolist()], np.int32)
            self.known.put(fresh, found)
            out[new] = found[back]
        return out > 0

    def matches(self, text: np.ndarray, ends: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For tokens within words: where those that end at a byte are listed, where they start and their numbers, longest first.

        ``ends``: for each byte, the end of its word.
        """
        found: dict[str, list] = {kind: [] for kind in self.tokens}
        start, node, length = np.arange(len(text)), np.zeros(len(text), np.int64), 0
        while len(start):
            node = self.edges.get(node << 8 | text[start + length]).astype(np.int64)
            alive = node >= 0
            start, node = start[alive], node[alive]
            for kind, numbers in self.tokens.items():
                token = numbers[node]
                some = token >= 0
                found[kind].append((start[some] + length, start[some], token[some]))
            length += 1
            inside = start + length < ends[start]
            start, node = start[inside], node[inside]
        out = {}
        for kind, parts in found.items():
            at, begin, token = (np.concatenate(c) for c in zip(*reversed(parts), strict=True))
            order = np.argsort(at, kind="stable")
            out[kind] = np.searchsorted(at[order], np.arange(len(text) + 1)), begin[order], token[order]
        return out

    def choose(self, where, at: np.ndarray, first: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number and the start of the one token that ends the encoding up to each byte ``at``."""
        listed, begin, number = where
        got, began = np.full(len(at), -1, np.int32), np.zeros(len(at), np.int64)
        todo, k = np.arange(len(at)), listed[at]
        while len(todo):
            b, n = begin[k], number[k]
            good = b == first[todo]
            rest = np.flatnonzero(~good)
            good[rest] = self.fit(token[b[rest] - 1], n[rest])
            got[todo[good]], began[todo[good]] = n[good], b[good]
            todo, k = todo[~good], k[~good] + 1
        return got, began

    def follow(self, where, begin: int, step: int, stop: int, token: np.ndarray, count: np.ndarray) -> None:
        """``choose`` for one word, byte by byte from ``step`` on, where there are too few words for arrays."""
        listed = where[0][begin : begin + stop + 1].tolist()
        base = listed[0]
        starts, numbers = (x[base : listed[-1]].tolist() for x in where[1:])
        last, n, fits = token[begin : begin + stop].tolist(), count[begin : begin + stop].tolist(), {}
        for at in range(step, stop):
            for k in range(listed[at] - base, listed[at + 1] - base):
                b, t = starts[k] - begin, numbers[k]
                if b:
                    pair = last[b - 1], t
                    good = fits.get(pair)
                    if good is None:
                        good = fits[pair] = self.compatible(*pair)
                if b == 0 or good:
                    last[at], n[at] = t, 1 + (n[b - 1] if b else 0)
                    break
        token[begin : begin + stop], count[begin : begin + stop] = last, n

    def counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of the words' prefixes of 1, 2, ... code points, each as a whole word; where each word's begin, and how many."""
        coded = [w.encode() for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        text = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        first = np.cumsum(size) - size
        where = self.matches(text, np.repeat(first + size, size))
        token, count = np.full(len(text), -1, np.int32), np.zeros(len(text), np.int32)
        by_size = np.argsort(-size, kind="stable")
        longer = np.searchsorted(-size[by_size], -np.arange(1, int(size.max(initial=0))), side="left")  # words of more bytes than that
        longer = np.append(longer, 0)
        few = int(np.argmax(longer <= FEW))  # from here on only the longest words are left
        for step, n in enumerate(longer[:few].tolist()):
            begin = first[by_size[:n]]
            at = begin + step
            token[at], start = self.choose(where["inner"], at, begin, token)
            count[at] = 1 + np.where(start > begin, count[start - 1], 0)
        for word in by_size[: longer[few]].tolist():
            self.follow(where["inner"], int(first[word]), few, int(size[word]) - 1, token, count)
        begin = np.repeat(first, size)
        whole = np.flatnonzero(np.append(text[1:], 0) & 0xC0 != 0x80)  # last bytes of code points
        _, start = self.choose(where["last"], whole, begin[whole], token)
        out = 1 + np.where(start > begin[whole], count[start - 1], 0).astype(np.int32)
        chars = np.fromiter(map(len, words), np.int64, len(words))
        return out, np.cumsum(chars) - chars, chars


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that normalisation may join to the one before them, but for those with a combining class."""
    chars = map(chr, range(sys.maxunicode + 1))
    canonical = (d.split() for c in chars if (d := unicodedata.decomposition(c)) and d[0] != "<")
    seconds = {chr(int(d[1], 16)) for d in canonical if len(d) == 2}
    return frozenset(seconds | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))  # vowels and finals of Hangul


def starts_anew(c: str) -> bool:
    return not unicodedata.combining(unicodedata.normalize("NFD", c)[0]) and c not in joining()


def one_by_one(text: str) -> bool:
    """Whether normalisation maps the code points of a text without white space one by one."""
    return text.isascii() or (unicodedata.is_normalized("NFC", text) and len(text.lower()) == len(text))


class PrefixCounter:
    """Counts of all prefixes of texts, with the library's own normalisation and word borders."""

    def __init__(self, params: PrefixParams):
        from tokenizers import Tokenizer

        path = params.vocabulary or default_vocabulary()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normal, self.borders = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.merges = Merges([tuple(m) for m in model["merges"]], list(model["vocab"]), model["end_of_word_suffix"], params.pairs)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.size = params.chunks
        self.units: dict[str, bytes] = {}

    def of_normal(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a normalised text, from none of its code points to all."""
        out = np.zeros(len(text) + 1, np.int32)
        borders = [border for _, border in self.borders(text)]
        if not borders:
            return out
        number: dict[str, int] = {}
        which = np.array([number.setdefault(text[a:b], len(number)) for a, b in borders])
        endings = [w for w in number if w[0] == "'" and len(w) > 1 and w[1].isalpha()]
        for w in endings:  # a short ending; cut, it is a mark and a word
            for part in ("'", w[1:-1]):
                if part:
                    number.setdefault(part, len(number))
        counts, first, size = self.merges.counts(list(number))
        for w in endings:
            at = first[number[w]]
            counts[at] = 1
            for k in range(1, len(w) - 1):
                counts[at + k] = 1 + counts[first[number[w[1:-1]]] + k - 1]
        begin = np.array([a for a, _ in borders])
        sizes, last = size[which], counts[first + size - 1][which]
        before = np.cumsum(sizes) - sizes
        step = np.arange(sizes.sum())
        out[begin + sizes] = last
        out = np.cumsum(out, dtype=np.int32)
        base = np.repeat(np.cumsum(last) - last, sizes)
        out[np.repeat(begin + 1 - before, sizes) + step] = counts[np.repeat(first[which] - before, sizes) + step] + base
        return out

    def of_plain(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text without special strings."""
        if not text:
            return np.zeros(1, np.int32)
        starts = [k for k, c in enumerate(text) if k == 0 or starts_anew(c)]
        parts = [self.normal(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        place = np.zeros(len(text) + 1, np.int64)  # the place in the normalised text up to which a prefix reaches
        place[[*starts[1:], len(text)]] = np.cumsum([len(p) for p in parts])
        return self.of_normal("".join(parts))[np.maximum.accumulate(place)]

    def learn(self, units: list[str]) -> None:
        """Adds the counts of the prefixes of units: a text without white space and the white space after it."""
        even, rest = [], []
        for unit in units:
            text = unit.rstrip(" \t\n\r")
            if "<|" in unit or not one_by_one(text) or len(text.split()) != 1:
                rest.append(unit)
            else:
                even.append(text)
        kept = set(rest)
        words = (u for u in units if u not in kept)
        size = np.fromiter(map(len, even), np.int64, len(even)) + 1
        start = np.cumsum(size) - size
        counts = self.of_normal(self.normal("".join([t + " " for t in even])))
        counts = (counts[1:] - np.repeat(counts[start], size)).tobytes()
        for unit, text, a in zip(words, even, (start * WIDTH).tolist(), strict=True):
            some, more = a + len(text) * WIDTH, len(unit) - len(text)
            self.units[unit] = counts[a:some] + counts[some : some + WIDTH] * more
        for unit in rest:
            self.units[unit] = self.of_unit(unit).tobytes()

    def of_unit(self, unit: str) -> np.ndarray:
        """Counts of the prefixes of any text, from its first code point on."""
        out, base, parts = [], 0, self.special.split(unit)
        for plain, special in zip(parts[::2], [*parts[1::2], ""], strict=True):
            counts = self.of_plain(plain + special[:-1])  # a cut special string is ordinary text
            out.append(base + counts[1:])
            if special:
                base += int(counts[len(plain)]) + 1
                out.append(np.array([base], np.int32))
        return np.concatenate(out).astype(np.int32)

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Counts of all prefixes of each text, from none of its code points to all."""
        units = [UNIT.findall(t) for t in texts]
        if len(self.units) > self.size:
            self.units.clear()
        new = {u for us in units for u in us if u not in self.units}
        if new:
            self.learn(list(new))
        out = []
        for us in units:
            inside = np.frombuffer(b"".join([self.units[u] for u in us]), np.int32)
            size = np.fromiter(map(len, us), np.int64, len(us))
            last = inside[np.cumsum(size) - 1] if us else inside
            every = np.zeros(len(inside) + 1, np.int32)
            every[1:] = inside + np.repeat(np.cumsum(last) - last, size)
            out.append(every)
        for unit in new:
            if len(unit) > 64:
                del self.units[unit]
        return out

    def in_parts(self, texts: list[str], chars: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        """``of_texts`` for so many texts at a time as have about ``chars`` code points, with the place of the first."""
        first, size = 0, 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size >= chars or k == len(texts):
                yield first, self.of_texts(texts[first:k])
                first, size = k, 0


@lru_cache(maxsize=1)
def counter(params: PrefixParams) -> PrefixCounter:
    return PrefixCounter(params)


def prefix_counts(docs: DataFrame, params: PrefixParams | None = None) -> DataFrame:
    """(doc_id, n_bytes, counts): the bytes of each text and the token counts of all its prefixes."""
    p = params or PrefixParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(p)
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for first, counts in prefixes.in_parts(texts, p.chars_at_once):
                ids = batch.column("doc_id").slice(first, len(counts))
                n_bytes = [len(t.encode()) for t in texts[first : first + len(counts)]]
                out = pa.array([c.astype(">i4").tobytes() for c in counts], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), out], names=["doc_id", "n_bytes", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, counts binary")


def _number(four: Column) -> Column:
    return F.conv(F.hex(four), 16, 10).cast("long")


def token_count() -> Column:
    """Tokens of the whole text."""
    return _number(F.substring("counts", -WIDTH, WIDTH))


def count_at(chars: Column) -> Column:
    """Tokens of the first ``chars`` code points; of the whole text where it is shorter."""
    place = F.least(chars.cast("long") * WIDTH + 1, F.octet_length("counts") - (WIDTH - 1))
    return _number(F.substring(F.col("counts"), place.cast("int"), F.lit(WIDTH)))


def longest_prefix(budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens; a null or negative budget holds none."""

    @F.pandas_udf("long")
    def fit(counts: pd.Series, most: pd.Series) -> pd.Series:
        found = [np.flatnonzero(np.frombuffer(c, ">i4") <= m) for c, m in zip(counts, most.fillna(-1), strict=True)]
        return pd.Series([int(f[-1]) if len(f) else 0 for f in found], dtype="int64")

    return fit("counts", budget.cast("long"))


def truncate(docs: DataFrame, budget: int, params: PrefixParams | None = None) -> DataFrame:
    """(doc_id, text, n_tokens, cut): each text up to its longest prefix within the budget, without encoding it again."""
    p = params or PrefixParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(p)
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for first, counts in prefixes.in_parts(texts, p.chars_at_once):
                part = texts[first : first + len(counts)]
                to = [int(np.flatnonzero(c <= max(budget, 0))[-1]) for c in counts]
                columns = [
                    batch.column("doc_id").slice(first, len(counts)),
                    pa.array([t[:k] for t, k in zip(part, to, strict=True)], pa.string()),
                    pa.array([int(c[k]) for c, k in zip(counts, to, strict=True)], pa.int64()),
                    pa.array([k < len(t) for t, k in zip(part, to, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_tokens", "cut"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, n_tokens long, cut boolean")


def token_report(docs: DataFrame, limit: int, params: PrefixParams | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): read from the counts of the prefixes."""
    n = token_count()
    return prefix_counts(docs, params).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
