"""Brown class-based bigram model: exchange clustering, smoothed class transitions and word emissions.

A text is its words (ASCII white space, A-Z in lower case) and one end token. Every training word has a class, and the
probability of a word w after a word v is

    P(class(w) | class(v)) * P(w | class(w))

Transitions are interpolated with the class frequencies (Witten-Bell). Emissions are add-one smoothed, and each class keeps
one share for a word that training has not seen, so the probabilities of all words and of one unknown word a class sum to one.

Clustering has three steps, each by the neighbours that the words have in all training texts:

1. *Core*: the ``own_units`` most frequent words are exchanged one after the other, until the likelihood stands. All other
   words take part in ``shared_units`` units by their last letters, which only gives them a class to start from.
2. *Frequent words* beyond the core each move to the class that raises the likelihood most, given the classes of step 1.
3. *Rare words*, all others, pick classes in sweeps until the likelihood of their neighbours stands; in a sweep all pick at once,
   given the neighbours that the words of each class had after the last one. Their neighbours are grouped by word in Spark
   once; words, groups and work grow with the corpus. A rare neighbour of a rare word counts as "rare"; bigrams of two rare
   words are shared out over the classes by the classes that rare words before and after rare words have.

Unknown words take the class of the unit of their last letters. Texts are written as word numbers once; sweeps read those.

What tasks and driver hold is bounded by parameters: the frequent words with counts and classes, and (units x classes) count
matrices. Counts and classes of rare words stay distributed and are joined to the rare words of the texts. Words of more than
64 bytes are known by their first bytes and their SHA-256, so no key is long.

Nulls: a null text is empty and scores its end token alone; a null doc_id is an id like any other. Repeated rows are scored
each by itself. Without training rows every count is zero; an empty table gives no rows. Equal counts are ordered by word, equal
gains go to the smaller class. Further columns are not read. Very long texts are one row of word numbers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower_words, batch_of, small, stored, text_or_empty

END = b""
LONG_WORD = 64
BLOCK = 64
COUNT_SCHEMA = pa.schema([("word", pa.binary()), ("n", pa.int64())])


@dataclass(frozen=True)
class BrownParams:
    """``frequent``: words whose counts every task holds; ``own_units``: words of the core; ``shared_units``: units that the other
    words start from; ``rounds``: at most so many sweeps of the core and of the rare words, fewer once a sweep gains less than
    ``stand`` of what all have gained."""

    frequent: int = 524_288
    own_units: int = 6_144
    shared_units: int = 1_024
    classes: int = 64
    rounds: int = 8
    stand: float = 0.02

    @property
    def units(self) -> int:
        return self.own_units + self.shared_units + 1


@dataclass
class Vocabulary:
    """Bounded part of the vocabulary. Indexes: frequent words (``words``, in this order), then shared units, then the end token."""

    params: BrownParams
    words: pa.Array
    counts: np.ndarray
    unit: np.ndarray
    train_tokens: int
    train_words: int

    @property
    def index(self) -> dict[bytes, int]:
        return {word: k for k, word in enumerate(self.words.to_pylist())}

    @property
    def first(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + self.params.shared_units

    def known_classes(self, classes: np.ndarray) -> np.ndarray:
        """Classes by index, with one more class, the last, for rare words."""
        out = classes.copy()
        out[self.first : self.end] = self.params.classes
        return out


@dataclass
class BrownModel:
    vocabulary: Vocabulary
    classes: np.ndarray
    transitions: np.ndarray
    shares: np.ndarray
    history: list[float] = field(default_factory=list)


def word_key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else word[: LONG_WORD - 31] + hashlib.sha256(word).digest()


def word_keys(text: str) -> list[bytes]:
    """The words of one text; ``coded_words`` gives those of many."""
    return [word_key(w) for w in ascii_lower_words(text)]


def starting_units(keys: pa.Array, shared: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w[-3:]) % shared for w in keys.to_pylist()), np.int32, len(keys))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every word of the texts in order, and the word of every code."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    codes, keys = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.binary())
    size = pc.binary_length(keys).to_numpy(zero_copy_only=False)
    if (size > LONG_WORD).any():
        long = pa.array(size > LONG_WORD)
        keys = pc.replace_with_mask(keys, long, pa.array([word_key(w) for w in keys.filter(long).to_pylist()], pa.binary()))
    word = size[codes] > 0  # white space at the ends splits off an empty word
    return row[word], codes[word], keys


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end token as the empty word; summed in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in small(batches, 2_000):
            _, codes, keys = coded_words(batch.column("text"))
            n = np.bincount(codes, minlength=len(keys))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(seen)), pa.array(n[seen], pa.int64())], schema=COUNT_SCHEMA)
            ends += batch.num_rows
        if ends:
            yield batch_of(COUNT_SCHEMA, [[END], [ends]])

    return train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _threshold(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words reach."""
    bucket = F.floor(F.log2("n") * 32)
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    held, least = 0, None
    for row in sizes:
        held += row.words
        if held > most:
            break
        least = row.least
    return least if least is not None else sizes[0].least + 1 if sizes else 1


def build_vocabulary(counts: DataFrame, params: BrownParams) -> Vocabulary:
    """The frequent words with their counts, and the unit of every index."""
    words = counts.where(F.col("word") != F.lit(END))
    least = _threshold(words, params.frequent)
    rows = words.where(F.col("n") >= least).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    end_count = counts.where(F.col("word") == F.lit(END)).agg(F.sum("n").alias("n")).first().n or 0
    own = min(params.own_units, len(rows))
    unit = np.empty(len(rows) + params.shared_units + 1, np.int32)
    held = rows["word"].combine_chunks().cast(pa.binary())
    unit[: len(rows)] = params.own_units + starting_units(held, params.shared_units)
    unit[:own] = np.arange(own)
    unit[len(rows) : -1] = params.own_units + np.arange(params.shared_units)
    unit[-1] = params.units - 1
    n = np.concatenate([rows["n"].to_numpy(), np.zeros(params.shared_units, np.int64), [end_count]])
    return Vocabulary(params, held, n, unit, totals.n or 0, totals.v or 0)


def _numbers(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows of int32 as binary values; ``starts`` has the first place of each row and the end."""
    buffers = [None, pa.py_buffer((4 * starts).astype(np.int32)), pa.py_buffer(values.astype(np.int32))]
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, buffers)


def _starts(row: np.ndarray, rows: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])


ENCODED_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("rare", pa.list_(pa.binary())), ("units", pa.binary())]
)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Texts as numbers, with a row number: ``ids`` int32 by index or rare word, ``rare`` the rare words and ``units`` theirs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = sent.value
        for batch in small(batches, 2_000):
            row, codes, keys = coded_words(batch.column("text"))
            index = pc.fill_null(pc.index_in(keys, value_set=vocab.words), -1).to_numpy(zero_copy_only=False)
            units = np.zeros(len(keys), np.int32)
            units[index < 0] = starting_units(keys.filter(pa.array(index < 0)), vocab.params.shared_units)
            ids = index[codes].astype(np.int32)
            rare = ids < 0
            pairs, place = np.unique(row[rare] * max(len(keys), 1) + codes[rare], return_inverse=True)
            of_row, of_code = np.divmod(pairs, max(len(keys), 1))
            firsts = _starts(of_row, batch.num_rows)
            ids[rare] = -1 - (place - firsts[row[rare]])
            words = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), keys.take(pa.array(of_code)))
            columns = [_numbers(ids, _starts(row, batch.num_rows)), words, _numbers(units[of_code], firsts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], schema=ENCODED_SCHEMA)

    kind = "doc_id long, held_out boolean, ids binary, rare array<binary>, units binary"
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(run, kind)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()))


def token_stream(batch: pa.RecordBatch, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch one after the other with an end token around each: the index of every token, and for rare words
    the place in the flat list of rare words of the batch, else -1."""
    parts, base, end = [np.array([vocabulary.end], np.int32)], 0, np.array([vocabulary.end], np.int32)
    for ids, units in zip(batch.column("ids").to_pylist(), batch.column("units").to_pylist(), strict=True):
        ids = np.frombuffer(ids, np.int32)
        parts += [np.where(ids < 0, ids - base, ids), end]
        base += len(units) // 4
    index = np.concatenate(parts).astype(np.int64)
    place = np.where(index < 0, -1 - index, -1)
    units = np.frombuffer(b"".join(batch.column("units").to_pylist()), np.int32)
    index[place >= 0] = vocabulary.first + units[place[place >= 0]]
    return index, place


def class_neighbours(train: DataFrame, vocabulary: Vocabulary, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units x classes) counts of the class before and after each unit, over all encoded training texts.

    Tasks sum whole matrices; blocks of rows are summed again by block, streaming, so memory stays at
    one matrix however many tasks there were.
    """
    n_classes, n_units = vocabulary.params.classes, vocabulary.params.units
    sent = train.sparkSession.sparkContext.broadcast((vocabulary, classes))
    schema = pa.schema([("block", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])

    def rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for block, both in sums.items():
            yield batch_of(schema, [[block], [both[0].tobytes()], [both[1].tobytes()]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, of_unit = sent.value
        before, after = (np.zeros(n_units * n_classes, np.int64) for _ in range(2))
        for batch in small(batches, 2_000):
            units = vocab.unit[token_stream(batch, vocab)[0]].astype(np.int64)
            left, right = units[:-1], units[1:]
            np.add(before, np.bincount(right * n_classes + of_unit[left], minlength=before.size), out=before)
            np.add(after, np.bincount(left * n_classes + of_unit[right], minlength=after.size), out=after)
        both = np.stack([before, after]).reshape(2, n_units, n_classes)
        yield from rows({b: x for b in range(0, n_units, BLOCK) if (x := both[:, b : b + BLOCK]).any()})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, *pair in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                got = np.stack([np.frombuffer(x, np.int64).reshape(-1, n_classes) for x in pair])
                sums[block] = sums[block] + got if block in sums else got
        yield from rows(sums)

    out = np.zeros((2, n_units, n_classes), np.int64)
    kind = "block int, before binary, after binary"
    summed = train.select("ids", "units").mapInArrow(count, kind).repartition("block").mapInArrow(total, kind)
    for r in summed.collect():
        for k, part in enumerate((r.before, r.after)):
            got = np.frombuffer(bytes(part), np.int64).reshape(-1, n_classes)
            out[k, r.block : r.block + len(got)] += got
    sent.destroy()
    return out[0], out[1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """One sweep of exchange clustering over the units, most frequent first.

    Each unit moves to the class that raises the class-bigram likelihood most, given the neighbour
    classes that the counts were taken with; moves show in the class matrix at once.
    """
    classes, n_classes = classes.copy(), before.shape[1]
    grid = np.zeros((n_classes, n_classes))  # grid[previous class, class]
    np.add.at(grid.T, classes, before.astype(float))
    total = before.sum(1).astype(float)
    size = np.bincount(classes, total, n_classes)
    for u in np.argsort(-total, kind="stable"):
        if total[u] == 0:
            break
        old, left, right = classes[u], before[u].astype(float), after[u].astype(float)
        grid[:, old] -= left
        grid[old, :] -= right
        np.maximum(grid, 0, out=grid)
        size[old] -= total[u]
        gain = (_xlogx(grid + left[:, None]) - _xlogx(grid)).sum(0) + (_xlogx(grid + right[None, :]) - _xlogx(grid)).sum(1)
        gain -= 2 * (_xlogx(size + total[u]) - _xlogx(size))
        new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
        classes[u] = new
        grid[:, new] += left
        grid[new, :] += right
        size[new] += total[u]
    return classes


def class_pairs(train: DataFrame, vocabulary: Vocabulary, classes: np.ndarray) -> np.ndarray:
    """Counts of (class before, class) over all bigrams of the encoded texts; ``classes`` by index, the last for rare words."""
    side = vocabulary.params.classes + 1
    sent = train.sparkSession.sparkContext.broadcast((vocabulary, classes))
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, of_index = sent.value
        pairs = np.zeros(side * side, np.int64)
        for batch in small(batches, 2_000):
            c = of_index[token_stream(batch, vocab)[0]]
            pairs += np.bincount(c[:-1] * side + c[1:], minlength=side * side)
        found = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(pairs[found])], schema=schema)

    out = np.zeros(side * side, np.int64)
    for r in train.select("ids", "units").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(side, side)


def word_contexts(train: DataFrame, vocabulary: Vocabulary, classes: np.ndarray, rare: bool) -> DataFrame:
    """(word, context) of every rare word, or every frequent word beyond the core: how often each class stands before it
    (slot = class) and after it (slot = classes + 1 + class). A word has at most 2 (classes + 1) slots."""
    side = vocabulary.params.classes + 1
    sent = train.sparkSession.sparkContext.broadcast((vocabulary, classes))
    schema = pa.schema([("word", pa.binary()), ("slot", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, of_index = sent.value
        frequent = None if rare else vocab.words
        for batch in small(batches, 2_000):
            index, place = token_stream(batch, vocab)
            if rare:
                words = batch.column("rare").flatten().dictionary_encode()
                codes = np.append(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), -1)
                key, words = codes[place], words.dictionary
            else:
                key, words = np.where((index >= vocab.params.own_units) & (index < vocab.first), index, -1), frequent
            of_class = of_index[index]
            has = key[1:-1] >= 0  # the first and the last token are ends
            wide = key[1:-1][has] * (2 * side)
            keys, n = np.unique(np.concatenate([wide + of_class[:-2][has], wide + side + of_class[2:][has]]), return_counts=True)
            columns = [words.take(pa.array(keys // (2 * side))), pa.array(keys % (2 * side), pa.int32()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    slots = train.select("ids", "units", "rare").mapInArrow(count, "word binary, slot int, n long")
    return slots.groupBy("word", "slot").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("context"))


def known_slots(pairs: np.ndarray) -> np.ndarray:
    """[slot, class]: the contexts of all words that are not rare, summed by class."""
    return np.concatenate([pairs[:, :-1], pairs[:-1].T]).astype(float)


def context_gains(slots: np.ndarray) -> np.ndarray:
    """[slot, class]: what a neighbour in a slot adds to the log likelihood if the word is in the class."""
    out, side = np.empty(slots.shape), len(slots) // 2
    for part in (slice(0, side), slice(side, 2 * side)):
        out[part] = np.log((slots[part] + 0.5) / (slots[part].sum(0) + 0.5 * side))
    return out


def _dense(lists: pa.ListArray, slots: int) -> np.ndarray:
    """The contexts of a batch as rows of ``slots`` counts."""
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    slot, n = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
    out = np.zeros((len(lists), slots))
    out[row, slot] = n
    return out


def _likeliest(seen: np.ndarray, gains: np.ndarray) -> np.ndarray:
    return np.argmax(np.round(seen @ gains, 6), 1)


def pick_classes(contexts: DataFrame, gains: np.ndarray) -> DataFrame:
    """(word, n, class): the count of each word and the class that its neighbours make likeliest."""
    side = len(gains) // 2
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = _dense(batch.column("context"), 2 * side)
            n, best = seen[:, :side].sum(1).astype(np.int64), _likeliest(seen, gains)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(n), pa.array(best, pa.int32())], schema=schema)

    return contexts.mapInArrow(run, "word binary, n long, class int")


def class_slots(contexts: DataFrame, vocabulary: Vocabulary, classes: np.ndarray, gains: np.ndarray | None) -> np.ndarray:
    """[slot, class]: contexts summed by the class that ``gains`` give each word, or that it starts from. A task gives one row
    for each slot and class at most."""
    c, shared = vocabulary.params.classes, vocabulary.params.shared_units
    starts, schema = classes[vocabulary.first : vocabulary.end], pa.schema([("key", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 * (c + 1), c))
        for batch in batches:
            seen = _dense(batch.column("context"), len(sums))
            if gains is None:
                best = starts[[zlib.crc32(w[-3:]) % shared for w in batch.column("word").to_pylist()]]
            else:
                best = _likeliest(seen, gains)
            for k in np.unique(best):
                sums[:, k] += seen[best == k].sum(0)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(sums.ravel()[found].astype(np.int64))], schema=schema)

    out = np.zeros(2 * (c + 1) * c)
    for r in contexts.mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r.key] = r.n
    return out.reshape(-1, c)


def cluster_rare(contexts: DataFrame, vocabulary: Vocabulary, classes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gains by which rare words pick their classes once the likelihood of their neighbours stands, and the contexts
    summed by those classes. Every sweep lets all words pick at once."""
    known, p = known_slots(pairs), vocabulary.params
    sums, gains, history = class_slots(contexts, vocabulary, classes, None), None, []
    while True:
        by_class = context_gains(known + sums)
        history.append(float((sums * by_class).sum()))
        if len(history) > p.rounds or (len(history) > 1 and history[-1] - history[-2] <= p.stand * (history[-1] - history[0])):
            return gains, sums
        gains = by_class
        sums = class_slots(contexts, vocabulary, classes, gains)


def _bigram_likelihood(pairs: np.ndarray) -> float:
    pairs = pairs.astype(float)
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def cluster_core(train: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, list[float]]:
    """Classes of the units after sweeps until the likelihood stands, and the likelihood before each sweep and after all."""
    p = vocabulary.params
    classes, history = np.arange(p.units) % p.classes, []
    while True:
        before, after = class_neighbours(train, vocabulary, classes)
        pairs = np.zeros((p.classes, p.classes))
        np.add.at(pairs.T, classes, before.astype(float))
        history.append(_bigram_likelihood(pairs))
        if history[-1] == max(history):
            best = classes
        # a sweep sees the neighbours' classes of the last one, so an early one may lose; those that follow make it up
        stands = len(history) > 1 and 0 <= history[-1] - history[-2] <= p.stand * (history[-1] - history[0])
        if len(history) > p.rounds or stands:
            return best, history
        classes = exchange(before, after, classes)


def train_model(train: DataFrame, vocabulary: Vocabulary) -> tuple[BrownModel, DataFrame]:
    """The model, and (word, n, class) of all rare words, stored. ``train`` is encoded."""
    p, c = vocabulary.params, vocabulary.params.classes
    of_unit, history = cluster_core(train, vocabulary)
    classes = of_unit[vocabulary.unit]
    known = vocabulary.known_classes(classes)
    gains = context_gains(known_slots(class_pairs(train, vocabulary, known)))
    picked = pick_classes(word_contexts(train, vocabulary, known, rare=False), gains).toArrow()
    at = pc.index_in(picked["word"].combine_chunks().cast(pa.binary()), value_set=vocabulary.words)
    classes[at.to_numpy(zero_copy_only=False)] = picked["class"].to_numpy()
    known = vocabulary.known_classes(classes)
    pairs = class_pairs(train, vocabulary, known).astype(float)
    contexts = stored(word_contexts(train, vocabulary, known, rare=True))
    gains, slots = cluster_rare(contexts, vocabulary, classes, pairs)
    rare = stored(pick_classes(contexts, gains))
    before, after = slots[: c + 1], slots[c + 1 :].T
    both = np.outer(after[:, c], before[c]) / max(pairs[c, c], 1.0)  # bigrams of two rare words
    pairs = pairs[:c, :c] + before[:c] + after[:, :c] + both
    fixed = np.flatnonzero(vocabulary.counts)
    tokens = np.bincount(classes[fixed], vocabulary.counts[fixed], c)
    types = np.bincount(classes[fixed], minlength=c).astype(float)
    for r in rare.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["class"]] += r.n
        types[r["class"]] += r.v
    share = (tokens + 1) / (tokens.sum() + c)
    seen, kinds = pairs.sum(1, keepdims=True), np.maximum((pairs > 0).sum(1, keepdims=True), 1)
    transitions = np.log10((pairs + kinds * share) / (seen + kinds))
    return BrownModel(vocabulary, classes, transitions, np.log10(tokens + types + 1), history), rare


SCORE_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
     ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())]
)


def score_texts(encoded: DataFrame, model: BrownModel, rare: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of each encoded text.

    Only words that are not frequent are shuffled, once per text, to meet their counts and classes.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    asked = encoded.select("row", F.posexplode("rare").alias("k", "word"))
    found = asked.join(rare.select("word", "n", "class"), "word").groupBy("row").agg(F.collect_list(F.struct("k", "n", "class")).alias("found"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: BrownModel = sent.value
        vocab = m.vocabulary
        unknown = np.log10(vocab.train_tokens + vocab.train_words + 1.0)
        log_count = np.log10(vocab.counts + 1.0)
        for batch in small(batches):
            lists = batch.column("found")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            k, n, of_rare = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            out, at = [[] for _ in range(5)], 0
            for ids, units, size in zip(batch.column("ids").to_pylist(), batch.column("units").to_pylist(), sizes, strict=True):
                ids, units = np.frombuffer(ids, np.int32), np.frombuffer(units, np.int32)
                words, here = np.zeros(len(units)), slice(at, at + size)
                of_word = m.classes[vocab.first + units]
                words[k[here]], of_word[k[here]] = np.log10(n[here] + 1.0), of_rare[here]
                at += size
                of_class, counted = np.full(len(ids) + 2, m.classes[vocab.end]), np.full(len(ids) + 1, log_count[vocab.end])
                is_rare, places = ids < 0, -1 - ids[ids < 0]
                of_class[1:-1][~is_rare], counted[:-1][~is_rare] = m.classes[ids[~is_rare]], log_count[ids[~is_rare]]
                of_class[1:-1][is_rare], counted[:-1][is_rare] = of_word[places], words[places]
                value = float(counted.sum() + m.transitions[of_class[:-1], of_class[1:]].sum() - m.shares[of_class[1:]].sum())
                known = int((counted > 0).sum())
                row = (len(counted), known, float(counted.sum() - len(counted) * unknown), value, 10.0 ** min(300.0, -value / len(counted)))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            tokens, known, base, value, perplexity = out
            train_tokens = [vocab.train_tokens] * len(tokens)
            columns = [pa.array(x, f.type) for x, f in zip((tokens, known, train_tokens, base, value, perplexity), list(SCORE_SCHEMA)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], schema=SCORE_SCHEMA)

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    rows = encoded.select("row", "doc_id", "held_out", "ids", "units").join(found, "row", "left")
    return rows.select("doc_id", "held_out", "ids", "units", "found").mapInArrow(score, kind)


def score_documents(docs: DataFrame, params: BrownParams | None = None, held_out=None) -> DataFrame:
    """Trains on the rows that are not ``held_out`` (a column; by default none is) and scores all rows."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"),
        text_or_empty().alias("text"),
    )
    vocabulary = build_vocabulary(stored(word_counts(rows.where(~F.col("held_out")))), params or BrownParams())
    encoded = encode(rows, vocabulary)
    model, rare = train_model(encoded.where(~F.col("held_out")), vocabulary)
    return score_texts(encoded, model, rare)
