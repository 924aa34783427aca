"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find emails, addresses of machines, card and phone numbers. The field labels words from their shapes and
those of their neighbours, so it also finds what the patterns miss: spelled-out emails, phone numbers without a country
code. Labels tell the first word of an item from the others, so items that follow each other stay apart. Its spans are added
where no pattern matched; pattern spans stay. A run of words that is no item as a whole is cut at words into parts that are.

The field is trained by gradient ascent on a small labelled table, made from the sentences below. Decoding is exact
Viterbi in numpy. A word whose score for "other" beats every other label by more than any transitions could win back is
"other" on the best path, so only the stretches between such words are decoded, side by side, whatever the length of the
text.

Nulls: a null text is empty and has no spans. Repeated rows each have their row in the result, an empty table none. Among
labellings of equal score the first label in LABELS wins. Texts of any length are taken whole, in parts of some texts at a
time; other columns are not read, or stay where texts are redacted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch_of, small, text_or_empty

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
LABELS = (OTHER, *(f"{place}-{kind}" for kind in KINDS for place in "BI"))  # the first word of an item, and the others

# Possessive quantifiers: no run is scanned twice. A number is matched from its first digit on.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, str]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of a local part, @ and a dotted domain; found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done, "email"
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all pattern matches, by start, then in the order of KINDS."""
    out: list[Span] = list(emails(text)) if "@" in text else []
    if DIGITS.search(text):
        for m in DIGITS.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Labelled sentences: {kind:words}; "#" is a digit drawn anew for each use.
SENTENCES = (
    "please write to {email:anna.k@mail#.example.com} about it",
    "mail {email:j_doe##@example.org} or call {phone:+1 (###) 555-####} today",
    "contact {email:bob dot smith at example dot com} for more",
    "reach me under {email:mary at mail dot example dot net} please",
    "send it to {email:info [at] example [dot] org} now",
    "and the {email:xyz.##@mail#.example.com} of that",
    "in {email:abcdef.##@example.net}. The",
    "over {email:k.##@host#.example.org}, which {email:mno@site.example.com}",
    "than {ip:2#.###.#.1##} with. and {card:4###############} of {phone:+1 (###) 555-####} on",
    "her address is {email:lee (at) mail (dot) example (dot) com} they said",
    "the meeting at noon was dull and the dot on the map was red",
    "we met at the house at ten and left at two",
    "server {ip:##.###.##.###} answered and {ip:1##.##.1##.2#} did not",
    "the host {ip:10.#.#.##} is down",
    "from {ip:##.##.##.##} and then nothing",
    "version #.#.# was replaced by #.## in 20##",
    "chapter #.# and section #.#.# of the book",
    "card {card:4###############} was charged",
    "pay with {card:5### #### #### ####} or {card:4###-####-####-####} here",
    "his number {card:4###############} is on file",
    "order ####### of 20##-##-## was sent",
    "the code ###### and the key ######## are not secret",
    "phone {phone:+1 (###) 555-####} and ask",
    "call {phone:+44 20 #### ####} or {phone:+49 30 #######} soon",
    "call {phone:(###) 555-####} before five",
    "tel {phone:555-###-####} is open",
    "fax {phone:###-555-####} or mobile {phone:###.555.####} work too",
    "phone {phone:(###) ###-####} is hers",
    "call {phone:555-###-####} {phone:555-###-####} today",
    "call {phone:###-555-####}, {phone:###-555-####}, {phone:555-###-####} any time",
    "numbers {phone:(###) 555-####} {phone:(###) 555-####} both work",
    "at {phone:+1 (###) 555-####} {phone:###-555-####} we are open",
    "tel {phone:###.555.####} {phone:###.555.####} {phone:###-###-####} for all",
    "cards {card:4###############} {card:5###############} on file",
    "cards {card:4### #### #### ####} {card:5### #### #### ####} were used",
    "from {email:tom at example dot org} {email:eve at mail dot example dot com} in copy",
    "ask {email:bob dot smith at example dot com} or {email:mary at example dot net} first",
    "in 20## there were ### people and #,### dogs",
    "it cost $##.## in 19## and ##% more later",
    "the score was #-# and the vote ###-##",
    "pages ##-## and ###-### were lost",
    "from 19##-20## the rate was #.##",
    "token = a##b##c##d##e##f## is random",
    "password=##f###a##b###c was leaked",
    "key AKIA##XX##YY##ZZ was revoked",
    "on ##/##/20## at ##:## it rained",
    "isbn 978-#-##-######-# is a book",
    "the, of and; in: to! that? was. (it) [is] \"so\"",
    "words*** and$$$ others%%% with&&& signs### around",
    "| one | two | three | 4 | 5 |",
    "# first * second * third",
    "this is plain text without any of it, and it goes on, with commas.",
    "Another Line That Starts With Capitals. And One More.",
    "le texte est en français, éèà, et il n'y a rien",
    "der Text ist auf Deutsch, für die Übung, und größer",
    "el texto está en español, mañana y niño",
    "a b c d e f g h",
    "SHOUTING!! WORDS!! ALL!! OVER!!",
    "it's don't they're l'eau well-known up-to-date",
)
COPIES = 5
SLOT = re.compile(r"\{(\w+):([^}]*)\}|(\S+)")


def labelled_rows() -> list[tuple[int, int, str, str]]:
    """(sentence, position, word, label) of the labelled table; digits are drawn from a fixed seed."""
    rng, rows, n = np.random.default_rng(11), [], 0
    for _ in range(COPIES):
        for sentence in SENTENCES:
            filled = re.sub("#", lambda _: str(rng.integers(0, 10)), sentence) if not sentence.startswith("#") else sentence
            k = 0
            for m in SLOT.finditer(filled):
                for j, word in enumerate((m[2] or m[3]).split()):
                    rows.append((n, k, word, f"{'I' if j else 'B'}-{m[1]}" if m[1] else OTHER))
                    k += 1
            n += 1
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "sentence int, position int, word string, label string")


SHAPES = bytes(
    57 if 48 <= c <= 57 else 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else c for c in range(256)
)  # 9 for a digit, A for a capital, a for other letters; all else stays


def shape_features(shape: bytes) -> list[str]:
    s = shape.decode("ascii")
    core = s.strip(".,;:!?\"'")
    short = re.sub(r"A+", "A", re.sub(r"a+", "a", core))
    return [
        "bias",
        "core " + short[:24],
        "kind " + re.sub(r"9+", "9", short)[:16],
        f"digits {min(core.count('9'), 20)}",
        f"marks {''.join(sorted(set(core) - set('Aa9')))[:8]}",
        f"dots {min(core.count('.'), 4)}",
        f"email {bool(re.fullmatch(r'[Aa9._%+-]+@[Aa9-]+([.][Aa9-]+)+', core))}",
    ]


@dataclass
class Field:
    """Weights for features of the word itself (0), the word before (1) and the word after (2), and for labels in turn."""

    names: dict[str, int]
    words: dict[bytes, int]
    weights: np.ndarray  # place, feature, label
    moves: np.ndarray  # label, next label

    def vector(self, features: list[str]) -> np.ndarray:
        rows = [self.names[f] for f in features if f in self.names]
        return self.weights[:, rows].sum(1)


def _indexes(words: list[str], names: dict[str, int], grow: bool, known: set[str]) -> list[list[int]]:
    out = []
    for w in words:
        raw = w.encode("utf-8", "surrogatepass")
        features = shape_features(raw.translate(SHAPES))
        plain = w.lower().strip(".,;:!?\"'")
        if plain in known:
            features.append("word " + plain)
        out.append([names.setdefault(f, len(names)) if grow else names[f] for f in features if grow or f in names])
    return out


#: Words whose identity is a feature, besides their shape.
KNOWN = ("at", "dot", "[at]", "[dot]", "(at)", "(dot)", "call", "tel", "phone", "fax", "mobile", "mail", "email", "card", "server", "host",
         "version", "isbn", "order", "code", "key", "token", "pages")


def train_field(rows: list[tuple[int, int, str, str]], rounds: int = 100, rate: float = 0.3, penalty: float = 2e-3) -> Field:
    """Maximum likelihood with a quadratic penalty: forward-backward over all sentences at once, AdaGrad steps."""
    sentences: dict[int, list[tuple[str, str]]] = {}
    for n, _, word, label in sorted(rows):
        sentences.setdefault(n, []).append((word, label))
    names: dict[str, int] = {}
    groups = list(sentences.values())
    features = [_indexes([w for w, _ in g], names, True, set(KNOWN)) for g in groups]
    n, longest, k = len(groups), max(map(len, groups)), len(LABELS)
    x = np.zeros((n, longest + 2, len(names)), np.float32)
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (g, f) in enumerate(zip(groups, features, strict=True)):
        for t, ((_, label), own) in enumerate(zip(g, f, strict=True)):
            x[i, t + 1, own] = 1
            gold[i, t], mask[i, t] = LABELS.index(label), True
    places = (x[:, 1:-1], x[:, :-2], x[:, 2:])  # itself, before, after
    weights, moves = np.zeros((3, len(names), k)), np.zeros((k, k))
    sum_w, sum_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    hot = np.eye(k)[gold] * mask[..., None]
    pairs = np.einsum("itk,itl->kl", hot[:, :-1], hot[:, 1:])
    for _ in range(rounds):
        e = sum(p @ weights[j] for j, p in enumerate(places))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + moves[0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, beta[:, t + 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        both = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        both *= mask[:, 1:, None, None]
        grad_m = pairs - both.sum((0, 1)) - penalty * n * moves
        diff = hot - p
        grad_w = np.stack([np.einsum("itf,itk->fk", q, diff) for q in places]) - penalty * n * weights / 3
        sum_w += grad_w**2
        sum_m += grad_m**2
        weights += rate * grad_w / np.sqrt(sum_w)
        moves += rate * grad_m / np.sqrt(sum_m)
    words = {w.encode(): names["word " + w] for w in KNOWN if "word " + w in names}
    return Field(names, words, weights, moves)


class _Shapes(dict):
    """Shape to row of the score table; a new shape is scored when it is first met."""

    def __init__(self, f: Field):
        super().__init__()
        self.field, self.rows = f, [np.zeros((3, len(LABELS)), np.float32)]

    def __missing__(self, shape: bytes) -> int:
        self[shape] = len(self.rows)
        self.rows.append(self.field.vector(shape_features(shape)).astype(np.float32))
        return self[shape]


class Decoder:
    """Labels streams of words. Scores of shapes are computed once for each shape."""

    HELD, BLOCK = 200_000, 500_000

    def __init__(self, f: Field):
        self.field, k = f, len(LABELS)
        marks = (b"", *(bytes([c]) for c in b".,;:!?\"'"))
        self.words = {w + m: n + 1 for n, w in enumerate(f.words) for m in marks}
        known = [f.weights[:, j] for j in f.words.values()]
        self.word_scores = np.concatenate([np.zeros((1, 3, k)), *(x[None] for x in known)]).astype(np.float32)
        m = f.moves
        win = m[:, :, None] + m[None, :, :] - m[:, :1, None] - m[None, :1, :]
        self.most = float(win.max())  # what transitions can win for a label over "other"
        self.shapes = _Shapes(f)

    def labels(self, texts: list[bytes]) -> list[np.ndarray]:
        """The label of each word of each text. Words are scored in blocks; only unsure words keep their scores."""
        if len(self.shapes) > self.HELD:
            self.shapes = _Shapes(self.field)
        shape, word = self.shapes.__getitem__, self.words.get
        between = np.zeros(1, np.int32)
        s, w, ends = [between], [between], [0]
        for raw in texts:
            own = np.fromiter(map(shape, raw.translate(SHAPES).split()), np.int32)
            s += [own, between]
            w += [np.fromiter(map(word, raw.lower().split(), repeat(0)), np.int32), between]
            ends.append(ends[-1] + len(own) + 1)
        s, w, table = np.concatenate(s), np.concatenate(w), np.stack(self.shapes.rows)
        edges = np.zeros(len(s), bool)
        edges[ends] = True
        unsure, scores = [], []
        for a in range(0, len(s), self.BLOCK):
            b = min(a + self.BLOCK, len(s))
            score = table[s[a:b], 0] + self.word_scores[w[a:b], 0]
            low, high = max(a - 1, 0), min(b + 1, len(s))
            score[low + 1 - a :] += table[s[low : b - 1], 1] + self.word_scores[w[low : b - 1], 1]
            score[: high - 1 - a] += table[s[a + 1 : high], 2] + self.word_scores[w[a + 1 : high], 2]
            open_ = np.flatnonzero((score[:, 0] - score[:, 1:].max(1) <= self.most) & ~edges[a:b])
            unsure.append(open_ + a)
            scores.append(score[open_].astype(np.float64))
        best = np.zeros(len(s), np.int8)
        self._stretches(np.concatenate(scores), np.concatenate(unsure), best)
        return [best[a + 1 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _stretches(self, score: np.ndarray, open_: np.ndarray, best: np.ndarray) -> None:
        """Viterbi on all stretches of unsure words at once, each between two words that are "other"."""
        if not len(open_):
            return
        starts = np.flatnonzero(np.diff(open_, prepend=-5) > 1)
        lengths = np.diff(np.append(starts, len(open_)))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        moves, longest = self.field.moves, int(lengths[0])
        live = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")  # stretches at least as long
        value = score[starts] + moves[0]
        back = []
        for t in range(1, longest):
            n = live[t]
            step = value[:n, :, None] + moves
            back.append(step.argmax(1).astype(np.int8))
            value[:n] = step.max(1) + score[starts[:n] + t]
        at = (value + moves[:, 0]).argmax(1)
        for t in range(longest - 1, -1, -1):
            n = live[t]
            best[open_[starts[:n] + t]] = at[:n]
            if t:
                at[:n] = back[t - 1][np.arange(n), at[:n]]


def in_parts(texts: list[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    """The texts in runs of about so many characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def text_spans(decoder: Decoder, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """The pattern spans and all spans of each text."""
    for part in in_parts(texts):
        labels = decoder.labels([t.encode("utf-8", "surrogatepass") for t in part])
        for text, own in zip(part, labels, strict=True):
            base = base_spans(text)
            yield base, all_spans(text, base, own)


#: Words of an item at most, where a run has to be cut: longer ones hold too many digits or are no address.
WORDS_OF_ITEM = 20

EDGE_LEFT, EDGE_RIGHT = ".,;:!?\"'[]<>{}=|", ".,;:!?\"'()[]<>{}=|"


def field_items(text: str, labels: np.ndarray) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The kind and the words of each item that the labels show."""
    places = [m.span() for m in WORD.finditer(text)]
    hits = np.flatnonzero(labels)
    kinds = (labels[hits] + 1) // 2
    begins = (np.diff(hits, prepend=-2) > 1) | (np.diff(kinds, prepend=-1) != 0) | (labels[hits] % 2 == 1)
    for run in np.split(hits, np.flatnonzero(begins)[1:]):
        if len(run):
            yield KINDS[(labels[run[0]] - 1) // 2], [places[k] for k in run]


def trimmed(text: str, start: int, end: int, kind: str) -> Span:
    """A span without punctuation at its ends."""
    while start < end and text[start] in EDGE_LEFT:
        start += 1
    while end > start and text[end - 1] in EDGE_RIGHT:
        end -= 1
    return start, end, kind


def parts_of(text: str, words: list[tuple[int, int]], kind: str) -> list[Span]:
    """The words as one span or, if that is not plausible, the plausible parts that hold most of them, the fewest of those."""
    whole = trimmed(text, words[0][0], words[-1][1], kind)
    if plausible(text, whole):
        return [whole]
    best: list[tuple[int, int, list]] = [(0, 0, [])]  # words held, parts (negative), parts
    for end in range(1, len(words) + 1):
        options = [best[end - 1]]
        for start in range(max(0, end - WORDS_OF_ITEM), end):
            span = trimmed(text, words[start][0], words[end - 1][1], kind)
            if plausible(text, span):
                held, parts, chain = best[start]
                options.append((held + end - start, parts - 1, [chain, span]))
        best.append(max(options, key=lambda o: o[:2]))
    out, chain = [], best[-1][2]
    while chain:
        chain, span = chain
        out.append(span)
    return out[::-1]


def plausible(text: str, span: Span) -> bool:
    """What a label must hold at least: digits of a number, or an @ or "at" between two words of an email."""
    piece, kind = text[span[0] : span[1]], span[2]
    digits = len(NOT_DIGIT.sub("", piece))
    if kind == "email":
        return bool(re.search(r"\S\s*(?:@|[\[(]?\bat\b[\])]?)\s*\S.*(?:\.|\bdot\b)", piece))
    if kind == "phone":
        return 7 <= digits <= 15
    if kind == "card":
        return 14 <= digits <= 19 and luhn(NOT_DIGIT.sub("", piece))
    return bool(re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", piece)) and all(int(p) < 256 for p in piece.split("."))


def all_spans(text: str, base: list[Span], labels: np.ndarray) -> list[Span]:
    """The pattern spans, and the field's where they overlap none of those."""
    if not labels.any():
        return base
    more = []
    for kind, words in field_items(text, labels):
        free: list[list[tuple[int, int]]] = [[]]  # what pattern spans leave of the item
        for start, end in words:
            if any(s < end and start < e for s, e, _ in base):
                free.append([])
            else:
                free[-1].append((start, end))
        for part in filter(None, free):
            more += parts_of(text, part, kind)
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(SPAN)), ("spans", pa.list_(SPAN))])
FOUND_DDL = "doc_id long, base array<struct<kind: string, start: long, end: long>>, spans array<struct<kind: string, start: long, end: long>>"


def trained(spark: SparkSession) -> Field:
    """The field, trained on the labelled table."""
    return train_field([tuple(r) for r in labelled_table(spark).collect()])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of each row: pattern spans, and these with the field's. Code points, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        structs = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
        for batch in small(batches):
            found = list(text_spans(decoder, batch.column("text").to_pylist()))
            yield batch_of(FOUND, [batch.column("doc_id").to_pylist(), [structs(b) for b, _ in found], [structs(x) for _, x in found]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, FOUND_DDL)


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts of the pattern spans by kind, their digest, and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_personal_data(docs).select("doc_id", *map(count, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs.sparkSession))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(sent.value)
        for texts in parts:
            full = [t or "" for t in texts]
            out = []
            for text, (_, spans) in zip(full, text_spans(decoder, full), strict=True):
                end, pieces = 0, []
                for s, e, kind in spans:
                    if s >= end:
                        pieces += [text[end:s], f"[{kind.upper()}]"]
                    end = max(end, e)
                out.append("".join([*pieces, text[end:]]))
            yield pd.Series([o if t is not None else None for o, t in zip(out, texts, strict=True)])

    return docs.withColumn("text", F.pandas_udf(run, "string")("text"))
