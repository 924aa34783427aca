import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ballotframe.llm import catalogue, pii_crf
from ballotframe.llm.pii_crf import KINDS


def brute_spans(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [(m.start(), m.end(), "ip")] * all(int(p) <= 255 for p in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
        out += [(m.start(), m.end(), "card")] * (14 <= len(digits) <= 19 and total % 10 == 0)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [(m.start(), m.end(), "phone")] * (10 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.+-_% 0123456789()\n", max_size=60))
def test_patterns_equal_plain_ones(text):
    assert pii_crf.base_spans(text) == brute_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii_crf.train_field(pii_crf.labelled_rows())


def sentences(seed):
    """The labelled sentences with other digits."""
    rng = np.random.default_rng(seed)
    for s in pii_crf.SENTENCES:
        filled = re.sub("#", lambda _: str(rng.integers(0, 10)), s) if not s.startswith("#") else s
        words = [(w, f"{'I' if j else 'B'}-{m[1]}" if m[1] else "other")
                 for m in pii_crf.SLOT.finditer(filled) for j, w in enumerate((m[2] or m[3]).split())]
        yield words


def test_accuracy_on_other_numbers(field):
    decoder, right, total = pii_crf.Decoder(field), 0, 0
    for words in sentences(99):
        labels = decoder.labels([" ".join(w for w, _ in words).encode()])[0]
        right += sum(pii_crf.LABELS[k] == label for k, (_, label) in zip(labels, words, strict=True))
        total += len(words)
    assert right / total > 0.98


@pytest.mark.parametrize(("text", "want"), [
    ("call 555-123-4567 555-765-4321 now", ["phone:555-123-4567", "phone:555-765-4321"]),
    ("call 555-123-4567, 555-765-4321 now", ["phone:555-123-4567", "phone:555-765-4321"]),
    ("call 555-123-4567 555-765-4321 212-555-0199 now", ["phone:555-123-4567", "phone:555-765-4321", "phone:212-555-0199"]),
    ("on +1 (555) 555-0101 555-123-4567 now", ["phone:+1 (555) 555-0101", "phone:555-123-4567"]),
    ("the 4465758382889437 4465758382889437 of", ["card:4465758382889437", "card:4465758382889437"]),
    ("mail tom at example dot org, eve at mail dot example dot com today", ["email:tom at example dot org", "email:eve at mail dot example dot com"]),
    ("mail bob at example dot com or sue at example dot net today", ["email:bob at example dot com", "email:sue at example dot net"]),
    ("a.b@c.org d.e@f.org", ["email:a.b@c.org", "email:d.e@f.org"]),
    ("we met at the house at ten and 1234 of 20 left", []),
])
def test_items_side_by_side(field, text, want):
    (_, spans), = pii_crf.text_spans(pii_crf.Decoder(field), [text])
    got = [f"{kind}:{text[s:e]}" for s, e, kind in spans]
    assert got == want


def test_parts_of_a_run(field):
    """A run labelled as one item is cut into the parts that are plausible, most words first."""
    text = "555-123-4567 555-765-4321 99 212-555-0199"
    words = [m.span() for m in pii_crf.WORD.finditer(text)]
    assert [text[s:e] for s, e, _ in pii_crf.parts_of(text, words, "phone")] == ["555-123-4567", "555-765-4321", "99 212-555-0199"]
    assert pii_crf.parts_of("99 98", [(0, 2), (3, 5)], "card") == []


def test_precision_and_recall_of_added_spans(field):
    """Items that no pattern finds, in other words and numbers than those of training."""
    rng, decoder, found, right, wanted = np.random.default_rng(31), pii_crf.Decoder(field), 0, 0, 0
    draw = lambda shape: re.sub("#", lambda _: str(rng.integers(0, 10)), shape)
    plain = "the council opened a road near river and many people came to see it while rain fell over fields".split()
    shapes = [("phone", "(###) 555-####"), ("phone", "555-###-####"), ("phone", "###.555.####"), ("email", "nina at mail dot example dot org"),
              ("email", "paul (at) example (dot) com"), (None, "###-##"), (None, "20##"), (None, "#.##"), (None, "chapter #.#.#")]
    for _ in range(400):
        pieces, want, at = [], set(), 0
        for _ in range(6):
            kind, piece = (None, " ".join(rng.choice(plain, 4))) if rng.random() < 0.6 else shapes[rng.integers(0, len(shapes))]
            piece = draw(piece)
            if kind:
                want.add((at, at + len(piece), kind))
            pieces.append(piece)
            at += len(piece) + 1
        (_, spans), = pii_crf.text_spans(decoder, [" ".join(pieces)])
        found, right, wanted = found + len(spans), right + len(want & set(spans)), wanted + len(want)
    print("precision", right / found, "recall", right / wanted)
    assert right / found > 0.9 and right / wanted > 0.9


def test_decoding_is_exact(field):
    """Cut-up Viterbi gives paths as good as plain Viterbi over whole texts."""
    decoder, rng = pii_crf.Decoder(field), np.random.default_rng(8)
    words = [w for s in sentences(5) for w, _ in s]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)]
    decoder.BLOCK = 37
    for text, labels in zip(texts, decoder.labels([t.encode() for t in texts]), strict=True):
        own = text.split()
        if not own:
            continue
        rows = [decoder.shapes[w.encode().translate(pii_crf.SHAPES)] for w in own]
        known = [decoder.words.get(w.lower().encode(), 0) for w in own]
        part = np.stack(decoder.shapes.rows)[rows] + decoder.word_scores[known]
        score = part[:, 0].astype(float)
        score[1:] += part[:-1, 1]
        score[:-1] += part[1:, 2]
        moves = field.moves

        def worth(path):
            return score[np.arange(len(path)), path].sum() + moves[np.r_[0, path], np.r_[path, 0]].sum()

        best = score[0] + moves[0]
        for e in score[1:]:
            best = (best[:, None] + moves).max(0) + e
        assert worth(np.array(labels, int)) == pytest.approx((best + moves[:, 0]).max(), abs=1e-3)


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = catalogue.op10_pii_crf(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii_crf.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in KINDS]
        assert set(filter(None, pii_crf.written(base).split(","))) <= set(r.spans.split(","))


def test_odd_rows_and_redaction(odd_docs, make_docs):
    assert pii_crf.span_digests(odd_docs).count() == odd_docs.count()
    assert pii_crf.span_digests(make_docs([])).count() == 0
    docs = make_docs([(1, "é mail a.b@c.org, call (212) 555-0199 or bob at mail dot example dot com today"), (2, None), (3, "plain")])
    out = {r.doc_id: r.text for r in pii_crf.redact(docs).collect()}
    assert out == {1: "é mail [EMAIL], call [PHONE] or [EMAIL] today", 2: None, 3: "plain"}
    assert pii_crf.redact(odd_docs).columns == odd_docs.columns
