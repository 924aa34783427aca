"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

A lexicon is learned from labelled texts: words that are much likelier in toxic ones, with their log odds. The features
are densities of the lexicon, plain and after undoing obfuscation, their closeness to the second person, and rates of
capitals, punctuation and obfuscated words. The trees and the calibration are fitted on a sample of labelled rows, at
most ``fit_rows`` of them, chosen by a hash of doc_id; that bounds what is broadcast (ids with labels) and what the fit
holds. All rows are scored: features where the text is read, trees and calibration as column expressions; no text is
shuffled.

Nulls: a null text is empty and scored like one; a label without doc_id or toxic is left out; labels that contradict
each other count as toxic. Repeated rows are scored each by itself. Without labels of both kinds all scores are the share
of toxic labels, or 0 without labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, stored, text_or_empty

# Second person in four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre tes usted ustedes ti tus vosotros".split())
UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
EDGE = ".,;:!?\"'()[]{}<>«»¿¡"
NEAR = 6
PUNCTUATION = re.compile(r"[^\w\s]")
REPEAT = re.compile(r"(.)\1{2,}")


@dataclass(frozen=True)
class ToxicityParams:
    """``fit_rows``: labelled rows the model is fitted on, at most; ``lexicon``: words in it, at most; a word needs
    ``least_texts`` texts and a log odds of ``least_odds``; ``folds``: one of so many is kept for the calibration."""

    fit_rows: int = 20_000
    lexicon: int = 4_000
    least_texts: int = 8
    least_odds: float = 1.5
    trees: int = 20
    depth: int = 4
    folds: int = 4


FEATURES = ("words", "strong", "strong_kinds", "weak", "weight", "heaviest", "hidden", "second", "near_second", "near_hidden",
            "capitals", "shouted", "exclamations", "questions", "punctuation", "obfuscated", "stretched")


def plain_words(text: str) -> list[str]:
    return [w.strip(EDGE) for w in text.lower().split()]


def terms(word: str) -> tuple[str, ...]:
    """The word and, for longer words, its stem of four and of five letters."""
    return (word,) if len(word) < 6 else (word, word[:5] + "~", word[:4] + "~")


def undone(word: str) -> str:
    """The word with look-alike characters replaced, separators dropped and long repeats shortened."""
    return REPEAT.sub(r"\1", word.strip(EDGE).translate(UNDO))


ODD = re.compile(r"[^\W\d_][^\w\s'’,;:?()\"]+[^\W_]|[^\W\d_]\d|\d[^\W\d_]|(.)\1\1")


def text_features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The values of FEATURES. Counts are logarithms or rates, so that long texts compare with short ones."""
    raw = text.split()
    words = plain_words(text)
    n = len(words)
    found = [(k, x) for k, w in enumerate(words) if (x := next((lexicon[t] for t in terms(w) if t in lexicon), None)) is not None]
    odd = [(k, undone(w)) for k, w in enumerate(raw) if len(w) > 2 and not w.isalpha() and ODD.search(w.rstrip(EDGE))] if ODD.search(text) else []
    hidden = [k for k, w in odd if (w in lexicon or w.lower() in lexicon) and words[k] not in lexicon]
    seconds = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    strong = [k for k, x in found if x > 3]

    def near(places: list[int]) -> int:
        at = set(places)
        return sum(any(k + d in at for d in range(-NEAR, NEAR + 1)) for k in seconds) if at else 0

    letters = sum(map(len, words)) or 1
    per = 100.0 / max(n, 1)
    marks = len(PUNCTUATION.findall(text))
    capitals = sum(map(str.isupper, text)) if n else 0
    return [
        math.log1p(n),
        len(strong) * per,
        math.log1p(len({words[k] for k in strong})),
        (len(found) - len(strong)) * per,
        sum(x for _, x in found) * per,
        max((x for _, x in found), default=0.0),
        math.log1p(len(hidden)),
        len(seconds) * per,
        math.log1p(near(strong)),
        math.log1p(near(hidden)),
        capitals / letters,
        sum(w.isupper() and len(w) > 1 for w in raw) * per,
        text.count("!") * per,
        text.count("?") * per,
        marks / letters,
        len(odd) * per,
        sum(1 for _, w in odd if REPEAT.search(w)) * per,
    ]


def labelled_sample(labels: DataFrame, allowed: Column, params: ToxicityParams) -> DataFrame:
    """(doc_id, toxic) of at most ``fit_rows`` labelled rows, chosen by a hash of doc_id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed)
    rows = rows.groupBy("doc_id").agg(F.when(F.max("toxic") > 0, 1.0).otherwise(0.0).alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.fit_rows)


def learn_lexicon(texts: DataFrame, params: ToxicityParams) -> dict[str, float]:
    """Words with their log odds of standing in a toxic text. ``texts``: (text, toxic)."""
    schema = pa.schema([("word", pa.string()), ("toxic", pa.float64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen.update((t, toxic) for t in {t for w in set(plain_words(text)) if 1 < len(w) <= 40 for t in terms(w)})
            yield batch_of(schema, [[w for w, _ in seen], [t for _, t in seen], list(seen.values())])

    totals = texts.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = totals.bad or 0.0, totals.n - (totals.bad or 0.0)
    words = texts.mapInArrow(count, "word string, toxic double, n long").groupBy("word")
    words = words.agg(F.sum(F.col("n") * F.col("toxic")).alias("bad"), F.sum("n").alias("n")).where(F.col("bad") >= params.least_texts)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1))
    words = words.withColumn("odds", odds).where(F.col("odds") >= params.least_odds)
    return {r.word: r.odds for r in words.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(params.lexicon).collect()}


def with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` with the features of ``text``; only the text is sent to Python."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([text_features(t, sent.value) for t in texts])

    return rows.withColumn("features", array_to_vector(F.pandas_udf(run, "array<double>")("text")))


def fitted(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, params: ToxicityParams | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``score`` to rows with a ``text`` that is not null.

    ``allowed``: a condition on doc_id of labels that may be learned from. The score is the calibrated probability, with
    a thousandth of the trees' own, so that equal steps of the calibration keep their order.
    """
    p = params or ToxicityParams()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sample = stored(labelled_sample(labels, allowed if allowed is not None else F.lit(True), p))
    # at most fit_rows ids and labels
    texts = stored(rows.join(F.broadcast(sample), "doc_id"))
    kinds = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not kinds.bad or kinds.bad == kinds.n:
        share = float(kinds.bad or 0) / max(kinds.n, 1)
        return lambda some: some.withColumn("score", F.lit(share))
    lexicon = learn_lexicon(texts.select("text", "toxic"), p)
    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(p.folds))
    fit = stored(with_features(texts, lexicon).select("doc_id", "toxic", "features", fold.alias("fold")))
    trees = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=p.trees, maxDepth=p.depth, stepSize=0.2, seed=5, cacheNodeIds=False)
    model = trees.fit(fit.where("fold > 0").select("toxic", "features"))
    raw = vector_to_array("probability")[1].alias("raw")
    checked = model.transform(fit.where("fold = 0")).select("toxic", raw)
    steps = None
    if checked.agg(F.countDistinct("toxic")).first()[0] == 2:
        steps = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="level").fit(checked)

    def score(some: DataFrame) -> DataFrame:
        scored = model.transform(with_features(some, lexicon)).select(*some.columns, raw)
        if steps is not None:
            scored = steps.transform(scored)
        level = F.col("level") if steps is not None else F.col("raw")
        return scored.select(*some.columns, (0.999 * level + 0.001 * F.col("raw")).alias("score"))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, params: ToxicityParams | None = None) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    score = fitted(docs, labels, allowed, params)
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))).select("doc_id", "score")


def keep_clean(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> DataFrame:
    """The rows of ``docs`` with a score below one half, all columns. Rows are judged where they are read."""
    score = fitted(docs, labels, None, params)
    return score(docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"))).where("score < 0.5").select("row.*")
