"""Text rules for historical facts, as native column expressions.

Whole words are told by letters, digits and underscores of any script, and white
space is Unicode white space, whatever the defaults of the regex engine are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations that do not end a sentence. A circa mark comes back in lower case.
ABBREVIATIONS = ["St", "Mt", "Dr", "Mr", "Mrs", "[Cc]", "[Cc]a"]

# Words that name an era.
ERA_WORDS = ["AD", "BC", "BCE", "CE"]

# Month names.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# Named and numeric character references decoded in page text.
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]

# Unicode white space, as ranges of code points.
SPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
_SPACES = "".join(chr(p) for first, last in SPACE_RANGES for p in range(first, last + 1))
_SPACE = "[" + "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in SPACE_RANGES) + "]"
_SPACE_RUN = _SPACE + "+"
_WORD = r"[\p{L}\p{N}_]"
_START, _END = rf"(?<!{_WORD})", rf"(?!{_WORD})"
_SHIELD = "\x01"
_CUT = "\x02"


def strip(col: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.btrim(col, F.lit(_SPACES))


def first_sentences(col: Column, n: int = 2) -> Column:
    """The first ``n`` sentences; known abbreviations do not end one.

    A sentence ends at ``.``, ``!`` or ``?`` followed by space and a capital A-Z.
    """
    marked = rf"{_START}({'|'.join(ABBREVIATIONS)})\.{_SPACE}"
    text = F.regexp_replace(col, marked, f"$1{_SHIELD} ")
    text = F.regexp_replace(text, rf"([.!?]){_SPACE_RUN}([A-Z])", f"$1{_CUT}$2")
    text = F.array_join(F.slice(F.split(text, _CUT), 1, n), " ")
    text = F.regexp_replace(text, rf"{_START}C(?=a?{_SHIELD})", "c")
    return F.replace(text, F.lit(_SHIELD), F.lit("."))


def mark_near_years(col: Column, year: Column, window: int = 100) -> Column:
    """Numbers of up to four digits within ``window`` of ``year`` become the token ``YYYY``."""

    def one_run(run: Column) -> Column:
        number = F.when(run.rlike("^[0-9]{1,4}$"), run.try_cast("int"))
        return F.when(F.abs(number - year) <= window, F.lit("YYYY")).otherwise(run)

    runs = F.regexp_extract_all(col, F.lit(rf"{_WORD}+|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    return F.array_join(F.transform(runs, one_run), "")


def _replace_all(col: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, repair in rules:
        col = F.regexp_replace(col, pattern, repair)
    return col


def with_clean_fact(df: DataFrame, event: str, year: Column, out: str, window: int = 100) -> DataFrame:
    """Adds ``out``: the fact made fit for a guessing game, ``''`` where it must be dropped.

    Each step is a column of its own, and the rarer rules look at a text only when it
    holds the character they are about; most facts pass with a few scans.
    """

    def step(rows: DataFrame, rule: Callable[[Column], Column], needs: str | None = None) -> DataFrame:
        text = F.col(out)
        done = rule(text)
        return rows.withColumn(out, done if needs is None else F.when(text.contains(needs), done).otherwise(text))

    # The patterns of the cleaning rules.
    circa = rf"^(?:[Cc]\.{_SPACE_RUN}|[Cc]a\.{_SPACE_RUN}|[Cc]irca{_SPACE_RUN})[—–-]?{_SPACE}*"
    rows = df.withColumn(out, F.regexp_replace(strip(F.col(event)), circa, ""))
    rows = step(rows, lambda t: F.regexp_replace(t, r"\[[0-9]+\]", ""), "[")
    rows = step(rows, lambda t: first_sentences(F.regexp_replace(t, r"\n+", " "), 2))
    century = rf"(?i){_START}[0-9]+(?:st|nd|rd|th){_SPACE_RUN}century{_END}"
    rows = rows.withColumn("_digits", F.col(out).rlike("[0-9]"))
    rows = rows.withColumn(out, F.when(F.col("_digits"), F.regexp_replace(out, century, "")).otherwise(F.col(out)))
    rows = step(rows, lambda t: F.regexp_replace(t, rf"(?i){_START}(?:{'|'.join(ERA_WORDS)}){_END}", ""))
    rows = rows.withColumn(
        out, F.when(F.col("_digits"), mark_near_years(F.col(out), year, window)).otherwise(F.col(out))
    ).drop("_digits")
    rows = step(rows, lambda t: _replace_all(t, [
        (rf"{_START}YYYY-year-old{_END}", "young"),
        (rf"{_START}YYYY years?{_END}", "some years"),
        (rf"{_START}YYYY months?{_END}", "several months"),
        (rf"{_START}YYYY{_END}", ""),
    ]), "YYYY")
    rows = step(rows, lambda t: _replace_all(t, [
        (rf"\({_SPACE}*[,.]?{_SPACE}*\)", ""),
        (rf"\({_SPACE}*{_WORD}*{_SPACE}*\)", ""),
    ]), "(")
    rows = step(rows, lambda t: _replace_all(t, [
        (rf"{_SPACE}{{2,}}", " "),
        (rf"{_SPACE_RUN}([,.])", "$1"),
        (rf"{_SPACE_RUN}([,]){_SPACE_RUN}", "$1 "),
    ]))
    months = rf"^(?:{'|'.join(MONTHS)}){_SPACE_RUN}[A-Z]"
    rows = rows.withColumn("_month_only", F.col(out).rlike(months) & (F.length(out) < 50))
    rows = rows.withColumn(out, strip(F.col(out)))
    body = F.col(out)
    too_short = (F.length(body) < 30) | (F.size(F.split(body, rf"{_SPACE_RUN}", 5)) < 5)
    stop = F.when(F.right(body, F.lit(1)).isin(".", "!", "?"), F.lit("")).otherwise(F.lit("."))
    sentence = F.concat(F.upper(F.substring(body, 1, 1)), body.substr(F.lit(2), F.length(body)), stop)
    return rows.withColumn(
        out, F.when(F.col("_month_only") | too_short, F.lit("")).otherwise(sentence)
    ).drop("_month_only")


def is_good_fact(cleaned: Column) -> Column:
    """Kept facts: not empty, over 30 characters, no left-over circa mark."""
    return (F.length(cleaned) > 30) & ~cleaned.startswith("C. ")


def plain_text(html: Column) -> Column:
    """Tag-free text of an HTML fragment, citation marks in <sup> removed."""
    text = F.regexp_replace(html, r"(?is)<sup\b.*?</sup>", "")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(text)
