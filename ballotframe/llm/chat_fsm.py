"""Chat formatting with a finite-state machine over roles and a declarative template.

A conversation is the rows of one conv_id in the order of turn (then role and text, for ties); it becomes one text, so
its turns are gathered in one row, as they are in the result. Only built-in functions are used.

Texts are escaped, so that no control string of the template occurs inside them: a backslash is doubled and one is put
into every control string. Dropping the first of each backslash and the character after it reverses both.

Nulls: a null text or role is empty; a null turn comes first; a null conv_id is a conversation of its own. Repeated rows
are turns of their own. The machine rejects roles it does not know, but every conversation is formatted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``opening`` + role + ``named`` + text + ``closing`` is a turn. ``loss_roles`` are trained on.
    ``moves``: (state, role) to state; a conversation is valid if the machine ends in one of ``final``."""

    opening: str = "### "
    named: str = ": "
    closing: str = "</turn>\n"
    controls: tuple[tuple[str, str], ...] = (("</turn>", "<\\/turn>"), ("### ", "##\\# "))
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "briefed"),
        ("start", "user", "asked"),
        ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("asked", "answered")


def escape(text: Column, template: ChatTemplate) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, written in template.controls:
        out = F.replace(out, F.lit(control), F.lit(written))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the rows of a conversation in order."""
    empty = F.lit("")
    row = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))


def end_state(turns: Column, template: ChatTemplate) -> Column:
    """The state the machine is in after the last turn; "rejected" once no move fits."""
    moves = F.create_map(*(F.lit(x) for a, role, b in template.moves for x in (f"{a} {role}", b)))
    step = lambda state, turn: F.coalesce(F.element_at(moves, F.concat_ws(" ", state, turn["role"])), F.lit("rejected"))
    return F.aggregate(turns, F.lit(template.start), step)


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, n_turns, state, valid, segments, formatted). A segment is a piece of the formatted text and whether
    the loss covers it; the segments' texts joined are the formatted text."""
    t = template or ChatTemplate()
    role = lambda x: F.replace(escape(x["role"], t), F.lit(":"), F.lit("\\:"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    parts = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.opening), role(x), F.lit(t.named)), no),
                segment(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
                segment(F.lit(t.closing), no),
            ),
        )
    )
    out = conversations_of(turns).withColumn("state", end_state(F.col("turns"), t)).withColumn("segments", parts)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "state",
        F.col("state").isin(*t.final).alias("valid"),
        "segments",
        F.array_join("segments.text", "").alias("formatted"),
    )


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The (role, text) turns that a formatted text holds."""
    t = template or ChatTemplate()
    pieces = F.filter(F.split(formatted, f"\\Q{t.closing}\\E"), lambda x: F.startswith(x, F.lit(t.opening)))
    pattern = f"(?s)^\\Q{t.opening}\\E((?:[^\\\\:]++|\\\\.)*+)\\Q{t.named}\\E(.*)$"
    part = lambda x, k: unescape(F.regexp_extract(x, pattern, k))
    return F.transform(pieces, lambda x: F.struct(part(x, 1).alias("role"), part(x, 2).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def conversation_digests(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Digests of each conversation, read back from its formatted text and loss mask."""
    read = format_conversations(turns, template).select(
        "conv_id", "valid", "formatted", read_turns(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("loss")
    )
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.col("valid").alias("valid_order"),
    )


#: What a formatter must not stumble on, as a conversation of its own.
PROBE = "\\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose texts hold control strings."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return rows.unionByName(probe)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# ') AS escaped FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text) || ',', '(system,)?(user,assistant,)*(user,)?')
    AND bool_or(role <> 'system') AS valid_order
FROM written GROUP BY conv_id
"""
