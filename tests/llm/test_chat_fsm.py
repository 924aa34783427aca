import hashlib

import oracle_check
import pytest
from pyspark.sql import functions as F

from ballotframe.llm import catalogue, chat_fsm

ROWS = "conv_id long, turn long, role string, text string"


def test_matches_sql(spark, sf_dir):
    con = oracle_check.duck(sf_dir)
    assert oracle_check.compare(catalogue.op4_chat_fsm(spark, sf_dir), con, chat_fsm.ORACLE) is None


TEXTS = ["", None, "\\", "\\\\### ", "</turn>", "</turn>\n### user: x", "#### ###  </turn</turn>>", "a: b\\:", "\n\n", "x" * 50_000, "é\U0001f642"]


def test_odd_texts_come_back(spark):
    roles = ["user", "assistant", None, "we:ird\\ ### role", "system"]
    rows = [(1, k, roles[k % 5], t) for k, t in enumerate(TEXTS)]
    rows += [(2, None, "assistant", "b"), (2, None, "assistant", "a"), (None, 1, "user", "x"), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, ROWS).withColumn("turns", F.lit("clash")).withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat_fsm.conversation_digests(df).collect()}
    want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[: len(TEXTS)])
    assert out[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and out[1].n_turns == len(TEXTS)
    loss = "".join(t or "" for _, _, r, t in rows[: len(TEXTS)] if r == "assistant")
    assert out[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and out[1].loss_chars == len(loss)
    assert out[2].loss_sha256 == hashlib.sha256(b"ab").hexdigest() and out[None].n_turns == 2


@pytest.mark.parametrize("roles, valid", [
    ("user assistant", True), ("system user", True), ("user assistant user", True), ("system", False), ("assistant user", False),
    ("user user", False), ("user assistant assistant", False), ("system system user", False), ("user tool", False), ("user system", False),
])
def test_turn_order(spark, roles, valid):
    rows = [(1, k, r, "t") for k, r in enumerate(roles.split())]
    out = chat_fsm.format_conversations(spark.createDataFrame(rows, ROWS)).first()
    assert out.valid is valid
    assert "".join(s.text for s in out.segments) == out.formatted
    assert [s.text for s in out.segments if s.loss] == ["t"] * roles.split().count("assistant")


def test_empty_table_and_plan(spark, sf_dir):
    assert chat_fsm.conversation_digests(spark.createDataFrame([], ROWS)).count() == 0
    plan = catalogue.op4_chat_fsm(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
