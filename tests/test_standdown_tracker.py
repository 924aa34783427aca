import datetime as dt
import random

import pytest
from helpers import by, near, result

from ballotframe.operators import standdown, tracker
from ballotframe.sources.inline import inline_table
from pyspark.sql import functions as F

RULE = {"scenario_id": "string", "election_id": "string", "ord": "int", "party_from": "string", "party_to": "string",
        "pct": "string"}


def moved(spark, votes, rules, absent):
    active, _ = standdown.validate_rules(inline_table(spark, RULE, [("k", "e", *r) for r in rules]))
    candidates = result(spark, [v for v in votes if v[0] not in absent])
    marked = standdown.mark_standing(result(spark, votes), candidates, tuple(absent), ("election_id",))
    return standdown.redistribute(marked, active).first()


def test_redistribution(spark):
    row = moved(
        spark, [("con", 400), ("lab", 380), ("ukip", 100)],
        [(1, "ukip", "con", "20"), (1, "ukip", "lab", "50"), (1, "ukip", "lib", "0")], ["ukip"],
    )
    assert {p.party: p.votes for p in row.parties} == {"con": 420.0, "lab": 430.0}
    assert (row.turnout, row.winner, row.majority) == (850.0, "lab", 10.0)


def test_sources_are_worked_off_in_order_with_rounding(spark):
    rules = [(1, "ukip", "con", "50"), (1, "ukip", "lab", "25"), (2, "green", "con", "50"), (2, "green", "lab", "25")]
    row = moved(spark, [("con", 10), ("lab", 10), ("ukip", 5), ("green", 7)], rules, ["ukip", "green"])
    # con: floor(10 + 2.5 + .5) = 13, floor(13 + 3.5 + .5) = 17; lab: floor(11.25 + .5) = 11, floor(12.75 + .5) = 13
    assert {p.party: p.votes for p in row.parties} == {"con": 17.0, "lab": 13.0}
    assert row.turnout == 29.0  # floor(32 - 1.25 + .5) = 31, floor(31 - 1.75 + .5) = 29


def test_a_standing_party_keeps_its_votes(spark):
    row = moved(spark, [("con", 4), ("ukip", 3)], [(1, "ukip", "con", "100")], [])
    assert {p.party: p.votes for p in row.parties} == {"con": 4.0, "ukip": 3.0} and row.turnout == 7.0


def test_rules_are_validated(spark):
    df = inline_table(spark, RULE, [
        ("bad", "e", 1, "ukip", "con", "70"), ("bad", "e", 1, "ukip", "lab", "31"),
        ("idle", "e", 1, "ukip", "con", "0"), ("text", "e", 1, "ukip", "con", "x"), ("text", "e", 1, "ukip", "lab", "12.9"),
    ])
    active, rejected = standdown.validate_rules(df)
    assert [(r.scenario_id, r.not_voting) for r in rejected.collect()] == [("bad", -1)]
    assert {(r.scenario_id, r.party_to, r.pct, r.not_voting) for r in active.collect()} == {
        ("text", "con", 0, 88), ("text", "lab", 12, 88)}


def test_rules_must_share_a_key(spark):
    with pytest.raises(ValueError):
        standdown.redistribute(result(spark, [("a", 1)]), inline_table(spark, RULE, []), rule_keys=("scenario_id",))


POINT = {"party": "string", "fieldwork_date": "date", "code": "bigint", "pct": "double"}


def expected_means(points, n):
    out = {}
    for party in {p[0] for p in points}:
        series = sorted((p for p in points if p[0] == party), key=lambda p: (p[1], p[2]))
        for i, p in enumerate(series):
            window = [q[3] for q in series[max(0, i - n + 1): i + 1]]
            out[p[0], p[2]] = sum(window) / len(window)
    return out


def test_moving_average_of_13_points(spark):
    rows = [("a", f"2017-01-{i:02d}", i, float(i)) for i in range(1, 14)]
    got = by(tracker.moving_average(inline_table(spark, POINT, rows)), "code")
    assert near(got[13]["moving"], 7.5) and near(got[3]["moving"], 2.0)


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_moving_average_blocks_agree_with_one_window(spark, block_rows):
    """A day with most of the points, days with one point, and gaps between codes."""
    rng = random.Random(5)
    points, code = [], 0
    for party in ("a", "b"):
        for day, count in [(1, 1), (2, 60), (3, 1), (4, 1), (9, 25), (10, 2)]:
            for _ in range(count):
                code += rng.choice([1, 1, 1, 500])
                points.append((party, f"2017-01-{day:02d}", code, float(rng.randrange(0, 1000)) / 10))
    df = inline_table(spark, POINT, points)
    for n in (1, 4, 12):
        got = {(r.party, r.code): r.moving for r in tracker.moving_average(df, n, block_rows=block_rows).collect()}
        want = expected_means(points, n)
        assert got.keys() == want.keys()
        assert all(near(got[k], want[k]) for k in want)


def test_moving_average_of_very_uneven_codes(spark):
    """One busy day whose codes lie close together but for a few far away."""
    points = [("a", "2017-01-01", k, float(k % 13)) for k in range(400)]
    points += [("a", "2017-01-01", 10**9 * k, float(k)) for k in range(1, 6)] + [("a", "2017-01-02", 10**11, 1.0)]
    got = {(r.party, r.code): r.moving for r in tracker.moving_average(inline_table(spark, POINT, points), 12, block_rows=50).collect()}
    want = expected_means(points, 12)
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)


def test_snapshot_replaces_its_date(spark):
    columns = {"date": "date", "party": "string", "seats": "int"}
    history = inline_table(spark, columns, [("2017-05-01", "a", 1), ("2017-06-01", "a", 2), ("2017-06-01", "b", 3)])
    snapshot = inline_table(spark, columns, [("2017-06-01", "a", 9)])
    rows = sorted(tuple(r) for r in tracker.upsert_snapshot(history, snapshot).collect())
    assert rows == [(dt.date(2017, 5, 1), "a", 1), (dt.date(2017, 6, 1), "a", 9)]
    series = tracker.model_series(history, dt.date(2017, 5, 2), dt.date(2017, 7, 1))
    assert series.count() == 2 and series.first().majority_line == 326


def test_filter_state_helpers():
    assert tracker.clamp_range(dt.date(2014, 1, 1), None) == (tracker.DEFAULT_START, tracker.DEFAULT_END)
    assert tracker.clamp_range(dt.date(2016, 1, 1), dt.date(2017, 1, 1)) == (dt.date(2016, 1, 1), dt.date(2017, 1, 1))
    assert tracker.toggle_company(["a", "b"], "a") == ["b"] and tracker.toggle_company(["b"], "a") == ["b", "a"]


def test_hot_series_spreads_over_blocks(spark):
    """Nearly all points fall on one day of one series; no block may hold them all."""
    points = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("party"), F.lit(dt.date(2017, 1, 1)).alias("fieldwork_date"),
        F.col("id").alias("code"), (F.col("id") % 7).cast("double").alias("pct"),
    )
    df = tracker.moving_average(points, 12, block_rows=500)
    assert df.count() == 20_000
    last = df.where("code = 19999").first()
    ids = [i for i in range(20_000) if i % 50 != 0][-12:]
    assert near(last.moving, sum(i % 7 for i in ids) / 12)
