import datetime as dt

import pytest
from helpers import by, near, result, seats

from ballotframe.operators import areas, polls, project
from ballotframe.plans.nowcast import NowcastDims, nowcast
from ballotframe.sources import dims
from ballotframe.sources.inline import inline_table
from pyspark.sql import functions as F

POLL = {
    "code": "bigint", "company": "string", "fieldwork_date": "date", "area": "string", "party": "string",
    "n": "bigint", "total": "bigint",
}


def poll(spark, rows, company="x", code=1, day="2017-06-01"):
    """Rows (area, party, n, total)."""
    return inline_table(spark, POLL, [(code, company, day, *r) for r in rows])


def test_overlap_of_nested_areas(spark):
    df = poll(spark, [("North", "a", 100, 100), ("Scotland", "a", 30, 30)], "icm")
    rows = by(polls.correct_overlaps(df, dims.overlap_rules(spark)), "area")
    assert (rows["North"]["n"], rows["Scotland"]["n"], rows["North"]["total"]) == (70, 30, 70)
    assert "Midlands" not in rows


def test_overlap_with_a_derived_area(spark):
    areas_ = [("England", 500), ("South", 150), ("Midlands", 200), ("North", 140), ("London", 60), ("Wales", 1), ("Scotland", 9)]
    df = poll(spark, [(a, "p", n, n) for a, n in areas_], "mori")
    rows = {k: r["n"] for k, r in by(polls.correct_overlaps(df, dims.overlap_rules(spark)), "area").items()}
    assert rows == {"South": 150, "Midlands": 150, "North": 140, "London": 60, "Wales": 50, "Scotland": 9}


def test_weight_decays_per_day_unless_fixed(spark):
    df = poll(spark, [("All", "a", 1, 2)], "icm").unionByName(poll(spark, [("All", "a", 1, 2)], "me"))
    rows = by(polls.with_weight(df, dims.pollster(spark), dt.date(2017, 6, 3)), "company")
    assert near(rows["icm"]["weight"], 0.6125) and rows["me"]["weight"] == 10_000_000


def test_fraction_by_scale(spark):
    df = poll(spark, [("All", "a", 30, 60)], "icm")
    for company in ("yougov", "mori", "deltapoll"):
        df = df.unionByName(poll(spark, [("All", "a", 30, 60)], company))
    rows = by(polls.to_fraction(df, dims.pollster(spark)), "company")
    assert [rows[c]["fraction"] for c in ("icm", "yougov", "mori", "deltapoll")] == [0.5, 0.3, 0.5, 30.0]
    compat = by(polls.to_fraction(df, dims.pollster(spark, compat=True)), "company")
    assert compat["mori"]["fraction"] == 30.0


def test_poll_points_use_sample_sizes_and_skip_repeated_areas(spark):
    df = poll(spark, [("A", "conservative", 40, 100), ("A", "labour", 60, 100), ("B", "conservative", 20, 300),
                      ("B", "labour", 80, 300)], "yougov")
    rows = by(polls.poll_points(df), "party")
    assert (rows["conservative"]["pct"], rows["labour"]["pct"], rows["snp"]["pct"]) == (25.0, 75.0, 0.0)
    icm = poll(spark, [("North", "labour", 10, 20), ("North", "uu", 10, 20), ("Wales", "labour", 50, 50)], "icm")
    rows = by(polls.poll_points(icm), "party")
    assert (rows["labour"]["pct"], rows["others"]["pct"]) == (50.0, 50.0)


def test_display_names_latest_and_exclusions(spark):
    df = poll(spark, [("A", "a", 1, 1)], "icm2", 7).unionByName(poll(spark, [("A", "a", 1, 1)], "orb", 9))
    df = df.unionByName(poll(spark, [("A", "a", 1, 1)], "me", 1001))
    shown = by(polls.with_display_company(df, dims.display_company(spark)), "company")
    assert (shown["icm2"]["shown_company"], shown["orb"]["shown_company"]) == ("icm", "others")
    assert polls.latest_poll(df).first().company == "orb"
    assert polls.exclude_polls(df).count() == 2
    assert polls.latest_date(df).first().latest_date == dt.date(2017, 6, 1)
    assert polls.latest_date(df.where("false")).first().latest_date == dt.date(2015, 5, 1)


def swing_seats(spark, votes, change):
    changes = inline_table(spark, {"region": "string", "party": "string", "change": "double"}, change)
    return project.project(result(spark, votes), seats(spark, [("s", "r", 2000)]), changes)


def region_change(spark, old, poll_rows):
    old_df = areas.regional_totals(
        result(spark, old, seat="z"), seats(spark, [("z", "r", 1)]), [p for p, _ in old], keys=("election_id",)
    ).drop("election_id")
    weighted = polls.with_weight(
        polls.to_fraction(poll(spark, poll_rows, "icm"), dims.pollster(spark)), dims.pollster(spark), "2017-06-03"
    )
    crosswalk = inline_table(spark, {"company": "string", "area": "string", "region": "string"}, [("icm", "All", "r")])
    return project.regional_change(polls.blend(weighted, old_df, crosswalk))


def test_uniform_swing_from_one_poll(spark):
    change = region_change(
        spark, [("con", 300), ("lab", 475), ("lib", 225)],
        [("All", "con", 25, 100), ("All", "lab", 50, 100), ("All", "lib", 25, 100)],
    )
    moved = {r.party: r.change for r in change.collect()}
    assert near(moved["con"], -0.05) and near(moved["lab"], 0.025) and near(moved["lib"], 0.025)
    seat = project.project(
        result(spark, [("con", 400), ("lab", 350), ("lib", 250)]), seats(spark, [("s", "r", 2000)]), change
    ).first()
    assert [p.votes for p in seat.parties] == [350, 375, 275]
    assert (seat.winner, seat.winner_final, seat.majority) == ("lab", "lab", 25)
    second = project.project(
        result(spark, [("con", 200), ("lab", 600), ("lib", 200)]), seats(spark, [("s", "r", 2000)]), change
    ).first()
    assert [p.votes for p in second.parties] == [150, 625, 225] and second.majority == 400


def test_projection_floor(spark):
    seat = swing_seats(spark, [("a", 600), ("b", 390), ("c", 10)], [("r", "a", 0.0), ("r", "b", 0.05), ("r", "c", -0.05)])
    row = seat.first()
    assert [p.votes for p in row.parties] == [576, 423, 1] and row.majority == 153


def test_projection_ladder(spark):
    """Unknown party falls to its floor, an old share of 0 stays 0, a new party gets a positive change only."""
    seat = swing_seats(
        spark, [("a", 900), ("b", 100), ("z", 0)],
        [("r", "a", 0.0), ("r", "z", 0.5), ("r", "n", 0.09), ("r", "m", -0.2), ("r", "other", 0.3)],
    ).first()
    got = {p.party: p.votes for p in seat.parties}
    assert got == {"a": 900, "b": 10, "z": 0, "n": 90, "m": 0}


def test_zero_change_keeps_the_result(spark):
    seat = swing_seats(spark, [("a", 601), ("b", 399)], [("r", "a", 0.0), ("r", "b", 0.0)]).first()
    assert [p.votes for p in seat.parties] == [601, 399]


def test_region_without_polls_does_not_move(spark):
    estimates = inline_table(
        spark,
        {"region": "string", "party": "string", "old_share": "double", "estimate": "double", "had_polls": "boolean"},
        [("r", "a", 0.6, 1.2, True), ("r", "b", 0.4, -0.3, True), ("q", "a", 0.5, None, False), ("q", "b", 0.5, None, False)],
    )
    rows = by(project.regional_change(estimates), "region", "party")
    assert (rows["q", "a"]["change"], rows["q", "b"]["change"]) == (0.0, 0.0)
    assert near(rows["r", "a"]["new_share"], 1.0) and rows["r", "b"]["new_share"] == 0.0


def test_nowcast_over_two_elections_at_once(spark):
    votes = [("con", 400), ("lab", 350), ("others", 250)]
    both = result(spark, votes, "e1").unionByName(result(spark, [("con", 10), ("lab", 990)], "e2"))
    crosswalk = inline_table(spark, {"company": "string", "area": "string", "region": "string"}, [("icm", "All", "r")])
    tables = NowcastDims(dims.pollster(spark), crosswalk, dims.overlap_rules(spark), None, ["con", "lab", "other"])
    rows = by(nowcast(both, seats(spark, [("s", "r", 2000)]),
                      poll(spark, [("All", "con", 30, 100), ("All", "lab", 50, 100), ("All", "other", 20, 100)], "icm"),
                      tables, "2017-06-02"), "election_id")
    assert {p.party: p.votes for p in rows["e1"]["parties"]} == {"con": 300, "lab": 500, "other": 200}
    assert rows["e2"]["winner"] == "lab" and sum(p.votes for p in rows["e2"]["parties"]) == 1000


INPUT = {"scenario_id": "string", "view_id": "string", "region_group": "string", "party": "string", "pct": "double"}


def test_inputs_are_validated(spark):
    df = inline_table(spark, INPUT, [
        ("over", "v", "g", "a", 60.0), ("over", "v", "g", "b", 41.0),
        ("zero", "v", "g", "a", 0.0), ("zero", "v", "g", "b", None),
        ("neg", "v", "g", "a", -3.0), ("neg", "v", "g", "b", 40.126),
    ])
    accepted, rejected = project.validate_inputs(df)
    assert [(r.scenario_id, r.sum_pct) for r in rejected.collect()] == [("over", 101.0)]
    rows = by(accepted, "scenario_id", "party")
    assert set(rows) == {("neg", "a"), ("neg", "b")}
    assert rows["neg", "a"]["pct"] == 0.0 and rows["neg", "b"]["pct"] == 40.13 and near(rows["neg", "b"]["other_pct"], 59.87)


def scenario_setup(spark, n):
    from ballotframe.operators import results

    views = inline_table(spark, {"view_id": "string", "current_id": "string", "previous_id": "string"}, [("v", "e", "e")])
    votes = [("z1", "con", 400), ("z1", "lab", 500), ("z1", "other", 100), ("s", "con", 300), ("s", "lab", 600),
             ("s", "other", 100), ("far", "con", 5), ("far", "lab", 6)]
    placed = seats(spark, [("z1", "r", 1), ("s", "q", 1), ("far", "away", 1)])
    pair = results.election_pair(result(spark, votes), views)
    dense = areas.regional_totals(
        pair.withColumn("votes", F.col("prev_votes")), placed, ["con", "lab", "other"], ["view_id"]
    )
    members = inline_table(spark, {"region_group": "string", "region": "string"}, [("r", "r"), ("q", "q")])
    counted = inline_table(spark, {"region_group": "string", "party": "string"},
                           [(g, p) for g in ("r", "q") for p in ("con", "lab", "other")])
    shares = areas.group_shares(dense, members, counted, ["view_id"])
    inputs = inline_table(spark, INPUT, [
        row for i in range(n) for row in ((f"k{i}", "v", "q", "con", 40.0), (f"k{i}", "v", "q", "lab", 50.0))
    ])
    accepted, _ = project.validate_inputs(inputs)
    return pair, placed, project.scenario_change(accepted, shares)


def test_user_swing(spark):
    """Region 40/50/10 asked to be 50/40/10 moves a 30/60/10 seat to 40/50/10."""
    changes = inline_table(
        spark, {"scenario_id": "string", "view_id": "string", "region": "string", "changes": "string"}, [("k", "v", "q", "")]
    ).withColumn("changes", F.expr(
        "array(named_struct('party', 'con', 'change', 10d), named_struct('party', 'lab', 'change', -10d),"
        " named_struct('party', 'other', 'change', 0d))"))
    pair, placed, _ = scenario_setup(spark, 1)
    row = project.project_inputs(pair, placed, changes).first()
    assert [round(p.votes, 6) for p in row.parties] == [400, 500, 100]
    assert (row.winner, row.majority) == ("lab", 100)


@pytest.mark.parametrize("n", [1, 10, 100])
def test_every_scenario_gives_the_same_as_alone(spark, n):
    pair, placed, changes = scenario_setup(spark, n)
    rows = by(project.project_inputs(pair, placed, changes), "scenario_id", "seat")
    assert set(rows) == {(f"k{i}", "s") for i in range(n)}
    votes = {tuple(round(p.votes, 6) for p in r["parties"]) for r in rows.values()}
    assert votes == {(400.0, 500.0, 100.0)}
    scenarios = changes.select("scenario_id", "view_id").distinct()
    left = project.unchanged_seats(pair, placed, changes, scenarios)
    assert {(r.scenario_id, r.seat) for r in left.collect()} == {(f"k{i}", s) for i in range(n) for s in ("z1", "far")}


def test_nowcast_of_many_dates_equals_single_runs(spark, sf_dir):
    """The scan over days against one plain sum for each date: before, within, between and after the polls."""
    from ballotframe.plans import catalogue
    from ballotframe.plans.nowcast import nowcast, regional_swing
    from ballotframe.sources import bridge

    tables = bridge.result(spark, sf_dir), bridge.seat(spark, sf_dir), bridge.poll(spark, sf_dir), catalogue._dims(spark, sf_dir)
    days = ["2023-12-25", "2024-01-01", "2024-01-10", "2024-01-20", "2024-02-01", "2029-02-01"]
    keep = ["election_id", "region", "party", "had_polls", "change"]

    def rounded(df):
        return sorted((*r[:4], None if r[4] is None else round(r[4], 9)) for r in df.select(*keep).collect())

    many = regional_swing(*tables, days).cache()
    for day in days:
        assert rounded(many.where(F.col("as_of") == day)) == rounded(regional_swing(*tables, day))
    assert not many.where("as_of = '2023-12-25' AND had_polls").count()
    seats = nowcast(*tables, days)
    assert seats.groupBy("election_id", "as_of").count().count() == 2 * len(days)


def test_later_polls_never_count(spark):
    columns = {"company": "string", "fieldwork_date": "string", "n": "bigint"}
    rows = inline_table(spark, columns, [("yougov", "2024-01-05", 1), ("yougov", "2024-01-30", 1)])
    rows = rows.withColumn("fieldwork_date", F.to_date("fieldwork_date"))
    weighted = polls.with_weight(rows, dims.pollster(spark), "2024-01-10").collect()
    assert [str(r.fieldwork_date) for r in weighted] == ["2024-01-05"] and 0 < weighted[0].weight < 1


@pytest.mark.parametrize("decay", [0.7, 1.0, 0.05])
def test_decay_sums_over_long_gaps(spark, decay):
    """Days of three decades, in many blocks, against plain sums."""
    days = [("a", 0, 3.0), ("a", 1, 2.0), ("a", 640, 5.0), ("a", 655, 1.0), ("a", 9000, 4.0), ("b", 7, 1.0), ("b", 30, 0.0)]
    rows = inline_table(spark, {"k": "string", "no": "int", "v": "double"}, days)
    rows = rows.withColumn("day", F.date_add(F.lit("1999-11-01").cast("date"), F.col("no"))).withColumn("p", F.col("v"))
    got = {(r.k, r.no): (r.v, r.p) for r in polls.decay_sums(rows, ["k"], "day", ["v"], ["p"], decay).collect()}
    for k, no, _ in days:
        before = [(no - d, v) for j, d, v in days if j == k and d <= no]
        want = sum(v * decay**age for age, v in before)
        assert got[k, no][0] == pytest.approx(want, rel=1e-12) and got[k, no][1] == sum(v for _, v in before)


def test_no_poll_is_repeated_for_a_date(spark, sf_dir):
    from ballotframe.plans import catalogue

    plan = catalogue.CATALOGUE["nowcast_history"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(generates) == 1 and plan.count("Expand") == 1  # dates for results; parties of the polls
