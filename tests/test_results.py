import pytest
from helpers import by, near, result, seats

from ballotframe.operators import areas, filters, results
from ballotframe.operators import seats as seat_ops
from ballotframe.sources.inline import inline_table
from pyspark.sql import functions as F

BY_ELECTION = [("conservative", 15529), ("labour", 8589), ("libdems", 349), ("green", 358), ("others", 5108)]


def pair_of(spark, current, previous):
    views = inline_table(
        spark, {"view_id": "string", "current_id": "string", "previous_id": "string"}, [("v", "cur", "prev")]
    )
    both = result(spark, current, "cur").unionByName(result(spark, previous, "prev"))
    return results.election_pair(both, views)


def test_winner_shares_and_turnout(spark):
    row = results.winners(result(spark, BY_ELECTION)).first()
    assert (row.winner, row.runner_up, row.majority, row.turnout) == ("conservative", "labour", 6940, 29933)
    summary = results.seat_summary(
        pair_of(spark, [("s", *r) for r in BY_ELECTION], [("s", "labour", 10)]), seats(spark, [("s", "r", 70100)])
    ).first()
    assert round(summary.turnout_pct, 2) == 42.70
    assert (summary.winner, summary.prev_winner) == ("conservative", "labour")
    shares = results.with_shares(result(spark, BY_ELECTION)).collect()
    assert near(sum(r.share_pct for r in shares), 100.0)


def test_ties_go_to_the_earlier_party(spark):
    row = results.winners(result(spark, [("b", 5), ("a", 5), ("c", 1)])).first()
    assert (row.winner, row.runner_up, row.majority) == ("b", "a", 0)


def test_lone_party_leads_by_all_its_votes(spark):
    row = results.winners(result(spark, [("a", 7)])).first()
    assert (row.majority, row.runner_up) == (7, None)


def test_fold_others(spark):
    rows = by(results.fold_others(result(spark, [("other", 3), ("others", 4), ("a", 1)])), "party")
    assert rows["other"]["votes"] == 7 and set(rows) == {"other", "a"}


@pytest.mark.parametrize(
    "votes,expected",
    [
        ([("a", 100), ("libdems", 10), ("others", 6)], {"a": 100.0, "libdems": 14.0}),
        ([("a", 100), ("others", 6)], {"a": 100.0, "libdems": 3.0}),
        ([("a", 100)], {"a": 100.0, "libdems": 0.0}),
    ],
)
def test_adjust_seats(spark, votes, expected):
    columns = {
        "seat": "string", "party": "string", "factor": "double", "seed_from": "string", "seed_share": "double",
        "drop_party": "string",
    }
    rules = inline_table(spark, columns, [("s", "libdems", 1.4, "others", 0.5, "others")])
    rows = by(results.adjust_seats(result(spark, votes), rules), "party")
    assert {p: r["votes"] for p, r in rows.items()} == pytest.approx(expected)


def test_compare_zero_for_other_and_absent(spark):
    rows = by(results.compare(pair_of(spark, [("a", 60), ("other", 40)], [("b", 70), ("other", 30)])), "party")
    assert near(rows["a"]["change_pct"], 60.0) and rows["a"]["prev_share_pct"] == 0
    assert rows["other"]["change_pct"] == 0 and rows["a"]["gain"] is True
    assert set(rows) == {"a", "other"}


def test_overrides_replace_whole_seats(spark):
    base = result(spark, [("A", "x", 1), ("B", "x", 2), ("B", "y", 3)])
    override = result(spark, [("B", "z", 9), ("C", "x", 4)])
    merged, unmatched = results.apply_overrides(base, override)
    assert sorted((r.seat, r.party, r.votes) for r in merged.collect()) == [("A", "x", 1), ("B", "z", 9)]
    assert [(r.seat, r.votes) for r in unmatched.collect()] == [("C", 4)]


def test_overrides_leave_other_elections_alone(spark):
    columns = {"election_id": "string", "seat": "string", "party": "string", "votes": "bigint"}
    base = inline_table(spark, columns, [("e1", "A", "x", 1), ("e2", "A", "x", 2), ("e2", "B", "y", 3)])
    override = inline_table(spark, columns, [("e1", "A", "z", 9), ("e1", "B", "z", 8)])
    merged, unmatched = results.apply_overrides(base, override)
    assert sorted(map(tuple, merged.collect())) == [("e1", "A", "z", 9), ("e2", "A", "x", 2), ("e2", "B", "y", 3)]
    assert [tuple(r) for r in unmatched.collect()] == [("e1", "B", "z", 8)]


def test_overall_majority(spark):
    def house(leader):
        rows = [("v", f"s{i}", "a" if i < leader else f"o{i % 3}") for i in range(650)]
        return inline_table(spark, {"view_id": "string", "seat": "string", "winner": "string"}, rows)

    won = areas.overall_majority(house(412), ["view_id"]).first()
    assert (won.leader, won.overall_majority, won.hung) == ("a", 174, False)
    hung = areas.overall_majority(house(325), ["view_id"]).first()
    assert (hung.leader, hung.overall_majority, hung.hung) == (None, None, True)


def test_battleground_bounds(spark):
    base = result(spark, [("s1", "a", 400), ("s1", "b", 350), ("s1", "c", 250), ("s2", "a", 400), ("s2", "c", 600)])

    def found(*args, **kw):
        return [r.seat for r in filters.battlegrounds(base, *args, **kw).collect()]

    assert found("a", "b", 0, 10) == ["s1"]
    assert found("a", "b", 6, 10) == []
    assert found("c", "b", 0, 100) == []  # the challenger does not stand in s2
    assert sorted(found("a", "a")) == ["s1", "s2"] == sorted(found(None, "b"))


def test_filter_and_complement_give_the_input(spark):
    rows = results.seat_summary(
        pair_of(spark, [("s1", "a", 60), ("s1", "b", 40), ("s2", "b", 9), ("s2", "a", 1)],
                [("s1", "a", 60), ("s2", "a", 60)]),
        seats(spark, [("s1", "r1", 200), ("s2", "r2", 200)]).withColumn("by_election", F.lit(None).cast("string")),
    )
    marked = by(filters.filter_seats(rows, mark=True, winner="a", majority=(0, 30)), "seat")
    assert marked["s1"]["filtered"] is True and marked["s2"]["filtered"] is False
    assert [r.seat for r in filters.filter_seats(rows, gains=True).collect()] == ["s2"]
    assert filters.filter_seats(rows, by_election=True).count() == 0


def test_vote_totals_merge_others_and_total(spark):
    pair = pair_of(
        spark,
        [("s1", "a", 60), ("s1", "others", 40), ("s2", "b", 70), ("s2", "other", 30)],
        [("s1", "b", 50), ("s1", "a", 50), ("s2", "b", 100)],
    )
    groups = inline_table(spark, {"region_group": "string", "region": "string"}, [("g", "r1"), ("g", "r2")])
    placed = seats(spark, [("s1", "r1", 200), ("s2", "r2", 200)])
    rows = by(areas.vote_totals(pair, placed, areas.area_map(groups, placed.select("region"))), "area", "party")
    total = rows["g", "total"]
    assert (total["seats"], total["votes"], total["seat_change"], total["vote_pct"]) == (2, 200, None, None)
    assert (rows["g", "other"]["votes"], rows["g", "other"]["vote_pct"]) == (70, 35.0)
    assert (rows["g", "a"]["seats"], rows["g", "a"]["seat_change"], rows["g", "a"]["vote_pct_change"]) == (1, 1, 5.0)
    assert ("r1", "b") not in rows and rows["unitedkingdom", "total"]["votes"] == 200


def test_extended_seats_keep_absent_parties_null(spark):
    row = seat_ops.extended_seats(pair_of(spark, [("conservative", 60), ("snp", 30), ("sdlp", 10)], [("snp", 1)])).first()
    assert (row.con_pct, row.nat_pct, row.lab_pct, row.oth_pct) == (60.0, 40.0, None, None)


def test_seat_baseline_counts_missing_sides(spark):
    won = inline_table(
        spark, {"view_id": "string", "region": "string", "winner": "string", "seats": "bigint"}, [("v", "london", "labour", 50)]
    )
    from ballotframe.sources import dims

    rows = by(areas.seat_change_vs_baseline(won, dims.seats_baseline(spark)), "party")
    assert rows["labour"]["seat_change"] == 1 and rows["conservative"]["seat_change"] == -21


def test_saved_view_links(spark):
    links = inline_table(spark, {"link_id": "string", "url": "string"}, [
        ("all", "http://m/?map=v"),
        ("gains", "http://m/?map=v&gains=yes"),
        ("grouped", "http://m/?map=v&incumbent=A&region=England&majlow=1.5&majhigh=x"),
        ("narrow", "http://m/?map=v&majlow=19.9&majhigh=20"),
        ("inverted", "http://m/?map=v&majlow=60&majhigh=20"),
        ("other_map", "http://m/?map=w"),
    ])
    rows = inline_table(
        spark,
        {"view_id": "string", "seat": "string", "winner": "string", "prev_winner": "string", "by_election": "string",
         "region": "string", "majority_pct": "double"},
        [("v", "s1", "a", "a", None, "london", 20.0), ("v", "s2", "b", "a", None, "wales", 100.0),
         ("v", "s3", "a", None, None, "wales", 0.0)],
    )
    groups = inline_table(spark, {"region_group": "string", "region": "string"}, [("england", "london")])
    found = filters.match_views(filters.parse_links(links), rows, groups).collect()
    assert sorted((r.link_id, r.seat) for r in found) == [
        ("all", "s1"), ("all", "s2"), ("all", "s3"), ("gains", "s2"), ("grouped", "s1"), ("narrow", "s1"),
    ]
