import pytest
from helpers import by, near, result

from ballotframe.operators import choropleth, facets, guesses, referendum, results
from ballotframe.sources.inline import inline_table

VIEW = {"view_id": "string", "current_id": "string", "previous_id": "string"}


def shares(spark, values):
    """One seat per value: the party's share of 100 votes."""
    rows = [row for i, v in enumerate(values) for row in ((f"s{i}", "a", v), (f"s{i}", "b", 100 - v))]
    return results.election_pair(result(spark, rows, "cur"), inline_table(spark, VIEW, [("v", "cur", "prev")]))


@pytest.mark.parametrize("values,top,expected", [([30, 45], 0.45, [2 / 3, 1.0]), ([70, 30], 0.6, [1.0, 0.5])])
def test_share_intensity(spark, values, top, expected):
    rows = by(choropleth.choropleth(shares(spark, values), "a"), "seat")
    for i, want in enumerate(expected):
        assert near(rows[f"s{i}"]["intensity"], want) and near(rows[f"s{i}"]["max_value"], top)


def test_change_is_capped_on_both_sides_and_filtered_seats_are_zero(spark):
    rows = [("s0", "a", 90), ("s0", "b", 10), ("s1", "a", 5), ("s1", "b", 95), ("s2", "a", 50), ("s2", "b", 50)]
    before = [("s0", "a", 10), ("s0", "b", 90), ("s1", "a", 95), ("s1", "b", 5), ("s2", "a", 20), ("s2", "b", 80)]
    both = result(spark, rows, "cur").unionByName(result(spark, before, "prev"))
    pair = results.election_pair(both, inline_table(spark, VIEW, [("v", "cur", "prev")]))
    flags = inline_table(spark, {"view_id": "string", "seat": "string", "filtered": "boolean"},
                         [("v", "s0", True), ("v", "s1", True), ("v", "s2", False)])
    out = by(choropleth.choropleth(pair, "a", "change", flags), "seat")
    assert (out["s0"]["intensity"], out["s1"]["intensity"], out["s2"]["intensity"]) == (1.0, -1.0, 0.0)
    assert out["s1"]["sign_class"] == "minus"


def test_referendum_intensity_and_tally(spark):
    df = inline_table(spark, {"seat": "string", "region": "string", "winner2015": "string", "leave": "double", "remain": "double"},
                      [("a", "r", "p", 65.0, 35.0), ("b", "r", "q", 40.0, 60.0)])
    df = referendum.with_outcome(df)
    rows = by(referendum.with_ref_intensity(df), "seat")
    assert near(rows["a"]["intensity"], 1.0) and near(rows["b"]["intensity"], 2 / 3)
    tally = referendum.referendum_tally(df).first()
    assert (tally.total, tally.remain_seats, tally.leave_seats) == (2, 1, 1)
    assert [r.seat for r in referendum.filter_referendum(df, leave=(50, 65), winner2015=["p"]).collect()] == ["a"]


def test_card_facets(spark):
    cards = inline_table(
        spark,
        {"name": "string", "card_class": "string", "type": "string", "rarity": "string", "race": "string",
         "card_set": "string", "cost": "int", "mech": "string"},
        [("a", "MAGE", "SPELL", "RARE", "", "CORE", 9, "TAUNT CHARGE"), ("b", "MAGE", "MINION", "EPIC", "DRAGON", "TGT", 2, "TAUNT"),
         ("c", "DRUID", "MINION", "FREE", "BEAST", "OG", 0, "")],
    ).selectExpr("*", "split(mech, ' ') as mechanics")
    cards = facets.with_mode(cards)
    names = lambda sel, mech=None: sorted(r["name"] for r in facets.facet_filter(cards, sel, mech).collect())
    assert names(facets.DEFAULT_SELECTIONS) == ["a", "c"]
    both = facets.toggle(facets.DEFAULT_SELECTIONS, "mode", "wild")
    assert names(both) == ["a", "b", "c"] and names(both, "TAUNT") == ["a", "b"]
    assert names(facets.toggle(both, "cost", "7plus")) == ["b", "c"]
    assert names(facets.select_all(False)) == [] and names(facets.select_all(True)) == ["a", "b", "c"]


GUESSES = [
    ("g1", 44, "BC", "year", 10, "AD", 53, False, "41-200"),
    ("g2", 1, "BC", "year", 1, "AD", 1, False, "1-2"),
    ("g3", 560, "BC", "decade", 565, "BC", 5, True, "correct"),
    ("g4", 1800, "BC", "century", 1705, "BC", 95, True, "correct"),
    ("g5", 1066, "AD", "year", 66, "AD", 1000, False, "200-1000"),
    ("g6", 1066, "AD", "year", 65, "AD", 1001, False, "over 1000"),
]


def test_guess_distance(spark):
    targets = inline_table(spark, {"game_id": "string", "year": "int", "era": "string", "timeframe_type": "string"},
                           [g[:4] for g in GUESSES])
    made = inline_table(spark, {"game_id": "string", "attempt": "int", "guess_year": "int", "guess_era": "string"},
                        [(g[0], 1, g[4], g[5]) for g in GUESSES])
    rows = by(guesses.score_guesses(made, targets), "game_id")
    for g in GUESSES:
        row = rows[g[0]]
        assert (row["distance"], row["is_win"], row["band"]) == g[6:]


def test_game_ends_at_win_or_eighth_guess(spark):
    columns = {"game_id": "string", "attempt": "int", "distance": "int", "is_win": "boolean"}
    rows = [("won", i, 10 - i, i in (3, 5)) for i in range(1, 7)]
    rows += [("late", i, 20 - i, i == 9) for i in range(1, 11)]
    rows += [("open", i, 4, False) for i in range(1, 4)]
    out = by(guesses.game_outcomes(inline_table(spark, columns, rows)), "game_id")
    assert (out["won"]["won"], out["won"]["attempts_used"], out["won"]["lost"]) == (True, 3, False)
    assert (out["late"]["won"], out["late"]["attempts_used"], out["late"]["lost"]) == (False, 8, True)
    assert (out["open"]["won"], out["open"]["attempts_used"], out["open"]["lost"]) == (False, 3, False)
