import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from helpers import by, result, seats

from ballotframe.operators import project, results
from ballotframe.plans.challenges import challenges
from ballotframe.sources import dims, documents, fact_files, poll_files, tracker_files
from ballotframe.sources.inline import inline_table

SEATS = {
    "Alpha": {
        "partyInfo": {"labour": {"name": "A. One", "total": 10}, "conservative": {"name": "B. Two", "total": 10, "standing": 0}},
        "seatInfo": {"name": "Alpha", "region": "london", "current": "conservative", "electorate": 40, "majority": 1,
                     "byElection": "May 6th 2021"},
    },
    "Beta O'Hara": {
        "partyInfo": {"others": {"name": "Others", "total": 3}},
        "seatInfo": {"region": "nowhere", "current": "others", "electorate": 9, "majority": 3},
    },
}


def test_seat_documents(spark, tmp_path):
    path = tmp_path / "2019.json"
    path.write_text(json.dumps(SEATS, indent=2))
    seat_rows, result_rows = documents.read_results(spark, str(path), "e2019")
    got = by(documents.with_by_election_date(seat_rows), "seat")
    assert got["Alpha"]["by_election_date"] == dt.date(2021, 5, 6)
    assert (got["Beta O'Hara"]["name"], got["Beta O'Hara"]["by_election"]) == ("Beta O'Hara", None)
    rows = by(result_rows, "seat", "party")
    assert [rows["Alpha", p]["party_ord"] for p in ("labour", "conservative")] == [0, 1]
    assert rows["Alpha", "conservative"]["standing"] == 0 and rows["Alpha", "labour"]["candidate"] == "A. One"
    audit = by(results.audit_seats(seat_rows, result_rows, dims.region(spark)), "seat")
    assert (audit["Alpha"]["winner_ok"], audit["Alpha"]["majority_ok"], audit["Alpha"]["region_ok"]) == (False, False, True)
    assert (audit["Beta O'Hara"]["winner_ok"], audit["Beta O'Hara"]["region_ok"]) == (True, False)


def test_broken_document_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('{"A": {"partyInfo": 5')
    with pytest.raises(Exception):
        documents.read_results(spark, str(path), "e")[1].collect()


def test_results_written_as_lines_are_read_back(spark, tmp_path):
    votes = result(spark, [("s1", "a", 6), ("s1", "b", 4), ("s2", "b", 1)], "e1")
    packed = project.packed_results(votes, seats(spark, [("s1", "r", 20), ("s2", "q", 5)]))
    documents.write_results(packed, str(tmp_path / "out"), ["election_id"])
    seat_rows, rows = documents.read_results(spark, str(tmp_path / "out" / "election_id=e1"), "e1", lines=True)
    assert {(r.seat, r.party, r.votes) for r in rows.collect()} == {("s1", "a", 6), ("s1", "b", 4), ("s2", "b", 1)}
    got = by(seat_rows, "seat")
    assert (got["s1"]["current_declared"], got["s1"]["majority_declared"], got["s2"]["region"]) == ("a", 2, "q")


def test_documents_keep_standing_and_candidates(spark, tmp_path):
    votes = result(spark, [("s1", "labour", 6), ("s1", "other", 4), ("s1", "green", 1)], "e1")
    marked = votes.withColumn("standing", F.when(F.col("party") == "green", 0)).withColumn(
        "candidate", F.when(F.col("party") == "labour", "A. One"))
    documents.write_results(project.packed_results(marked, seats(spark, [("s1", "r", 20)])), str(tmp_path / "out"), ["election_id"])
    _, rows = documents.read_results(spark, str(tmp_path / "out" / "election_id=e1"), "e1", lines=True)
    got = {(r.party, r.candidate, r.votes, r.standing) for r in rows.collect()}
    assert got == {("labour", "A. One", 6, None), ("others", "Other", 4, None), ("green", "Green", 1, 0)}


def test_referendum_documents(spark, tmp_path):
    path = tmp_path / "ref.json"
    path.write_text(json.dumps({"A": {"region": "london", "winner2015": "labour", "current": "remain", "leave": 40.5,
                                      "remain": 59.5}}))
    row = documents.read_referendum(spark, str(path)).first()
    assert (row.seat, row.current, row.leave) == ("A", "remain", 40.5)


HEADER = ["code", "company", "day", "month", "year", "region", "total", *poll_files.FILE_PARTIES]


def poll_file(tmp_path, rows):
    lines = ["\t".join(HEADER)]
    for row in rows:
        cells = {**dict.fromkeys(HEADER, ""), **row}
        lines.append("\t".join(str(cells[c]) for c in HEADER))
    path = tmp_path / "polls.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_poll_files(spark, tmp_path):
    path = poll_file(tmp_path, [
        {"code": 7, "company": "icm", "day": 9, "month": 5, "year": 2015, "region": "Wales", "total": 100, "labour": 40},
        {"code": 7, "company": "late", "day": 1, "month": 6, "year": 2017, "region": "Scotland", "total": 50, "snp": 25},
        {"code": 7, "company": "late", "day": 1, "month": 6, "year": 2017, "region": "Wales", "total": 90, "labour": 41},
        {"code": 8, "company": "orb", "day": 2, "month": 6, "year": 2016, "region": "London", "total": 9, "ukip": 0},
    ])
    polls = poll_files.read_polls(spark, path)
    rows = by(polls, "code", "area", "party")
    assert len(rows) == 3 * len(dims.MODEL_PARTIES)
    wales = rows[7, "Wales", "labour"]
    assert (wales["n"], wales["total"], wales["company"], wales["fieldwork_date"]) == (41, 90, "icm", dt.date(2015, 5, 9))
    assert rows[7, "Scotland", "snp"]["n"] == 25 and rows[7, "Scotland", "labour"]["n"] == 0
    missing = by(poll_files.read_polls(spark, path, blank_as_missing=True), "code", "area", "party")
    assert missing[8, "London", "ukip"]["n"] == 0 and missing[8, "London", "labour"]["n"] is None
    poll_files.save_polls(polls, str(tmp_path / "polls"))
    assert poll_files.load_polls(spark, str(tmp_path / "polls")).count() == polls.count()
    pruned = poll_files.load_polls(spark, str(tmp_path / "polls"), [2016])
    assert {r.code for r in pruned.collect()} == {8}
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().executedPlan().toString()


def test_tracker_documents(spark, tmp_path):
    shares = {p: i + 0.5 for i, p in enumerate(tracker_files.LINES)}
    doc = {"polls": [{"date": [3, 6, 2017], "company": "icm", **shares}],
           "models": [{"date": "06/08/2017", **dict.fromkeys(tracker_files.LINES, 4)}]}
    path = tmp_path / "tracker.json"
    path.write_text(json.dumps(doc))
    points, models = tracker_files.read_tracker(spark, str(path))
    got = by(points, "party")
    assert len(got) == 7 and got["conservative"]["date"] == dt.date(2017, 6, 3) and got["conservative"]["pct"] == 1.5
    assert {(r.date, r.seats) for r in models.collect()} == {(dt.date(2017, 6, 8), 4)}


def test_cards_facts_and_challenges(spark, tmp_path):
    cards = [{"name": "x", "cardClass": "MAGE", "type": "SPELL", "rarity": "RARE", "set": "CORE", "cost": 3, "url": "u"}]
    (tmp_path / "cards.json").write_text(json.dumps(cards))
    row = fact_files.read_cards(spark, str(tmp_path / "cards.json")).first()
    assert (row.card_class, row.race, row.mechanics) == ("MAGE", "", [])
    columns = {"fact_id": "bigint", "year": "int", "era": "string", "timeframe_type": "string", "event": "string",
               "source_page": "string"}
    rows = [(i, 9, "AD", "year", f"The long council of the old city meets for session {i + 500}.", "AD_9") for i in range(4)]
    fact_files.write_facts(inline_table(spark, columns, rows), str(tmp_path / "facts"))
    stored = fact_files.read_facts(spark, str(tmp_path / "facts"))
    assert stored.count() == 4
    fact_files.write_challenges(challenges(stored), str(tmp_path / "challenges"))
    out = spark.read.json(str(tmp_path / "challenges")).first()
    assert (out.y, out.e, out.t, len(out.f)) == (9, "AD", "year", 4)


def test_dimensions(spark):
    assert dims.party(spark).count() == 14 and dims.nation_party(spark).count() == 30
    assert dims.region_group(spark).count() == 9 + 11 + 12 and dims.region(spark).count() == 15
    assert dims.view_def(spark).count() == 11 and dims.referendum_party(spark).count() == 16
    areas = {}
    for row in dims.pollster_area(spark).collect():
        areas.setdefault((row.company, row.area), set()).add(row.region)
    assert areas["icm", "Midlands"] == {"eastmidlands", "westmidlands", "eastofengland"}
    assert areas["yougov2", "Midlands"] == {"eastmidlands", "westmidlands"}
    assert areas["mori", "South"] == {"southeastengland", "southwestengland"}
    assert len(areas["icmmissing", "All"]) == 11 and len(areas["me", "England"]) == 9
    assert areas["comres", "Eastern"] == areas["comres", "East of England"]
    weighted = {r.company for r in dims.pollster(spark).collect()}
    assert {c for c, _ in areas} - weighted == {"general"}
    assert weighted - {c for c, _ in areas} == {"yougovregional"} - {c for c, _ in areas}


def test_labels_of_values_with_quotes(spark):
    row = inline_table(spark, {"a": "string", "d": "date", "b": "boolean"}, [("O'Hara \\ x", "2020-01-02", True)]).first()
    assert (row.a, row.d, row.b) == ("O'Hara \\ x", dt.date(2020, 1, 2), True)
