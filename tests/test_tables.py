import hashlib
import uuid
from pathlib import Path

import pytest
from helpers import by, result
from pyspark.sql import functions as F

from ballotframe.operators import results, tracker
from ballotframe.plans.catalogue import CATALOGUE
from ballotframe.sources import poll_files, tables
from ballotframe.sources.inline import inline_table
from ballotframe.storage import shared_folder, with_ordinal

POLL = {"code": "bigint", "company": "string", "fieldwork_date": "date", "area": "string", "party": "string", "n": "bigint", "total": "bigint"}
FACT = {"digest": "string", "fact_id": "string", "year": "int", "era": "string", "timeframe_type": "string", "event": "string"}
LONG = "The long council of the old city meets for session {}."


def files(folder: Path) -> dict[str, str]:
    return {str(f): hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(folder.rglob("*.parquet"))}


def test_writing_one_year_leaves_the_others_byte_for_byte(spark, tmp_path):
    rows = [(1, "icm", "2015-05-01", "a", "p", 5, 9), (2, "icm", "2016-05-01", "a", "p", 6, 9), (3, "icm", "2016-06-01", "a", "p", 7, 9)]
    path = str(tmp_path / "polls")
    poll_files.save_polls(inline_table(spark, POLL, rows), path)
    before = files(tmp_path / "polls" / "year=2015")
    poll_files.save_polls(inline_table(spark, POLL, [(4, "mori", "2016-07-01", "a", "p", 8, 9)]), path)
    assert {r.code for r in poll_files.load_polls(spark, path).collect()} == {1, 4}
    poll_files.upsert_polls(inline_table(spark, POLL, [(4, "mori", "2016-07-01", "a", "p", 80, 90), (5, "me", "2017-01-01", "b", "p", 1, 2)]), path)
    poll_files.upsert_polls(inline_table(spark, POLL, [(6, "me", "2016-01-01", "b", "p", 1, 2)]), path)
    got = {(r.code, r.n) for r in poll_files.load_polls(spark, path).collect()}
    assert got == {(1, 5), (4, 80), (5, 1), (6, 1)}
    assert files(tmp_path / "polls" / "year=2015") == before


def test_stored_results_are_compared_without_a_shuffle_by_seat(spark, sf_dir):
    text = CATALOGUE["stored_compare"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "Bucketed: true" in text


def test_results_are_loaded_by_election(spark):
    rows = result(spark, [("s1", "a", 6), ("s1", "b", 4), ("s2", "b", 1)], "e1").unionByName(result(spark, [("s1", "b", 9)], "e2"))
    name = f"results_{uuid.uuid4().hex}"
    tables.save_results(rows, name, 3)
    one = tables.load_results(spark, name, ["e2"])
    assert [tuple(r) for r in one.collect()] == [("e2", "s1", "b", 9, 0)]
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()
    both = by(results.winners(tables.load_results(spark, name)), "election_id", "seat")
    assert {k: v["winner"] for k, v in both.items()} == {("e1", "s1"): "a", ("e1", "s2"): "b", ("e2", "s1"): "b"}


def page_facts(spark, pages):
    rows = [(d, f"{d}:{k}", 9, "AD", "year", LONG.format(k + 500) if k else "short") for d, n in pages for k in range(n)]
    return inline_table(spark, FACT, rows)


def test_pages_are_cleaned_when_first_seen(spark, tmp_path):
    path = str(tmp_path / "clean")
    first = tables.add_cleaned_facts(page_facts(spark, [("d1", 3), ("d2", 2)]), path)
    assert (first["AD_year_raw"], first["AD_year_kept"]) == (5, 3)
    before = files(tmp_path / "clean" / "facts")
    again = tables.add_cleaned_facts(page_facts(spark, [("d1", 3), ("d3", 2)]), path)
    assert (again["AD_year_raw"], again["AD_year_kept"]) == (2, 1)
    assert sum(tables.add_cleaned_facts(page_facts(spark, [("d1", 3), ("d2", 2)]), path).values()) == 0
    assert before.items() <= files(tmp_path / "clean" / "facts").items()
    assert tables.cleaned_facts(spark, path).count() == 7
    current = inline_table(spark, {"digest": "string"}, [("d1",), ("d3",)])
    assert {r.digest for r in tables.cleaned_facts(spark, path, current).collect()} == {"d1", "d3"}
    report = tables.observed_report(spark, first).collect()
    assert [tuple(r) for r in report] == [("AD", "year", 5, 3, 2, 60.0)]


def test_a_run_that_died_before_its_digests_has_added_nothing(spark, tmp_path):
    path = str(tmp_path / "clean")
    tables.add_cleaned_facts(page_facts(spark, [("d1", 3)]), path)
    lost = tables.cleaned_facts(spark, path)
    lost.write.parquet(f"{path}/facts/batch=dead")
    assert tables.cleaned_facts(spark, path).count() == 3
    tables.add_cleaned_facts(page_facts(spark, [("d2", 1)]), path)
    assert tables.cleaned_facts(spark, path).count() == 4


def test_documents_are_scanned_once_for_the_cleaned_table(spark, sf_dir):
    """What follows the cleaned table reads no documents any more."""
    for name in ("challenge_build", "fact_report", "challenge_counts"):
        assert "documents." not in CATALOGUE[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_rejected_cells(spark):
    columns = dict.fromkeys(["code", "company", "day", "month", "year", "region", "total", "labour", "green"], "string")
    raw = inline_table(spark, columns, [("7", "icm", "3", "6", "2017", "W", "10", "4", ""), ("x", "icm", "31", "2", "2017", "W", "1e3", " 5 ", "6a"),
                                        ("8", "icm", None, "6", "2017", "W", None, None, "1.5")])
    found = {(r.code, r.cell, r.value, r.reason) for r in poll_files.poll_rejects(raw, ["code"], ["labour", "green"]).collect()}
    number = "not a whole number"
    assert found == {("x", "code", "x", number), ("x", "total", "1e3", number), ("x", "green", "6a", number), ("x", "date", "2017-2-31", "not a date"),
                     ("8", "green", "1.5", number), ("8", "date", "2017-6-", "not a date")}


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_row_numbers_over_ranges(spark, keys):
    """Two thirds of the rows are equal in the order; they are spread over ranges and numbered all the same."""
    rows = spark.range(3000).select((F.col("id") % 4).alias("k"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("v"), "id")
    rows = rows.withColumn("k", F.when(F.col("k") < 3, F.col("k"))).repartition(6)
    out = with_ordinal(rows, [F.desc("v")], "no", keys).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.k if keys else None, []).append((r.no, r.v))
    assert len(out) == 3000 and len(groups) == (4 if keys else 1)
    for found in groups.values():
        found.sort()
        assert [no for no, _ in found] == list(range(1, len(found) + 1))
        assert [v for _, v in found] == sorted((v for _, v in found), reverse=True)
    assert not with_ordinal(rows.where("false"), [F.desc("v")], "no", keys).count()


def test_moving_average_with_one_busy_day_and_equal_codes(spark):
    rows = [("a", f"2024-01-{1 + k // 100:02d}" if k < 200 else "2024-01-03", k if k < 200 else 5, 2.0) for k in range(500)]
    points = inline_table(spark, {"party": "string", "fieldwork_date": "date", "code": "int", "pct": "double"}, [*rows, ("b", "2024-01-01", 1, 4.0)])
    moved = tracker.moving_average(points, n=12, block_rows=20).collect()
    assert len(moved) == 501 and {r.moving for r in moved} == {2.0, 4.0}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        shared_folder(Session)
