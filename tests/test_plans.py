"""What the physical plans must and must not contain."""

import re

import pytest

from ballotframe.plans.catalogue import CATALOGUE

QUERIES = CATALOGUE
FORBIDDEN = [
    "CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas",
    "BatchScan python",
]


def plan(df) -> str:
    """Physical plan before adaptive changes (paths in it are cut short, column lists are not)."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert [word for word in FORBIDDEN if word in text] == []


def read_columns(text: str, table: str) -> set[str]:
    found = set()
    for line in text.splitlines():
        if f"/{table}." in line and "FileScan" in line:
            found |= {c.split("#")[0].strip() for c in re.search(r"FileScan parquet \[([^\]]*)\]", line)[1].split(",")}
    return found


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(QUERIES["vote_totals"](spark, sf_dir))
    assert read_columns(text, "lineitem") == {"l_orderkey", "l_suppkey", "l_quantity"}
    assert read_columns(text, "orders") == {"o_orderkey", "o_orderdate", "o_orderpriority"}
    assert read_columns(plan(QUERIES["clean_facts"](spark, sf_dir)), "documents") == {"doc_id", "text"}


def test_election_filter_reaches_the_scan(spark, sf_dir):
    text = plan(QUERIES["battlegrounds"](spark, sf_dir))
    assert re.search(r"DataFilters: \[[^\]]*o_orderdate#\d+ < 1998-01-01 00:00:00\)", text)


@pytest.mark.parametrize("name", ["sample_facts", "challenge_build", "game_outcomes"])
def test_rank_limits_apply_before_the_shuffle(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert re.search(r"WindowGroupLimit .*Partial", text)


@pytest.mark.parametrize("name", ["extract_facts", "clean_facts"])
def test_text_work_needs_no_shuffle_of_its_own(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("Exchange") <= text.count("REPARTITION_BY_NUM")


def test_pages_are_summed_before_they_are_repeated_for_years(spark, sf_dir):
    """Texts that are repeated for ten or a hundred years and only then sorted for their aggregates fill the disk."""
    text = plan(QUERIES["load_facts"](spark, sf_dir))
    assert 0 < text.index("BroadcastHashJoin") < text.index("Aggregate")


def exchanges(df) -> int:
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single)", plan(df)))


def test_packed_seats_are_shuffled_once_per_input(spark, sf_dir):
    """After the votes of a seat are packed, transfers and projections run inside the row."""
    from ballotframe.operators import standdown
    from ballotframe.plans import catalogue

    rules, _ = standdown.validate_rules(catalogue._transfer_rules(spark, sf_dir))
    marked = catalogue._marked(spark, sf_dir)
    alone = exchanges(marked) + exchanges(rules)
    # one to pack the seats, three to pack the rules, at most two for the join
    assert exchanges(standdown.redistribute(marked, rules)) <= alone + 6


@pytest.mark.parametrize("name", ["project_inputs", "project_seats", "redistribute", "extract_facts", "challenge_build",
                                  "seat_documents", "scenario_change"])
def test_computed_arrays_are_not_computed_again_for_a_size_check(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    checks = [line for line in text.splitlines() if re.search(r"(Filter|Join) .*size\((transform|filter|from_json|array_distinct)", line)]
    assert checks == []


@pytest.mark.parametrize(("name", "most"), [("project_inputs", 25), ("unchanged_seats", 25), ("saved_views", 30), ("redistribute", 12)])
def test_spread_joins_do_not_multiply_their_inputs(spark, sf_dir, name, most):
    df = QUERIES[name](spark, sf_dir)
    text = plan(df)
    assert exchanges(df) <= most
    assert len(re.findall(r"FileScan.*/lineitem\.", text)) <= 2 and len(re.findall(r"FileScan.*/events\.", text)) <= 2
