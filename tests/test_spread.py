from helpers import result, seats

from ballotframe.operators import filters, results
from ballotframe.operators.spread import spread_join
from ballotframe.sources.inline import inline_table
from pyspark.sql import functions as F


def hot(spark, n, value):
    """Two thirds of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(99))
    return spark.range(n).select(key.alias("k"), F.col("id").alias(value))


def test_spread_join_equals_a_plain_join(spark):
    many, few = hot(spark, 600, "a"), hot(spark, 60, "b").where("k <> 3")
    for how in ("inner", "left"):
        want = sorted(map(tuple, many.join(few, ["k"], how).select("k", "a", "b").collect()), key=str)
        for rows in (10, 100_000):
            got = sorted(map(tuple, spread_join(many, few, ["k"], ["a"], how, rows).select("k", "a", "b").collect()), key=str)
            assert got == want


def test_a_hot_key_is_spread_by_its_rows(spark):
    joined = spread_join(hot(spark, 600, "a"), hot(spark, 60, "b"), ["k"], ["a"], rows=10)
    assert joined.count() == hot(spark, 600, "a").join(hot(spark, 60, "b"), "k").count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Join" in line:
            assert "_salt" in line or "BroadcastHashJoin" in line
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(k" in x]
    assert all("_salt" in x for x in exchanges)
    assert plan.count("FileScan") >= 2  # the large side and its hot keys are read, not computed again


def test_without_hot_keys_it_is_a_plain_join(spark):
    joined = spread_join(hot(spark, 600, "a"), hot(spark, 60, "b"), ["k"], ["a"])
    assert "_salt" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_a_key_stay_in_a_left_join(spark):
    many = spark.range(3).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id").alias("a"))
    few = spark.range(2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("b"))
    rows = spread_join(many, few, ["k"], ["a"], "left", 1).select("a", "b").collect()
    assert sorted(map(tuple, rows)) == [(0, None), (1, 10), (2, None)]


VIEW = {"view_id": "string", "current_id": "string", "previous_id": "string"}


def test_battleground_links_and_default_view(spark):
    votes = result(spark, [("s1", "a", 52), ("s1", "b", 48)], "cur").unionByName(
        result(spark, [("s1", "a", 40), ("s1", "b", 60)], "prev"))
    pair = results.election_pair(votes, inline_table(spark, VIEW, [
        ("election2024", "cur", "prev"), ("election2017", "cur", "prev")]))
    links = inline_table(spark, {"link_id": "string", "url": "string"}, [
        ("held_now", "http://m/?map=election2017&incumbent=a&challenger=b"),
        ("held_before", "http://m/?map=election2017&incumbent=b&challenger=a&majhigh=50"),
        ("default", "http://m/?incumbent=b&challenger=a&majhigh=20&region=r"),
        ("same", "http://m/?incumbent=b&challenger=b&majhigh=90"),
        ("too_far", "http://m/?incumbent=b&challenger=a&majhigh=19&majlow=-5"),
    ])
    groups = inline_table(spark, {"region_group": "string", "region": "string"}, [("g", "r")])
    found = filters.match_battlegrounds(filters.parse_links(links), pair, seats(spark, [("s1", "r", 1)]), groups)
    assert sorted((r.link_id, r.seat) for r in found.collect()) == [("default", "s1"), ("held_now", "s1")]


def test_equal_links_are_one_class(spark):
    links = inline_table(spark, {"link_id": "string", "url": "string"}, [
        (f"l{k}", f"http://m/?map=election2017&incumbent=A&majhigh={k % 2}") for k in range(6)
    ] + [("other", "http://m/?map=election2017&majhigh=1"), ("l0", "http://m/?incumbent=a&majhigh=0&map=election2017")])
    classes, members = filters.link_classes(filters.parse_links(links))
    assert classes.count() == 3 and members.count() == 7
    found = members.join(classes.withColumnRenamed("link_id", "class_id"), "class_id").select("link_id", "hi").collect()
    assert {(r.link_id, r.hi) for r in found} == {*((f"l{k}", float(k % 2)) for k in range(6)), ("other", 1.0)}
