import hashlib
from collections import Counter

import numpy as np
import oracle_check
import pytest
from pyspark.sql import functions as F

from ballotframe.llm import catalogue, sharded_lloyd
from ballotframe.llm.sharded_lloyd import LloydParams


def test_matches_sql_on_whole_table(spark, sf_dir):
    con = oracle_check.duck(sf_dir)
    assert oracle_check.compare(catalogue.op13_sharded_lloyd(spark, sf_dir), con, sharded_lloyd.ORACLE) is None


def brute(rows, p):
    kept = [(i, [int(np.floor(p.scale * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == p.dims and all(x is not None and np.isfinite(x) and abs(x) < p.limit for x in v)]
    key = lambda r: (hashlib.sha256(f"{p.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[: p.clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), k) for k, c in enumerate(centroids))
    for _ in range(p.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), names[k]) for i, k, d in found)


@pytest.mark.parametrize("p", [LloydParams(clusters=5, rounds=4, dims=6, shards=4, block_rows=7), LloydParams(clusters=3, rounds=2, dims=6, shards=1)])
def test_ties_odd_vectors_and_repeated_rows(spark, p):
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(90)]  # many ties and equal vectors
    rows += [(7, rows[7][1])] * 30 + [(None, [1.0] * 6), (None, [1.5] * 6), (200, None), (201, [1.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, [1e300] * 6), (206, [131071.5, -131071.9, 0.0, 0.0, 0.0, 0.0]), (207, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    got = Counter(map(tuple, sharded_lloyd.cluster_report(df.repartition(5), p).collect()))
    assert got == brute(rows, p)


def test_fewer_vectors_than_clusters_and_none(spark):
    p = LloydParams(dims=2)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted(r.distance for r in sharded_lloyd.cluster_report(df, p).collect()) == [0, 0]
    none = sharded_lloyd.cluster_report(df.where("false"), p)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_blocks_are_not_shuffled_in_a_round(spark):
    p = LloydParams(dims=2, shards=2)
    df = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    cut, _ = sharded_lloyd.blocks(sharded_lloyd.usable(df, p), p)
    cut = sharded_lloyd.bucketed(cut, spark)
    found = sharded_lloyd.assign(cut, np.zeros((3, 2), np.int64), p)
    plan = cut.join(found.hint("merge"), "row_block")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_shards_cover_all_columns():
    p = LloydParams(dims=10, shards=4)
    assert [c.stop - c.start for c in sharded_lloyd.columns_of(p)] == [2, 3, 2, 3]
    x, slices = np.arange(30).reshape(3, 10), np.ones((2, 10), np.int64)
    parts = [sharded_lloyd.partial_distances(np.ascontiguousarray(x[:, c]).astype("<i8").tobytes(), 3, slices[:, c]) for c in sharded_lloyd.columns_of(p)]
    assert (sum(parts) == ((x[:, None] - slices) ** 2).sum(2)).all()
