import numpy as np
import oracle_check
import pytest
from pyspark.sql import functions as F

from ballotframe.llm import block_ann, catalogue
from ballotframe.llm.block_ann import BlockParams


def test_matches_sql_on_whole_table(spark, sf_dir):
    con = oracle_check.duck(sf_dir)
    assert oracle_check.compare(catalogue.op8_block_ann(spark, sf_dir), con, block_ann.ORACLE) is None


def brute(rows, k):
    some = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            some[i] = min(some.get(i, v), v)
    out = []
    for q, v in some.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in some.items() if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("params", [BlockParams(k=5, candidate_rows=30, query_rows=4, rows_at_once=3), BlockParams(k=400)])
def test_blocks_ties_and_odd_vectors(spark, params):
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(200)]  # many ties and zeros
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 1.0]), (260, [float("nan")] * 6), (280, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(300, [1.0, 2.0]), (301, [1e150, 1e-150, 0.0, 0.0, 1.0, 1.0]), (302, [1e-200] * 6), (320, []), (0, rows[0][1]), (1, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("cb", F.lit(1))
    got = sorted(map(tuple, block_ann.nearest(df, F.col("vec_id") % 20 == 0, params).collect()))
    want = brute(rows, params.k)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want])


def test_bounds_hold_and_recall_is_whole(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 32))
    codes, scale, norm, lost = block_ann.quantise(x)
    near = block_ann.product(codes, codes) * scale[:, None] * scale
    slack = lost[:, None] * np.linalg.norm(x, axis=1) + norm[:, None] * lost
    assert (np.abs(near - x @ x.T) <= slack + 1e-9).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert block_ann.nearest(df, F.col("vec_id") % 20 == 0).count() == 0
