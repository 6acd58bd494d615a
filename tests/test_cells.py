"""The vector index gives what a comparison with every vector gives, and reads fewer cells."""

import numpy as np
from pyspark.sql import functions as F

from memlake.operators import cells as cx, vectors as vx
from memlake.operators.index import top

DIM = 8


def _table(spark, n=600):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, DIM)) * 4
    rows = [(i, (centres[i % 12] + rng.standard_normal(DIM) * 0.3).tolist(), i % 5) for i in range(n)]
    rows += [(n + i, rows[7][1], 9) for i in range(200)]  # one vector many times
    return rows, rng


def test_nearest_is_exact_and_skips_cells(spark, tmp_path):
    rows, rng = _table(spark)
    odd = [(5000, None, 0), (5001, [0.0] * DIM, 0), (5002, [1.0] * (DIM - 1), 0), (5003, [float("nan")] * DIM, 0), (5004, [None] * DIM, 0)]
    schema = "vec_id long, embedding array<double>, label int"
    index = cx.build(spark.createDataFrame(rows + odd, schema), "vec_id", "embedding", DIM, str(tmp_path / "cells"), cells=24)
    queries = spark.createDataFrame([(i, v[1]) for i, v in enumerate(rows[:9])] + [(100, rng.standard_normal(DIM).tolist())], "q int, v array<double>")
    assert index.members.count() == len(rows)
    for k, floor in ((1, None), (10, None), (250, None), (10, 0.98), (10_000, None)):
        want = top(vx.similar(spark.createDataFrame(rows, schema), queries, "embedding", "v", DIM, floor=floor), ["q"], [F.desc("score"), F.asc("vec_id")], k)
        got = cx.nearest(index, queries, ["q"], "v", "vec_id", k, floor)
        columns = ["q", "vec_id", "label", "score", "pos"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    met = cx.bounds(index, queries, "v", 10)
    best = met.where("first").count()
    assert best < 60 and met.count() == 10 * index.cells.count()
    plan = cx.nearest(index, queries, ["q"], "v", "vec_id", 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_queries_and_empty_tables(spark, tmp_path):
    rows, _ = _table(spark, 30)
    schema = "vec_id long, embedding array<double>, label int"
    index = cx.build(spark.createDataFrame(rows, schema), "vec_id", "embedding", DIM, str(tmp_path / "cells"))
    odd = spark.createDataFrame([(1, None), (2, [0.0] * DIM), (3, [1.0])], "q int, v array<double>")
    assert cx.nearest(index, odd, ["q"], "v", "vec_id", 3).collect() == []
    empty = cx.build(spark.createDataFrame([], schema), "vec_id", "embedding", DIM, str(tmp_path / "none"))
    one = spark.createDataFrame([(1, [1.0] * DIM)], "q int, v array<double>")
    assert cx.nearest(empty, one, ["q"], "v", "vec_id", 3).collect() == []
