"""No cap, prefix or null loses rows: each case here once did."""

import pytest
from pyspark.sql import functions as F

from memlake.operators import graph as gr, metrics as mt, ordered as od, policy as po, recall as rc
from memlake.session import shared_dir


def test_null_keys_and_blocks_stay(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, 1, 2), (None, None, 3), ("a", None, 4), (None, 1, 5)], "k string, b int, v long")
    got = od.running(df, ["k"], ["b", "v"], F.col("b"), {"s": ("sum", F.col("v"), True), "p": ("lag", F.col("v"), False)}).collect()
    assert sorted((r.k or "", r.b or 0, r.v, r.s, r.p) for r in got) == [("", 0, 3, 3, None), ("", 1, 2, 5, 3), ("", 1, 5, 10, 2), ("a", 0, 4, 4, None), ("a", 1, 1, 5, 4)]


def test_order_statistics_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    got = {r.g: (r.n, r.top) for r in od.value_at_index(df, ["g"], "v", F.lit(0), {"top": F.col("n") - 1}).collect()}
    assert got == {None: (2, 3.0), "a": (1, 2.0)}


def test_every_grant_and_control_counts(spark):
    rules = [("x*", ["host", "model"], False)] * 1099 + [("x*", ["model"], False)]
    one = spark.range(1).select(F.lit("x").alias("p"))
    assert one.select(po.audiences(F.col("p"), [], rules).alias("a")).first().a == ["model"]
    sets = F.array_append(F.array_repeat(F.array(F.lit("host"), F.lit("model")), 100_002), F.array(F.lit("host")))
    assert one.select(po.artifact_audiences(F.lit(True), sets).alias("a")).first().a == ["host"]


def test_chains_have_no_depth_limit(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "node long, need long")
    nodes, none = spark.range(21).withColumnRenamed("id", "node"), spark.createDataFrame([], "node long, target long")
    got = gr.governance(nodes, chain, none, nodes.limit(0)).collect()
    assert len(got) == 21 and {r.state for r in got} == {"governing"}


def test_size_zero_fits(spark):
    rows = [(1, d, s) for d, s in enumerate([0, 6, 0, 6, 3, 0])]
    df = spark.createDataFrame(rows, "k int, d int, s long")
    take = lambda **o: [r.d for r in rc.greedy_budget(df, "k", "d", [F.asc("d")], "s", **o).collect()]
    assert take(budget=10, limit=None) == [0, 1, 2, 4, 5] and take(budget=10, limit=3) == [0, 1, 2] and take(budget=0, limit=None) == [0, 2, 5]


def test_too_many_differences_are_refused(spark):
    df = spark.range(17).select("id", (F.col("id") - 3.5).alias("d"))
    with pytest.raises(ValueError, match="at most 16"):
        mt.sign_flip(df, "d")
    with pytest.raises(ValueError, match="at most 5"):
        mt.bootstrap_ci(df, "id", "d", 10, most=5)
    got = mt.sign_flip(df.where("id < 3"), "d").first()
    assert (got.n, got.assignments, got.p) == (3, 8, 0.25)
    assert mt.sign_flip(df.limit(0), "d").count() == 0


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_modules_import_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).parents[1]), timeout=120).returncode == 0
