"""Blocked windows give what plain windows give, also when one key holds most rows."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.operators.ordered import islands, number_rows, running, value_at_index
from memlake.operators.recall import greedy_budget


def _rows(spark, n=600):
    rnd = random.Random(3)
    return spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", i, rnd.choice([None, 1, 2, 7, 9])) for i in range(n)], "k string, s int, v int")


def test_running_equals_plain_window(spark):
    df = _rows(spark)
    w = W.partitionBy("k").orderBy("s")
    got = running(df, ["k"], ["s"], F.floor(F.col("s") / 50), {
        "sum_in": ("sum", F.col("v"), True), "max_ex": ("max", F.col("v"), False), "cnt": ("count", F.col("v"), True),
        "last": ("last", F.col("v"), True), "lag": ("lag", F.col("v"), False)})
    want = df.select("*", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).alias("sum_in"),
                     F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("max_ex"),
                     F.count("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cnt"),
                     F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("last"), F.lag("v").over(w).alias("lag"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_reverse_lag_is_lead(spark):
    df = _rows(spark)
    got = running(df, ["k"], ["s"], F.floor(F.col("s") / 50), {"x": ("lag", F.col("v"), False)}, reverse=True)
    want = df.withColumn("x", F.lead("v").over(W.partitionBy("k").orderBy("s")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_islands_and_numbers(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate("xxyyyxzz")], "k string, s int, t string")
    rows = islands(df, ["k"], ["s"], F.floor(F.col("s") / 2), F.col("p") != F.col("t"), "g", {"p": F.col("t")}).orderBy("s").collect()
    assert [r.g for r in rows] == [1, 1, 2, 2, 2, 3, 4, 4]
    assert [r.n for r in number_rows(df, ["k"], ["s"], F.floor(F.col("s") / 3), "n").orderBy("s").collect()] == list(range(1, 9))


def test_value_at_index(spark):
    rnd = random.Random(5)
    vals = [rnd.choice([1, 1, 1, 5, 40, 700]) for _ in range(101)]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v int")
    n = F.col("n")
    r = value_at_index(df, ["g"], "v", F.floor(F.col("v") / 10), {"p50": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * 0.95))}).first()
    vals.sort()
    assert (r.n, r.p50, r.p95) == (101, vals[50], vals[int(101 * .95)])


def test_greedy_budget_is_exact_under_skew(spark):
    rnd = random.Random(9)
    rows = [("hot" if i % 4 else f"k{i % 3}", i, rnd.choice([1, 1, 2, 3, 30, 60, 200])) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, d int, size long")
    for limit in (None, 5):
        got = {(r.k, r.d) for r in greedy_budget(df, "k", "d", [F.asc("d")], "size", 100, limit).collect()}
        want = set()
        for key in {r[0] for r in rows}:
            used = n = 0
            for k, d, s in rows:
                if k == key and (limit is None or n < limit) and used + s <= 100:
                    used, n = used + s, n + 1
                    want.add((k, d))
        assert got == want


def _specs():
    return {"sum_in": ("sum", F.col("v"), True), "sum_ex": ("sum", F.col("v"), False), "max_ex": ("max", F.col("v"), False), "min_in": ("min", F.col("v"), True),
            "cnt": ("count", F.col("v"), True), "last": ("last", F.col("v"), True), "lag": ("lag", F.col("v"), False)}


def _plain(df, order, reverse):
    w = W.orderBy(*[F.col(c).desc() if reverse else F.col(c) for c in order])
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.select("*", zero(F.sum("v").over(upto)).alias("sum_in"), zero(F.sum("v").over(before)).alias("sum_ex"), F.max("v").over(before).alias("max_ex"), F.min("v").over(upto).alias("min_in"),
                     F.count("v").over(upto).alias("cnt"), F.last("v", True).over(upto).alias("last"), F.lag("v").over(w).alias("lag"))


def test_rows_without_a_key_are_cut_at_quantiles(spark, monkeypatch):
    from memlake.operators import ordered

    rnd = random.Random(2)
    # One day holds most rows, some have no day at all.
    rows = [(rnd.choice(["2024-01-02"] * 7 + ["2024-01-01", "2024-01-09", None]), i, rnd.choice([None, 1, 2, 7])) for i in range(900)]
    df = spark.createDataFrame(rows, "day string, s int, v int")
    for fan in (64, 2):  # one level of carries, and three
        monkeypatch.setattr(ordered, "FAN", fan)
        for reverse in (False, True):
            got = running(df, [], ["day", "s"], None, _specs(), reverse)
            assert sorted(map(str, got.collect())) == sorted(map(str, _plain(df, ["day", "s"], reverse).collect()))
            plan = got._jdf.queryExecution().executedPlan().toString()
            windows = [line for line in plan.splitlines() if " Window [" in line]
            assert windows and all("[__block" in line.split("windowspecdefinition(", 1)[1] or "__group" in line for line in windows)
    blocks, n = ordered._ranged(df, ["day", "s"])
    assert blocks.where("day = '2024-01-02'").select("__block").distinct().count() >= n // 2
    assert running(df.limit(0), [], ["day", "s"], None, _specs()).collect() == []
