"""Dense study grids and freshness of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A cell shows its worst stage state, in this order (fixed values).
PRIORITY = ["corrupt", "unknown", "failed", "skipped", "not_started", "blocked"]


def cell_states(trajectories: DataFrame, outcomes: DataFrame, arms: list[str], phases: int, stages: int) -> DataFrame:
    """State of every (trajectory, arm, phase) cell, started or not.

    Work behind the first unresolved stage of its trajectory and arm is corrupt. The grid per
    trajectory is fixed by the study plan, so plain aggregates find the first gap.
    """
    ints = lambda n: F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(n)]))
    grid = (trajectories.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
            .withColumn("phase", ints(phases)).withColumn("stage", ints(stages)))
    rows = grid.join(outcomes, ["trajectory", "arm", "phase", "stage"], "left").withColumn("pos", F.col("phase") * stages + F.col("stage"))
    open_ = F.col("st").isNull() | (F.col("st") == "unknown")
    gaps = rows.groupBy("trajectory", "arm").agg(F.min(F.when(open_, F.col("pos"))).alias("gap"))
    state = (F.when(F.col("gap").isNull() | (F.col("pos") < F.col("gap")), F.col("st"))
             .when(F.col("pos") == F.col("gap"), F.coalesce("st", F.lit("not_started")))
             .when(F.col("st").isNull(), "blocked").otherwise("corrupt"))
    known = rows.join(gaps, ["trajectory", "arm"]).withColumn("state", state)
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("state"))
    worst = F.min(F.when(rank > 0, rank)).alias("worst")
    done = F.bool_or((F.col("stage") == stages - 1) & (F.col("state") == "completed")).alias("success")
    return (known.groupBy("trajectory", "arm", "phase").agg(worst, done)
            .withColumn("state", F.coalesce(F.get(F.array(*[F.lit(p) for p in PRIORITY]), (F.col("worst") - 1).cast("int")), F.lit("resolved")))
            .drop("worst"))


def staleness(df: DataFrame, source: str, ts: str, good: Column, as_of: str, stale_after: int) -> DataFrame:
    """Age of the last good record per source, and whether later records are still unfinished."""
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    now = sec(F.lit(as_of).cast("timestamp_ntz"))
    last = df.groupBy(source).agg(F.max(F.when(good, F.col(ts))).alias("ok"), F.max(ts).alias("any"))
    age = now - sec(F.col("ok"))
    return last.select(source, F.floor(age).alias("age_seconds"), (age > stale_after).alias("stale"), (F.col("any") > F.col("ok")).alias("unfinished"))
