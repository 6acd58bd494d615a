"""Registry that pairs each Spark query with the ANSI SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    # Tables with long texts: their rows cost far more to work on than to move.
    TEXTS = ("documents", "conversations", "pages")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in self.TEXTS:
            df = spread(df)
        setattr(self, name, df)
        return df


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than there are cores.

    A small table is one file with one row group, so one task would do all text work. A large table
    has more splits than cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``, with its oracle SQL if there is one."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return wrap
