"""Session helpers: local session for tests, durable lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only after it was measured and found to have at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20


def local_session(cpus: str = "8", shuffle: int = 8, app: str = "memlake") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MEMLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. A local session, which has no other
    executors, gets a temporary folder where it is unset; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-memlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder.

    Unlike a checkpoint it leaves nothing of the old plan behind: a checkpoint hands its constraints on, and in a long
    loop the optimizer's work on them grows with every round.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def read_in_pieces(spark: SparkSession, size: int) -> Iterator[None]:
    """Scans that run inside read at most ``size`` bytes of files in one task (a row group is never cut)."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` was measured (never past ``rows`` + 1) and is small enough to broadcast."""
    each = F.octet_length(F.to_json(F.struct("*")))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("b")).first()
    return found.n <= rows and (found.b or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows; else unchanged (shuffle join)."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df
