"""Small helpers shared by the operators: tables, stored steps, whole groups from Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strings(column: pa.ChunkedArray | pa.Array) -> list[str | None]:
    """Texts of an Arrow column; bytes that are not UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream of batches, sorted by integer ``keys``, at group borders.

    Yields (table, start of each group). The last group of a piece is carried on to the next, so a
    group is never split; callers bound the size of a group.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(final: bool):
        nonlocal held, count
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        end = table.num_rows if final else int(starts[-1])
        rest = table.slice(end)
        held, count = rest.to_batches(), rest.num_rows
        if end:
            yield table.slice(0, end), starts[starts < end]

    limit = rows
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
            if count >= limit:
                yield from cut(False)
                limit = rows + 2 * count  # a group longer than a piece is not looked at again for each batch
    if count:
        yield from cut(True)


def over_columns(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
