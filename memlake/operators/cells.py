"""Exact nearest vectors by cosine from a stored inverted-list index.

The vectors are dealt to k-means cells by angle; every cell keeps its radius, the largest angle between its centroid and a
member. The angle between a query and any member is at least the angle to the centroid less the radius, which
bounds the cosine that a cell can hold. A search scores the best cells until they hold k vectors, and then
only the cells whose bound reaches the k-th best score so far: all others cannot change the result, which is
the same as that of a comparison with every vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from memlake.operators import vectors as vx
from memlake.operators.index import top
from memlake.session import durable

FIT = 20_000      # vectors, first by a hash of their key, that the centroids are fitted to; every vector is indexed
MOST_CELLS = 4096
ROUNDS = 8
FOLDERS = 64      # at most so many folders, of 16 cells or more, so that a search opens only some
SLACK = 1e-6      # scores are rounded to six decimals, angles to less


class Cells(NamedTuple):
    """``members`` (columns given, cell, folder) and ``cells`` (folder, cell, centroid, radius, n)."""

    members: DataFrame
    cells: DataFrame
    column: str
    dim: int


def usable(column: str, dim: int) -> Column:
    """Vectors of the right length without null or non-finite entries, and not zero. Others are not indexed."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(column) == dim) & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1, 1))


def fitted(units: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by Lloyd rounds on a bounded sample; an empty cell keeps its centroid."""
    centroids = units[np.random.default_rng(7).permutation(len(units))[:cells]]
    for _ in range(ROUNDS):
        near = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def build(vectors: DataFrame, key: str, column: str, dim: int, path: str, cells: int | None = None) -> Cells:
    """Write the index of all usable ``vectors``; about a root of their number of cells unless told."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(column, dim))
    n = rows.count()
    cells = max(1, min(cells or math.isqrt(n), MOST_CELLS))
    share = F.pmod(F.xxhash64(F.lit("cells"), key), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1, FIT / max(n, 1)))
    sample = rows.where(share).select(column).limit(2 * FIT).toArrow().column(0).combine_chunks()  # equal keys come together
    sent = spark.sparkContext.broadcast(fitted(_units(sample, dim), cells) if len(sample) else np.eye(1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angles = _angles(_units(b.column(column), dim), sent.value)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])],
                                                 names=[*b.schema.names, "cell", "angle"])

    schema = StructType([*rows.schema.fields]).add("cell", IntegerType()).add("angle", DoubleType())
    dealt = rows.mapInArrow(assign, schema).withColumn("folder", F.pmod("cell", F.lit(min(FOLDERS, -(-cells // 16)))))
    # Part of a large cell's members go to each of several tasks.
    (dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder", F.pmod(F.xxhash64(key), F.lit(4)))
     .sortWithinPartitions("folder", "cell").write.partitionBy("folder").parquet(f"{path}/members"))
    spark.createDataFrame([], dealt.schema).write.parquet(f"{path}/schema")  # an empty table has no other file to tell it
    facts = spark.read.schema(dealt.schema).parquet(f"{path}/members").groupBy("folder", "cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(sent.value)], "cell int, centroid array<double>")
    facts.join(places, "cell").select("folder", "cell", "centroid", "radius", "n").coalesce(1).write.parquet(f"{path}/cells")
    return load(spark, path, column, dim)


def load(spark: SparkSession, path: str, column: str, dim: int) -> Cells:
    members = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/members")
    return Cells(members, spark.read.parquet(f"{path}/cells"), column, dim)


def bounds(index: Cells, queries: DataFrame, query: str, k: int) -> DataFrame:
    """``queries`` by folder and cell with ``upper``, the largest cosine the cell can hold, and ``first``, the best cells up to k members.

    Queries that are null, zero, not finite or of another length meet no cell.
    """
    table = index.cells.orderBy("cell").toArrow()  # at most MOST_CELLS rows
    dim = index.dim
    number, folder, radius, size = (table.column(c).to_numpy() for c in ("cell", "folder", "radius", "n"))
    centroids = _units(table.column("centroid").combine_chunks(), dim) if len(number) else np.zeros((0, dim))
    sent = queries.sparkSession.sparkContext.broadcast((number, folder, radius, size, centroids))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, folder, radius, size, centroids = sent.value
        if not len(number):
            return
        step = max(1, (1 << 18) // len(number))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                upper = np.cos(np.maximum(_angles(_units(b.column(query), dim), centroids) - radius, 0)) + SLACK
                order = np.argsort(-upper, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                first = np.zeros(upper.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                row = pa.array(np.repeat(np.arange(b.num_rows), len(number)))
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in b.columns], pa.array(np.tile(folder, b.num_rows)), pa.array(np.tile(number, b.num_rows)), pa.array(upper.ravel()), pa.array(first.ravel())],
                                                 names=[*b.schema.names, "folder", "cell", "upper", "first"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields], "folder int, cell int, upper double, first boolean"])
    return queries.where(usable(query, dim)).mapInArrow(meet, schema)


def nearest(index: Cells, queries: DataFrame, keys: list[str], query: str, order: str, k: int, floor: float | None = None) -> DataFrame:
    """(keys, columns of the members, score, pos): the best ``k`` members of each query by rounded cosine, then ``order``.

    ``floor`` leaves out what scores less. Only cells that may hold one of the k are read.
    """
    met = bounds(index, durable(queries.select(*keys, query)), query, k)  # asked twice, so worked out once
    if floor is not None:
        met = met.where(F.col("upper") >= floor)
    members = index.members.drop("angle")

    def scored(cells: DataFrame) -> DataFrame:
        found = cells.join(members, ["folder", "cell"])
        rows = vx.with_score(found, index.column, query, index.dim).drop("folder", "cell", index.column, query)
        return rows if floor is None else rows.where(F.col("score") >= floor)

    by = [F.desc("score"), F.asc(order)]
    near = durable(top(scored(met.where("first").drop("upper", "first")), keys, by, k).drop("pos"))
    # A query whose best cells gave k rows needs only cells that reach the last of them.
    least = near.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    more = met.where("not first").join(least, keys, "left").where("least IS NULL OR upper >= least").drop("upper", "first", "least")
    return top(near.unionByName(scored(more)), keys, by, k)
