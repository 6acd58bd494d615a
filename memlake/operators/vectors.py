"""Exact cosine ranking of vectors against a checked-size set of query vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import hold
from memlake.session import broadcast_if_small, fits_broadcast

BLOCK = 1000  # queries that meet all vectors in one pass


def centroids(vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """(key, centroid): one mean vector per key. Wide averages, so everything combines map-side."""
    means = vectors.groupBy(key).agg(*[F.expr(f"avg(CAST({column}[{i}] AS DOUBLE)) AS m{i}") for i in range(dim)])
    return means.selectExpr(key, "array(" + ", ".join(f"m{i}" for i in range(dim)) + ") AS centroid")


def dot(a: str, b: str, dim: int) -> Column:
    """Unrolled inner product of two array columns: stays in generated code, unlike a lambda fold."""
    return F.expr(" + ".join(f"CAST({a}[{i}] AS DOUBLE) * CAST({b}[{i}] AS DOUBLE)" for i in range(dim)))


def cosine(a: str, b: str, dim: int) -> Column:
    return dot(a, b, dim) / (F.sqrt(dot(a, a, dim)) * F.sqrt(dot(b, b, dim)))


def against_all(rows: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row with every query of a stated set, in blocks of about ``block`` queries that are broadcast one by one."""
    blocks = -(-queries.count() // block) or 1
    part = F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))
    out = None
    for i in range(blocks):
        some = queries.where(part == i) if blocks > 1 else queries
        if not fits_broadcast(some):
            raise ValueError("a block of queries does not fit a broadcast; use a smaller block")
        met = rows.join(F.broadcast(some))
        out = met if out is None else out.unionByName(met)
    return out


def similar(vectors: DataFrame, queries: DataFrame, column: str, query: str, dim: int, on: list[str] | None = None,
            floor: float | None = None) -> DataFrame:
    """Score every vector against the queries of its scope (``on``), or against all of them.

    A scoped call joins on its scope. Without a scope the stated queries meet all vectors in blocks: each
    block is measured before it is broadcast, and one pass over the vectors serves it.
    """
    norm = lambda c: F.sqrt(dot(c, c, dim))
    side = queries.withColumn("__nq", norm(query))
    left = vectors.withColumn("__nv", norm(column))
    pairs = left.join(broadcast_if_small(side), on) if on else against_all(left, side)
    score = F.round(dot(column, query, dim) / (F.col("__nv") * F.col("__nq")), 6)
    scored = hold(pairs, score.alias("score")).drop(column, query, "__nv", "__nq")
    return scored if floor is None else scored.where(F.col("score") >= floor)


def with_score(pairs: DataFrame, column: str, query: str, dim: int) -> DataFrame:
    """``pairs`` of two vectors with their cosine, rounded as everywhere."""
    return hold(pairs, F.round(cosine(column, query, dim), 6).alias("score"))
