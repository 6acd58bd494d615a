"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one class from the start. Every class gets one sign pattern per table; classes that
share a pattern are compared by cosine in double precision, and a pair is counted in the first
table in which it meets. Bits per pattern follow the number of classes, so that chance meetings stay
a few per class; the number of tables follows from the recall asked for at the threshold itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.blocking import cells, linked
from memlake.llm.components import components
from memlake.llm.tables import stored

CELL = 1024


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables): a pair at the threshold meets in some table with probability ``recall``."""
    bits = min(62, max(6, math.ceil(math.log2(max(n, 2))) + 1))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so squares do not overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def usable(vec: Column) -> Column:
    """No null or non-finite component, and not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def signed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``classes`` (cls, n, vec: array<double>) with their unit vectors and sign patterns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            vec = b.column("vec")
            lengths = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            for dim in np.unique(lengths):
                if dim not in made:
                    made[dim] = planes(int(dim), bits, tables, seed)
                rows = np.flatnonzero(lengths == dim)
                units = unit(flat[(starts[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim))
                on = (units @ made[dim] > 0).reshape(len(rows), tables, bits)
                signs = (on * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                out = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))
                yield pa.RecordBatch.from_arrays(
                    [b.column("cls").take(pa.array(rows)), b.column("n").take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)),
                     out(units, pa.float64()), out(signs, pa.int64())], names=["cls", "n", "dim", "unit", "signs"])

    return classes.select("cls", "n", "vec").mapInArrow(work, "cls bigint, n bigint, dim int, unit array<double>, signs array<bigint>")


def _rows(table: pa.Table, name: str) -> np.ndarray:
    """A list column whose lists all have one length, as a matrix."""
    col = table.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def links(classes: DataFrame, signs: DataFrame, cosine: float) -> DataFrame:
    """(member, root, weight) per class and cell, see ``blocking.linked``."""
    keys = signs.select("cls", "dim", F.posexplode("signs").alias("t", "key"))
    bucket = ["dim", "t", "key"]
    dealt = cells(keys, bucket, "cls", CELL).join(signs.select("cls", "n", "unit", "signs"), "cls")

    def check(table: pa.Table):
        """Pieces may hold vectors of several lengths; each length is one matrix."""
        dims, t = table.column("dim").to_numpy(), table.column("t").to_numpy()
        units = np.zeros((table.num_rows, dims.max()))
        flat = table.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        units[np.arange(dims.max()) < dims[:, None]] = flat
        marks = _rows(table, "signs")

        def judge(a, b):
            near = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
            hits = np.flatnonzero(near)
            first = np.zeros(len(a), bool)
            # The first table in which both patterns are equal is the one that counts the pair.
            first[hits] = (marks[a[hits]] == marks[b[hits]]).argmax(axis=1) == t[a[hits]]
            return near, first

        return judge

    return linked(dealt, bucket, "cls", "n", check)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9,
                    recall: float = 0.97, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id): one row per row of ``rows``.

    ``n_links`` counts the other rows linked directly, copies included. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, and so do vectors of
    different lengths. A row without links is its own component. A null id is kept; it gives a
    component's id only where nothing else does. Repeated rows are copies of each other.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    good = base.where(usable(F.col("vec")))
    classes = stored(good.groupBy("vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
                     .withColumn("cls", F.monotonically_increasing_id()), "vectors")
    bits, tables = plan(classes.count(), cosine, recall)
    signs = stored(signed(classes, bits, tables, seed), "signs")
    found = stored(links(classes, signs, cosine), "links")
    groups = components(found.select(F.col("member").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy(F.col("member").alias("cls")).agg(F.sum("weight").alias("weight"))
    named = (classes.select("cls", "low", "n").join(groups.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
             .select("cls", "low", F.coalesce("component", "cls").alias("component"),
                     (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links")))
    # Stored on both sides, so that a component with a third of all classes is a join that Spark can split.
    named = stored(named, "named")
    lows = stored(named.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    labels = classes.select("cls", "vec").join(named.join(lows, "component"), "cls").select("vec", "n_links", "component_id")
    out = base.where(~usable(F.col("vec"))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.join(labels, "vec").select("id", "n_links", "component_id").unionByName(out)
