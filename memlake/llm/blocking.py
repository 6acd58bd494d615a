"""Pairs inside hash buckets, without emitting them and without holding a bucket in one task.

A bucket with n members is cut into ``ceil(n / width)`` blocks by a hash of the member. Each pair
of blocks is one cell, so a bucket with a third of all rows becomes many equal cells; a cell holds
about two blocks. Cells compare their pairs in numpy and give back, per member, one link towards
the smallest member of its linked group in the cell (a spanning forest) and a sum over its partners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import whole_groups, width as partitions

PAIRS = 1 << 16  # pairs compared at once
SMALL = 48  # groups up to this size are compared together, larger ones by row blocks


def cells(keys: DataFrame, bucket: list[str], member: str, width: int) -> DataFrame:
    """(bucket..., member, __i, __j, __half): members of buckets with two or more members, by cell.

    ``keys`` often comes from an explode, which Spark takes to be as small as what is exploded. Both sides of the join
    may hold many times the input's rows, so neither is broadcast, whatever their estimate.
    """
    sizes = keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / width).cast("int")
    dealt = (keys.hint("merge").join(sizes, bucket).withColumn("__blocks", blocks)
             .withColumn("__half", F.pmod(F.xxhash64(F.lit("cell"), F.col(member)), F.col("__blocks")).cast("int")))
    spread = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return (spread.withColumn("__i", F.least("__half", "__other")).withColumn("__j", F.greatest("__half", "__other"))
            .select(*bucket, member, "__i", "__j", "__half"))


def _pairs(starts: np.ndarray, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each group: small groups by distance, larger ones by rows."""
    sizes = np.diff(np.append(starts, total))
    left = np.arange(total)
    to_end = np.repeat(starts + sizes, sizes) - left  # rows from here to the end of the group
    small = np.repeat(sizes <= SMALL, sizes)
    rows = left[small & (to_end > 1)]
    step = 1
    while len(rows):
        for at in range(0, len(rows), PAIRS):
            part = rows[at:at + PAIRS]
            yield part, part + step
        step += 1
        rows = rows[to_end[rows] > step]
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        step = max(1, PAIRS // int(size))
        for at in range(0, int(size), step):
            a = np.repeat(np.arange(at, min(at + step, size)), size)
            b = np.tile(np.arange(size), len(a) // size)
            later = b > a
            yield start + a[later], start + b[later]


def _roots(member: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member reachable over the links (a, b); all links of a piece at once."""
    label = member.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    return label


def linked(dealt: DataFrame, bucket: list[str], member: str, weight: str | None,
           check: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(member, root, weight): one row per member and cell with a link.

    ``check(table)`` gives a function of index pairs that tells which are links and which of those
    count here (a pair that an earlier table has counted is a link, but not counted again).
    """
    keys = [*bucket, "__i", "__j"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            ids = table.column(member).to_numpy()
            half = table.column("__half").to_numpy()
            cross = table.column("__i").to_numpy() != table.column("__j").to_numpy()
            other = table.column(weight).to_numpy() if weight else np.ones(len(ids), np.int64)
            judge = check(table)
            got_a, got_b, sums = [], [], np.zeros(len(ids), np.int64)
            for a, b in _pairs(starts, len(ids)):
                keep = ~cross[a] | (half[a] != half[b])
                a, b = a[keep], b[keep]
                is_link, counts = judge(a, b)
                np.add.at(sums, a[counts], other[b[counts]])
                np.add.at(sums, b[counts], other[a[counts]])
                a, b = a[is_link], b[is_link]
                if len(a) > 4 * len(ids):  # keep the links of a dense cell short
                    label = _roots(np.arange(len(ids)), a, b)
                    a = np.flatnonzero(label != np.arange(len(ids)))
                    b = label[a]
                got_a.append(a)
                got_b.append(b)
                if sum(map(len, got_a)) > 32 * len(ids) + PAIRS:
                    label = _roots(np.arange(len(ids)), np.concatenate(got_a), np.concatenate(got_b))
                    left = np.flatnonzero(label != np.arange(len(ids)))
                    got_a, got_b = [left], [label[left]]
            if not got_a:
                continue
            a, b = np.concatenate(got_a), np.concatenate(got_b)
            # Positions are numbered by group, so equal members of two groups stay apart.
            label = _roots(np.arange(len(ids)), a, b)
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, label, ids)
            root = low[label]
            out = (root != ids) | (sums > 0)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(root[out]), pa.array(sums[out])],
                                                 names=["member", "root", "weight"])

    n = partitions(dealt.sparkSession)
    return (dealt.repartition(n, *keys).sortWithinPartitions(*keys)
            .mapInArrow(work, "member bigint, root bigint, weight bigint"))
