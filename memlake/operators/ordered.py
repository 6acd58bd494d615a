"""Ordered computations over groups that may be too large for one task.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here every key is cut into
blocks by a column that rises with the order (a day, ``seq div 10000``, a value bucket). Each
block is scanned on its own; one small row per block carries the running state to the next
block. A key with a third of all rows is spread over as many tasks as it has blocks.

Rows without a key are cut at the quantiles of their whole order, so that a day, or one moment, with a third of
all rows is many equal blocks; their carries are scanned level by level, ``FAN`` at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from memlake.session import durable

BLOCK = "__block"
FAN = 64  # blocks, or groups of blocks, whose carries one task scans


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names where null equals null; the names of the left side stay."""
    named = right.select(*[F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return left.join(named, cond, how).drop(*[f"__on_{c}" for c in on])


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)  # last / lag: the nearer value wins


def _ranged(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` in blocks of about equal size that follow ``order``, and their number. Stored, as the cuts come from a sample."""
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(blocks, *order).withColumn(BLOCK, F.spark_partition_id())), blocks


AGGS = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _over(kind: str, total: Column) -> Column:
    """The state that the totals of earlier blocks leave behind."""
    if kind in AGGS:
        return (F.sum if kind == "count" else AGGS[kind])(total)
    return F.last(total, ignorenulls=kind == "last")


def _carries(totals: DataFrame, kinds: dict[str, str], blocks: int, reverse: bool) -> DataFrame:
    """(block, __c_...): the state before each block of rows without a key, by groups of ``FAN`` blocks per level."""
    group, at = "__group", F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()
    rows = totals.withColumn(group, F.floor(F.col(BLOCK) / FAN).cast("int"))
    inside = W.partitionBy(group).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    local = rows.select(BLOCK, group, *[_over(k, F.col(f"__t_{n}")).over(inside).alias(f"__c_{n}") for n, k in kinds.items()])
    groups = -(-blocks // FAN)
    if groups == 1:
        return local.drop(group)
    sums = rows.groupBy(F.col(group).alias(BLOCK)).agg(*[
        (_over(k, F.col(f"__t_{n}")) if k in AGGS else (F.min_by if reverse else F.max_by)(
            f"__t_{n}", F.when(F.col(f"__t_{n}").isNotNull(), F.col(BLOCK)) if k == "last" else F.col(BLOCK))).alias(f"__t_{n}") for n, k in kinds.items()])
    above = _carries(sums, kinds, groups, reverse).select(F.col(BLOCK).alias(group), *[F.col(f"__c_{n}").alias(f"__a_{n}") for n in kinds])
    return local.join(above, group, "left").select(BLOCK, *[_merge(k, F.col(f"__a_{n}"), F.col(f"__c_{n}")).alias(f"__c_{n}") for n, k in kinds.items()])


def running(df: DataFrame, keys: list[str], order: list[str], block: Column | None,
            specs: dict[str, tuple[str, Column, bool]], reverse: bool = False) -> DataFrame:
    """Add running columns to ``df``.

    ``specs`` maps an output name to ``(kind, value, inclusive)``; kind is ``sum``, ``count``
    (of non-null values), ``max``, ``min``, ``last`` (last non-null value) or ``lag`` (value of
    the row just before, null values kept). ``order`` must be a total order within a key, and
    ``block`` must never decrease along it. ``reverse`` runs from the end (so ``lag`` is a lead).
    Null keys and null blocks are groups like any other. Without keys the rows are cut at the quantiles of ``order``
    and no ``block`` is given.
    """
    if keys:
        rows, blocks = df.withColumn(BLOCK, block), 0
    else:
        rows, blocks = _ranged(df, order)
    vals = {n: f"__v_{n}" for n in specs}
    for name, (kind, value, _) in specs.items():
        wrapped = F.struct(value.alias("v")) if kind == "lag" else value
        rows = rows.withColumn(vals[name], wrapped)
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    inner = W.partitionBy(*keys, BLOCK).orderBy(*[direction(c) for c in order])
    position = F.struct(*[F.col(c) for c in order])

    def nearest(col: Column) -> Column:
        return F.min_by(col, position) if reverse else F.max_by(col, position)

    totals, out = [], []
    kinds = {name: kind for name, (kind, _, _) in specs.items()}
    for name, (kind, _, inclusive) in specs.items():
        col = F.col(vals[name])
        frame = inner.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        if kind in AGGS:
            totals.append(AGGS[kind](col).alias(f"__t_{name}"))
            local = AGGS[kind](col).over(frame)
        elif kind == "last":
            held = F.when(col.isNotNull(), position)
            totals.append((F.min_by(col, held) if reverse else F.max_by(col, held)).alias(f"__t_{name}"))
            local = F.last(col, ignorenulls=True).over(frame)
        else:
            totals.append(nearest(col).alias(f"__t_{name}"))
            local = F.lag(col).over(inner)
        rows = rows.withColumn(f"__l_{name}", local)
        merged = _merge(kind, F.col(f"__c_{name}"), F.col(f"__l_{name}"))
        out.append((merged["v"] if kind == "lag" else merged).alias(name))
    per_block = rows.groupBy(*keys, BLOCK).agg(*totals)
    if keys:
        outer = W.partitionBy(*keys).orderBy(direction(BLOCK)).rowsBetween(W.unboundedPreceding, -1)
        carry = per_block.select(*keys, BLOCK, *[_over(k, F.col(f"__t_{n}")).over(outer).alias(f"__c_{n}") for n, k in kinds.items()])
    else:
        carry = _carries(per_block, kinds, blocks, reverse)
    return null_safe(rows, carry, [*keys, BLOCK]).select(*[F.col(f"`{c}`") for c in df.columns], *out)


def number_rows(df: DataFrame, keys: list[str], order: list[str], block: Column | None, name: str,
                reverse: bool = False) -> DataFrame:
    """1-based position of each row within its key."""
    return running(df, keys, order, block, {name: ("count", F.lit(1), True)}, reverse)


def islands(df: DataFrame, keys: list[str], order: list[str], block: Column, breaks: Column,
            name: str, lagged: dict[str, Column]) -> DataFrame:
    """Number the runs of consecutive rows; ``breaks`` sees the ``lagged`` columns of the row before.

    A null ``breaks`` (first row of a key) opens an island.
    """
    prior = running(df, keys, order, block, {n: ("lag", c, False) for n, c in lagged.items()})
    flagged = prior.withColumn("__open", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    numbered = running(flagged, keys, order, block, {name: ("sum", F.col("__open"), True)})
    return numbered.drop("__open", *lagged)


def value_at_index(df: DataFrame, groups: list[str], value: str, block: Column,
                   picks: dict[str, Column]) -> DataFrame:
    """Exact order statistics by index. ``picks`` maps a name to a 0-based index built on ``n``.

    Equal values are counted first, so a value shared by a third of all rows is one row here. ``block`` is not used without groups.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__c"))
    cum = running(counts, groups, [value], block if groups else None, {"__hi": ("sum", F.col("__c"), True)})
    totals = counts.groupBy(*groups).agg(F.sum("__c").alias("n"))
    # Without groups the totals are one row.
    joined = null_safe(cum, totals, groups) if groups else cum.join(F.broadcast(totals))
    chosen = [F.max(F.when((F.col("__hi") > p) & (F.col("__hi") - F.col("__c") <= p), F.col(value))).alias(k)
              for k, p in picks.items()]
    return joined.groupBy(*groups).agg(F.max("n").alias("n"), *chosen)
