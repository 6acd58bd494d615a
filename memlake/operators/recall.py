"""Steps between a fused candidate list and the notes that are delivered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def outside_skip_paths(df: DataFrame, uri: Column, patterns: list[str]) -> DataFrame:
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~uri.rlike(p)
    return df.where(keep)


def in_collections(df: DataFrame, collection: Column, collections: list[str], memory: list[str]) -> DataFrame:
    """No list means every collection; memory collections only widen an explicit list."""
    return df.where(collection.isin(*collections, *memory)) if collections else df


def prefer(df: DataFrame, keys: list[str], kind: Column, preferred: list[str], pos: str = "pos") -> DataFrame:
    """Preferred types first, the order kept within both parts."""
    w = W.partitionBy(*keys).orderBy((~kind.isin(preferred)).asc(), F.asc(pos))
    return df.withColumn("place", F.row_number().over(w).cast("bigint"))


def rerank(df: DataFrame, scores: DataFrame, keys: list[str], doc: str, top_n: int, blend: float) -> DataFrame:
    """Order the first ``top_n`` by judge score + blend/(rank); keep the order unless scores are complete.

    ``scores`` (keys, doc, judge) comes from outside. It counts only when it names exactly the
    candidates of the top, once each, with finite values.
    """
    head = df.where(F.col("pos") <= top_n)
    given = scores.groupBy(*keys, doc).agg(F.max("judge").alias("judge"), F.count(F.lit(1)).alias("__n"))
    both = head.select(*keys, doc, F.lit(True).alias("__in")).join(given, [*keys, doc], "full_outer")
    finite = F.col("judge").isNotNull() & ~F.isnan("judge") & (F.abs("judge") < float("inf"))
    good = F.coalesce(F.col("__in") & finite & (F.col("__n") == 1), F.lit(False))
    valid = both.groupBy(*keys).agg(F.bool_and(good).alias("valid"))
    rows = df.join(valid, keys, "left").join(given.drop("__n"), [*keys, doc], "left")
    usable = F.coalesce("valid", F.lit(False)) & (F.col("pos") <= top_n)
    mixed = F.when(usable, F.round(F.col("judge") + blend / F.col("pos"), 9))
    w = W.partitionBy(*keys).orderBy(mixed.desc_nulls_last(), F.asc("pos"))
    return (rows.withColumn("place", F.row_number().over(w).cast("bigint"))
            .withColumn("coverage", F.when(F.coalesce("valid", F.lit(False)), "exact_passage").otherwise("invalid_scores")))


def slot_order(df: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """Up to ``slots`` memory notes first, then the list order."""
    nth = F.row_number().over(W.partitionBy(*keys, "memory").orderBy("pos"))
    slotted = df.withColumn("__s", F.col("memory") & (nth <= slots))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__s"), F.asc("pos")))
    return slotted.withColumn("place", place.cast("bigint")).drop("__s")


def inject(df: DataFrame, key: str, doc: str, slots: int, limit: int, size: str, budget: int) -> DataFrame:
    """(key, doc, place, size, memory): what is delivered of each list, memory slots first, then the list order.

    ``size`` is the bytes that a row adds to the context, ``budget`` what the rows of a list may add together. A row that
    does not fit is passed over for the next, so up to ``limit`` rows are taken; ``place`` numbers them.
    """
    return greedy_budget(slot_order(df, [key], slots), key, doc, [F.asc("place")], size, budget, limit, carry=["memory"])


def greedy_budget(df: DataFrame, key: str, doc: str, order: list[Column], size: str, budget: int,
                  limit: int | None, carry: list[str] | None = None) -> DataFrame:
    """(key, doc, place, size, carry...): rows taken in order while they fit ``budget``, numbered as they are taken.

    A row that does not fit is skipped, not final.

    Of rows with equal size, a later one is taken only if all earlier ones were, so at most
    ``budget / size`` of them matter (and at most ``limit``). Keeping those is exact and leaves every
    key with about ``budget * ln(budget)`` rows for the sequential pass, however many it started with. Rows
    of size zero always fit; without a limit all of them are taken.
    """
    fits = df.where((F.col(size) >= 0) & (F.col(size) <= budget))
    nth = F.row_number().over(W.partitionBy(key, size).orderBy(*order))
    matters = (F.col("__n") * F.col(size) <= budget) & (F.lit(True) if limit is None else F.col("__n") <= limit)
    few = fits.withColumn("__n", nth).where(matters)
    ranked = few.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("bigint"))
    columns = [key, doc, "place", size, *(carry or [])]
    schema = ranked.select(*columns).schema

    def take(batches):
        current, used, count = None, 0, 0
        for pdf in batches:
            picked, places = [], []
            for i, (k, s) in enumerate(zip(pdf[key], pdf[size])):
                if k != current:
                    current, used, count = k, 0, 0
                if (limit is None or count < limit) and used + s <= budget:
                    used, count = used + s, count + 1
                    picked.append(i)
                    places.append(count)
            yield pdf.iloc[picked].assign(place=places)

    # The window above left the rows partitioned by key and sorted; the sort below keeps that explicit.
    return ranked.select(*columns).sortWithinPartitions(key, "place").mapInPandas(take, schema)


def statuses(asked: DataFrame, lexical: DataFrame, fused: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """hit or miss per query, with the reason and how many rungs answered; ``delivered`` are the rows of the cut."""
    kept = delivered.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    any_ = fused.groupBy(*keys).agg(F.lit(True).alias("__any"))
    rungs = lexical.groupBy(*keys).agg(F.countDistinct("rung").alias("answered_rungs"))
    rows = asked.join(kept, keys, "left").join(any_, keys, "left").join(rungs, keys, "left")
    hit = F.col("hits") > 0
    return rows.select(
        *keys, F.when(hit, "hit").otherwise("miss").alias("status"),
        F.when(hit, "").when(F.col("__any"), "no admissible lexical evidence or close meaning")
        .otherwise("no keyword or semantic match").alias("reason"),
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        F.coalesce("answered_rungs", F.lit(0)).alias("answered_rungs"))


def newest_sweep(last: DataFrame, seen: DataFrame, key: str, ts: str, idle_before: str, watermark: str, limit: int) -> DataFrame:
    """Newest idle sources since the watermark that were not seen; a top-k report."""
    fresh = last.where((F.col(ts) <= F.lit(idle_before).cast("timestamp_ntz")) & (F.col(ts) > F.lit(watermark).cast("timestamp_ntz")))
    top = fresh.join(seen, key, "left_anti").orderBy(F.desc(ts), F.asc(key)).limit(limit)
    return top.withColumn("pos", F.row_number().over(W.orderBy(F.desc(ts), F.asc(key))).cast("bigint"))
