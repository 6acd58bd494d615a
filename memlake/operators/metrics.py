"""Aggregates over cases, logs, ledgers and grids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from memlake.operators.ordered import value_at_index

def count_rows():
    return F.count(F.lit(1))


def share(cond: Column, of: Column | None = None) -> Column:
    """Share of rows where ``cond`` holds among those where ``of`` holds; null when there are none."""
    of = F.lit(True) if of is None else of
    yes = F.sum(F.when(of & F.coalesce(cond, F.lit(False)), 1).otherwise(0))
    return F.round(yes / F.nullif(F.sum(F.when(of, 1).otherwise(0)), F.lit(0)), 6)


def index_percentiles(df: DataFrame, groups: list[str], value: str, width: float, capped: bool = True) -> DataFrame:
    """p50 and p95 by index (n div 2 and floor(0.95 n)), never interpolated."""
    at95 = F.floor(F.col("n") * F.lit(0.95))
    picks = {"p50": F.floor(F.col("n") / 2), "p95": F.least(F.col("n") - 1, at95) if capped else at95}
    return value_at_index(df, groups, value, F.floor(F.col(value) / width), picks)


def with_all(df: DataFrame, column: str) -> DataFrame:
    """Every row once under its own group and once under ``all``."""
    return df.withColumn(column, F.explode(F.array(F.lit("all"), F.col(column))))


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """Metrics of scored cases by split and for all."""
    pos = F.col("positive")
    rank = F.col("rank").isNotNull()
    hard = pos & (F.col("overlap") < 0.34)
    grouped = cases.groupingSets([["split"], []], "split").agg(
        count_rows().alias("cases"), F.sum(pos.cast("bigint")).alias("positives"),
        share(F.col("status") == "unavailable").alias("unavailable_rate"),
        share(rank, pos).alias("hit_at_k"), share(F.col("rank") == 1, pos).alias("hit_at_1"),
        F.round(F.sum(F.when(pos & rank, 1 / F.col("rank")).otherwise(0.0)) / F.nullif(F.sum(pos.cast("bigint")), F.lit(0)), 6).alias("mrr"),
        share(F.col("status") != "hit", pos).alias("miss_rate"),
        share(~rank & F.col("in_candidates"), pos).alias("ranked_out"),
        share(F.col("baseline_rank").isNotNull(), pos).alias("baseline_hit_at_k"),
        share(F.col("scoped_rank").isNotNull(), pos).alias("scoped_hit_at_k"),
        share(rank, hard).alias("hard_hit_at_k"),
        share(F.col("status") == "hit", ~pos).alias("false_injection_rate"))
    timed = with_all(cases.where(F.col("status").isin("hit", "miss")).select("split", "ms"), "split")
    p = index_percentiles(timed, ["split"], "ms", 100).select("split", F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms"))
    return grouped.withColumn("split", F.coalesce("split", F.lit("all"))).join(p, "split", "left")


def failure_cause(c: dict[str, Column]) -> Column:
    """Why a case failed; null for a success."""
    lost = c["positive"] & (c["status"] == "hit") & c["rank"].isNull()
    return (F.when(~c["positive"] & (c["status"] == "hit"), "noise")
            .when(c["positive"] & (c["status"] != "hit"), "nothing found")
            .when(lost & c["in_candidates"], "ranked out").when(lost, "competing notes"))


def counted_with_examples(df: DataFrame, group: str, example: str, k: int) -> DataFrame:
    """Exact counts per group with its first ``k`` examples (the limit is the report's)."""
    w = W.partitionBy(group).orderBy(example)
    few = (df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).groupBy(group)
           .agg(F.array_sort(F.collect_list(example)).alias("__e")))
    return (df.groupBy(group).agg(count_rows().alias("n")).join(few, group)
            .select(group, "n", F.array_join(F.transform("__e", lambda x: x.cast("string")), " ").alias("examples")))


def multiset_digest(hexes: Column) -> Column:
    """Digest of a set of sha256 values that no order changes.

    Eight word sums combine on the map side, so no task ever sees the whole list.
    """
    words = [F.sum(F.conv(F.substring(hexes, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return F.sha2(F.concat_ws(":", *words), 256)


def dense_grid(tasks: DataFrame, key: str, baselines: list[str], traces: DataFrame) -> DataFrame:
    """Every task under every baseline, attempted or not. Repeated traces mark their cell."""
    grid = tasks.select(key, F.explode(F.array(*[F.lit(b) for b in baselines])).alias("baseline"))
    once = traces.groupBy(key, "baseline").agg(count_rows().alias("__n"), F.bool_and("completed").alias("completed"), F.bool_and("verified").alias("verified"))
    rows = grid.join(once, [key, "baseline"], "left")
    done = F.coalesce("completed", F.lit(False))
    return rows.select(key, "baseline", F.col("__n").isNotNull().alias("attempted"), done.alias("completed"),
                       (done & F.coalesce("verified", F.lit(False))).alias("passed"),
                       F.when(F.col("__n").isNull(), "missing attempt").when(F.col("__n") > 1, "duplicate trace").otherwise("").alias("error"))


def _named_reads(hits: DataFrame, rows: DataFrame, session: str, before: int, horizon: int) -> DataFrame:
    """(session, __name, __rt): each tool input with each of the file names shown around its time that it contains.

    Names and inputs meet by (session, time bucket of the horizon's length); the names of a bucket become one automaton,
    through which its inputs pass one by one.
    """
    bucket = lambda t: F.floor(t / horizon)
    names = (hits.select(session, "__name", F.explode(F.sequence(bucket(F.col("__t") - before), bucket(F.col("__t") + horizon))).alias("__b"))
             .where("__name IS NOT NULL").distinct().select(session, "__b", F.lit(0).alias("__kind"), "__name", F.lit(None).cast("double").alias("__rt"), F.lit(None).cast("string").alias("__text")))
    inputs = (rows.where("NOT is_prompt AND tool_text IS NOT NULL").select(session, bucket(F.col("__rt")).alias("__b"), F.lit(1).alias("__kind"),
                                                                          F.lit(None).cast("string").alias("__name"), "__rt", F.col("tool_text").alias("__text")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        key, names, machine = None, set(), None
        for b in batches:
            out = []
            for who, at, kind, name, rt, text in zip(*(b.column(c).to_pylist() for c in (session, "__b", "__kind", "__name", "__rt", "__text"))):
                if (who, at) != key:
                    key, names, machine = (who, at), set(), None
                if kind == 0:
                    names.add(name)
                    continue
                if machine is None and names:
                    machine = ahocorasick.Automaton()
                    for n in names - {""}:
                        machine.add_word(n, n)
                    machine.make_automaton()
                found = {""} & names  # a path that ends with a slash: any input will do
                if machine is not None and len(machine):
                    found |= {n for _, n in machine.iter(text)}
                out += [(who, n, rt) for n in found]
            if out:
                who, n, rt = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(who, b.schema.field(session).type), pa.array(n, pa.string()), pa.array(rt, pa.float64())], names=[session, "__name", "__rt"])

    schema = f"`{session}` {hits.schema[session].dataType.simpleString()}, __name string, __rt double"
    return (names.unionByName(inputs).repartition(session, "__b").sortWithinPartitions(session, "__b", "__kind").mapInArrow(meet, schema))


def opened_after(hits: DataFrame, rows: DataFrame, session: str, before: int, horizon: int, grace: int) -> DataFrame:
    """For each shown path: was it read by a tool before the next prompt?

    ``hits`` (id, session, ts, path); ``rows`` (session, ts, is_prompt, tool_text). A read is a tool input that contains the
    path's file name, from ``before`` seconds ahead of the hit up to ``horizon`` after it; the next prompt comes more than
    ``grace`` seconds after it. Hits and reads of one file name are swept together from the end, and so are hits and
    prompts of one session: each hit picks up the nearest later one, and no row stands for a pair of a hit and an event.
    Sweeps run by time bucket, so a busy session is spread over its buckets; an event stands in its own bucket and the one before.
    """
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    h = hits.select("id", session, sec("ts").alias("__t"), F.element_at(F.split("path", "/"), -1).alias("__name"))
    r = rows.select(session, sec("ts").alias("__rt"), "is_prompt", "tool_text")
    width = horizon + before + grace  # no hit looks further ahead
    none = F.lit(None)

    def nearest(events: DataFrame, asked: DataFrame, keys: list[str], first: int, name: str) -> DataFrame:
        """(id, name): the time of the nearest event at or after each asked time; ``first`` orders equal times."""
        bucket = F.floor(F.col("__at") / width)
        e = events.where(F.col(session).isNotNull()).select(*keys, F.col("__rt").alias("__at"), F.lit(1 - first).alias("__kind"), none.cast(hits.schema["id"].dataType).alias("id"), "__rt")
        q = asked.select(*keys, "__at", F.lit(first).alias("__kind"), "id", none.cast("double").alias("__rt"), bucket.alias("__b"))
        rows = e.withColumn("__b", F.explode(F.array(bucket, bucket - 1))).unionByName(q)
        later = W.partitionBy(*keys, "__b").orderBy(F.desc("__at"), F.desc("__kind")).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumn(name, F.last("__rt", ignorenulls=True).over(later)).where("id IS NOT NULL").select("id", name)

    reads = nearest(_named_reads(h, r, session, before, horizon), h.withColumn("__at", F.col("__t") - before), [session, "__name"], 0, "__read")
    prompts = nearest(r.where("is_prompt"), h.withColumn("__at", F.col("__t") + grace), [session], 1, "__next")
    # A later prompt beyond the horizon ends nothing that lies within it.
    opened = (F.col("__read") <= sec("ts") + horizon) & (F.col("__next").isNull() | (F.col("__read") < F.col("__next")))
    return (hits.join(reads, "id", "left").join(prompts, "id", "left")
            .select(*hits.columns, F.coalesce(opened, F.lit(False)).alias("opened")))


def _few(df: DataFrame, columns: list[str], most: int, what: str) -> list:
    """The rows of a table that must be short: counted while they are read, refused if there are more."""
    rows = df.select(*columns).where(F.col(columns[-1]).isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} takes at most {most} differences")
    return sorted(tuple(r) for r in rows)


def sign_flip(diffs: DataFrame, value: str, most: int = 16) -> DataFrame:
    """Exact two-sided p over all 2^n sign assignments; more than ``most`` configuration differences are refused.

    The few differences become literals and the assignments are a range, so they run in parallel.
    """
    v = [x for (x,) in _few(diffs, [value], most, "the exact test")]
    masks = diffs.sparkSession.range(2 ** len(v) if v else 0)
    flipped = sum((F.when(F.shiftright("id", i).bitwiseAND(1) == 1, x).otherwise(-x) for i, x in enumerate(v)), F.lit(0.0))
    as_far = F.abs(flipped) >= abs(sum(v)) - 1e-9
    return (masks.agg(F.round(F.avg(as_far.cast("double")), 6).alias("p"), count_rows().alias("assignments"))
            .select(F.lit(len(v)).cast("bigint").alias("n"), F.round(F.lit(sum(v) / max(1, len(v))), 6).alias("mean_difference"), "p", "assignments").where("n > 0"))


def bootstrap_ci(diffs: DataFrame, order: str, value: str, replicates: int, most: int = 1000) -> DataFrame:
    """2.5 and 97.5 index percentiles of resampled means; draws come from a hash, so they repeat.

    At most ``most`` differences, which become a literal; the replicates are a range and run in parallel.
    """
    v = [x for _, x in _few(diffs, [order, value], most, "the bootstrap")]
    runs = diffs.sparkSession.range(replicates if v else 0)
    held = F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<double>")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(max(0, len(v) - 1))), lambda i: F.get(held, (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), i.cast("string"))), 1, 8), 16, 10)
                                                                                          .cast("bigint") % len(v)).cast("int")))
    means = runs.select(F.round(F.aggregate(drawn, F.lit(0.0), lambda a, x: a + x) / len(v), 6).alias("m"))
    low, high = F.floor(F.lit(0.025) * (F.col("n") - 1)), F.floor(F.lit(0.975) * (F.col("n") - 1))
    return value_at_index(means, [], "m", F.floor(F.col("m") / 10), {"low": low, "high": high})
