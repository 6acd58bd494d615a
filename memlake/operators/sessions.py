"""Events to sessions, timelines and transcripts. Long sessions are cut into day blocks (see ``ordered``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from memlake.operators.ordered import islands, number_rows, running

def count_rows():
    return F.count(F.lit(1))
def day():
    """Block of a row ordered by time."""
    return F.date_trunc("day", F.col("ts").cast("timestamp"))


def fold(events: DataFrame) -> DataFrame:
    """One row per session from events with a ``reason`` (see ``mark_stale``): span, counts, where it is, completion.

    Stale and self-generated events count as processed and nowhere else; the newest accepted event
    names the folder. Which events were processed is told by a digest of their ids that no order changes.
    """
    kept = F.when(F.col("reason").isNull(), F.lit(1))
    newest = F.struct("ts", "event_id")
    return (events.withColumn("__k", kept).groupBy("session_id").agg(
        F.min(F.when(F.col("__k") == 1, F.col("ts"))).alias("first_ts"), F.max(F.when(F.col("__k") == 1, F.col("ts"))).alias("last_ts"),
        count_rows().alias("processed"), F.count("__k").alias("accepted"),
        F.count(F.when(F.col("reason") == "recursion-policy", 1)).alias("recursive"), F.count(F.when(F.col("reason") == "stale-source-binding", 1)).alias("stale"),
        F.bit_xor(F.xxhash64("event_id")).alias("processed_ids"), F.max_by("cwd", F.when((F.col("__k") == 1) & (F.col("cwd") != ""), newest)).alias("cwd"),
        F.count(F.when((F.col("__k") == 1) & (F.col("event") == "UserPromptSubmit"), 1)).alias("prompts"),
        (F.coalesce(F.bool_or((F.col("__k") == 1) & F.col("event").isin("Stop", "SessionEnd")), F.lit(False))).alias("stopped"))
        .withColumn("completed", F.col("stopped") & (F.col("prompts") > 0)).drop("stopped"))


def mark_stale(events: DataFrame, arrival: list[str], block: Column, own: Column) -> DataFrame:
    """An event older than the newest accepted event that arrived before it is stale."""
    rows = running(events.withColumn("__own", own), ["session_id"], arrival, block,
                   {"high": ("max", F.when(~F.col("__own"), F.col("ts")), False)})
    stale = F.coalesce(F.col("ts") < F.col("high"), F.lit(False))
    return rows.withColumn("reason", F.when(stale, "stale-source-binding").when(F.col("__own"), "recursion-policy")).drop("__own", "high")


def session_timeline(events: DataFrame, block: Column) -> DataFrame:
    """The accepted events of each session with their place in it; ``events`` as for ``fold``."""
    return number_rows(events.where("reason IS NULL"), ["session_id"], ["ts", "event_id"], block, "place")


def ready(events: DataFrame, as_of: str, debounce: int) -> DataFrame:
    """Sessions to write: idle for the debounce and not written since, or stopped since the last write."""
    last = events.groupBy("session_id").agg(
        F.max("ts").alias("last_event"), F.max(F.when(F.col("event") == "SessionStart", F.col("ts"))).alias("last_write"),
        F.max(F.when(F.col("event") == "Stop", F.col("ts"))).alias("last_stop"))
    unwritten = F.col("last_write").isNull() | (F.col("last_write") < F.col("last_event"))
    idle = (F.lit(as_of).cast("timestamp_ntz").cast("timestamp").cast("double") - F.col("last_event").cast("timestamp").cast("double")) >= debounce
    flush = F.coalesce(F.col("last_stop") > F.coalesce("last_write", F.lit("1970-01-01").cast("timestamp_ntz")), F.lit(False))
    return last.select("session_id", "last_event", (unwritten & idle).alias("ready"), flush.alias("flush"))


def retry_state(events: DataFrame, as_of: str, park_after: int = 8) -> DataFrame:
    """Back-off of pending sessions: failures since the last success, next attempt, parked after eight."""
    done = events.groupBy("session_id").agg(F.max(F.when(F.col("event") == "Stop", F.col("ts"))).alias("done"))
    failed = (events.where("event = 'PostToolUseFailure'").join(done, "session_id")
              .where(F.col("done").isNull() | (F.col("ts") > F.col("done")))
              .groupBy("session_id").agg(count_rows().alias("attempts"), F.max("ts").alias("last_attempt")))
    delay = F.least(F.lit(3600), 60 * F.pow(F.lit(2.0), F.least(F.col("attempts") - 1, F.lit(6)))).cast("bigint")
    waited = F.lit(as_of).cast("timestamp_ntz").cast("timestamp").cast("double") - F.col("last_attempt").cast("timestamp").cast("double")
    parked = F.col("attempts") >= park_after
    return failed.select("session_id", "attempts", "last_attempt", delay.alias("delay"), parked.alias("parked"), (~parked & (waited >= delay)).alias("due"))


def timeline(events: DataFrame) -> DataFrame:
    """Runs of consecutive rows with the same tool: (session, grp, tool, count, first_ts, last_ts)."""
    marked = islands(events.select("session_id", "ts", "event_id", "name"), ["session_id"], ["ts", "event_id"], day(),
                     F.col("__before") != F.col("name"), "grp", {"__before": F.col("name")})
    return marked.groupBy("session_id", "grp").agg(F.min("name").alias("tool"), count_rows().alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def compress(groups: DataFrame, most: int) -> DataFrame:
    """Long timelines keep ten groups at both ends and one summary row between them."""
    total = groups.groupBy("session_id").agg(count_rows().alias("n"))
    rows = groups.join(total, "session_id")
    long = (F.col("n") > most) & (F.col("n") > 20)
    middle = long & (F.col("grp") > 10) & (F.col("grp") <= F.col("n") - 10)
    ends = rows.where(~middle).select(
        "session_id", F.when(long & (F.col("grp") > 10), F.col("grp") - F.col("n") + 21).otherwise(F.col("grp")).alias("place"),
        "tool", "count", "first_ts", "last_ts", F.lit("").alias("note"))
    by_tool = rows.where(middle).groupBy("session_id", "n", "tool").agg(
        F.sum("count").alias("c"), F.min("first_ts").alias("f"), F.max("last_ts").alias("l"))
    # One entry per tool name: the list below is as long as the tool vocabulary.
    listed = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "tool")))
    names = F.array_join(F.transform(listed, lambda s: F.concat(s["tool"], F.lit("x"), (-s["k"]).cast("string"))), ", ")
    summary = by_tool.groupBy("session_id", "n").agg(F.sum("c").alias("count"), F.min("f").alias("first_ts"), F.max("l").alias("last_ts"), names.alias("names"))
    note = F.concat(F.lit("... "), (F.col("n") - 20).cast("string"), F.lit(" operations ("), F.col("names"), F.lit(") ..."))
    return ends.unionByName(summary.select("session_id", F.lit(11).cast("bigint").alias("place"), F.lit("Summary").alias("tool"), "count", "first_ts", "last_ts", note.alias("note")))


def tool_outcomes(calls: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Calls with their last result: success, failure, or null when the outcome is unknown."""
    last = results.groupBy(*on).agg(F.max_by(F.struct("is_error", "output"), F.struct("ts", "event_id")).alias("r"))
    code = F.try_to_number(F.nullif(F.regexp_extract("r.output", r"(?m)^Process exited with code (-?\d+)\s*$", 1), F.lit("")), F.lit("S9999"))
    failed = F.col("r.is_error") | F.coalesce(code != 0, F.lit(False))
    success = F.when(failed, False).when(code.isNotNull(), True)
    return calls.join(last, on, "left").withColumn("success", success).drop("r")


def first_seen(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Ordered distinct items per key, by first appearance."""
    first = rows.groupBy(key, item).agg(F.min(F.struct("ts", "event_id")).alias("f")).select(key, item, "f.ts", "f.event_id")
    return number_rows(first, [key], ["ts", "event_id", item], day(), "place")


def recent_per_tool(events: DataFrame, each: int, total: int) -> DataFrame:
    """Newest first, at most ``each`` per tool and ``total`` per session; both limits act before the shuffle."""
    newest = [F.desc("ts"), F.desc("event_id")]
    few = events.withColumn("__n", F.row_number().over(W.partitionBy("session_id", "name").orderBy(*newest))).where(F.col("__n") <= each)
    return (few.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy(*newest)).cast("bigint"))
            .where(F.col("place") <= total).drop("__n"))


def budget_prefix(rows: DataFrame, key: str, order: str, size: str, block: Column, most: int, budget: int) -> DataFrame:
    """Rows in order until the count or the byte budget is reached."""
    r = running(rows, [key], [order], block, {"used": ("sum", F.col(size), True), "nth": ("count", F.lit(1), True)})
    return r.where((F.col("used") <= budget) & (F.col("nth") <= most))


def acknowledged(rows: DataFrame, file: str, order: list[str], block: Column, size: str, captured: Column) -> DataFrame:
    """Byte offset of the longest captured prefix of every journal."""
    r = running(rows, [file], order, block, {"__end": ("sum", F.col(size), True)})
    start = F.col("__end") - F.col(size)
    return (r.groupBy(file).agg(F.max("__end").alias("size"), F.min(F.when(~captured, start)).alias("gap"), count_rows().alias("records"))
            .select(file, "records", "size", F.coalesce("gap", "size").alias("offset")))


def active_revisions(entries: DataFrame, scope: str, key: str, sequence: str, supersedes: str) -> DataFrame:
    """Latest entry per key, unless a later entry of its scope superseded the key."""
    latest = entries.groupBy(scope, key).agg(F.max_by(F.struct(*entries.columns), F.col(sequence)).alias("e"))
    dropped = (entries.select(scope, F.explode_outer(supersedes).alias(key), F.col(sequence).alias("__s")).where(F.col(key).isNotNull())
               .groupBy(scope, key).agg(F.max("__s").alias("__s")))
    return latest.join(dropped, [scope, key], "left").where(F.col("__s").isNull() | (F.col("__s") <= F.col(f"e.{sequence}"))).select("e.*")


def visible_before(entries: DataFrame, sequence: str, queries: DataFrame, query: str, cutoff: str) -> DataFrame:
    """How many entries, and which last one, each query may see: strictly before its cutoff.

    One ordered pass over entries and cutoffs together, not a join of every query with every entry.
    """
    e = entries.select(F.col(sequence).alias("s"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("q"))
    q = queries.select(F.col(cutoff).alias("s"), F.lit(0).alias("kind"), F.col(query).alias("q"))
    r = running(e.unionByName(q), [], ["s", "kind", "q"], None,
                {"visible": ("count", F.when(F.col("kind") == 1, 1), False), "last_sequence": ("max", F.when(F.col("kind") == 1, F.col("s")), False)})
    return r.where("kind = 0").select(F.col("q").alias(query), F.col("s").alias(cutoff), "visible", "last_sequence")


def ceiling(ledger: DataFrame) -> DataFrame:
    """Spent plus in-flight money after every ledger event (integer cents)."""
    return running(ledger, [], ["ts", "kind", "call"], None, {"exposure": ("sum", F.col("delta"), True)})


def compare_runs(runs: DataFrame, fingerprint: str, order: str, back: int) -> DataFrame:
    """Each run with its last ``back`` comparable runs. A run is one row per configuration and day."""
    w = W.partitionBy(fingerprint).orderBy(order).rowsBetween(-back, -1)
    metrics = [c for c in runs.columns if c not in (fingerprint, order)]
    return runs.select("*", count_rows().over(w).alias("prior"), *[F.collect_list(c).over(w).alias(f"prior_{c}") for c in metrics])


def upper_middle(values: Column) -> Column:
    v = F.array_sort(values)
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))
