"""Structured Streaming forms: journals, de-duplication, sessions, timers, metrics, index refresh.

Every job takes a streaming DataFrame with an event-time column ``ts`` (timestamp) and returns one.
``drain`` runs a job over what is there and stops, which is also how a scheduled run works.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def as_utc(c: str) -> Column:
    """A zone-less timestamp as the instant it names in UTC, whatever the session zone is."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, {c}))")


def from_utc(c: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), {EPOCH})")


def tail(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """New files of a folder, in arrival order; ``files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Run a job until its input is used up; returns everything the sink holds so far.

    ``timers`` is for jobs with a state processor: these need the store that keeps state on disk.
    """
    spark = stream.sparkSession
    writer = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
              .outputMode(mode).trigger(availableNow=True))
    before = spark.conf.get(PROVIDER, None)
    if timers:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        running = writer.start()  # takes its own copy of the settings
    finally:
        if timers:
            spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())


# -- stateless and windowed jobs ----------------------------------------------------------------------

def dedupe(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def session_windows(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Sessions closed after an idle gap; emitted once the watermark has passed their end."""
    w = F.session_window("ts", gap)
    return (events.withWatermark("ts", delay).groupBy(key, w.alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
            .select(key, F.col("w.start").alias("first_ts"), "last_ts", "events"))


def windowed(events: DataFrame, keys: list[str], width: str, slide: str | None, delay: str, aggs: list[Column]) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), *keys, *[F.col(f"`{n}`") for n in _names(events, keys, aggs)])


def _names(events: DataFrame, keys: list[str], aggs: list[Column]) -> list[str]:
    return [c for c in events.groupBy(*keys).agg(*aggs).columns if c not in keys]


# -- stateful jobs --------------------------------------------------------------------------------------

SESSION_OUT = "session_id long, first_ts timestamp, last_ts timestamp, processed long, stale long, prompts long, reason string"
SESSION_FIELDS = ("session", "processed", "stale", "prompts", "first", "last", "high")
SESSION_STATE = ", ".join([*[f"{name} array<long>" for name in SESSION_FIELDS], "timer long"])
SESSION_BUCKETS = 1024
CLOSING = ("Stop", "SessionEnd")
_NEVER = np.iinfo(np.int64).min


def _sorted(frames: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> pd.DataFrame:
    """The few columns needed of a key's new rows, in order."""
    return pd.concat([f[columns] for f in frames]).sort_values(order)


class Sessions(StatefulProcessor):
    """Folds events into open sessions; a session is emitted once, when it closes, and then forgotten.

    It closes on an accepted ``Stop`` or ``SessionEnd`` (reason ``stop``), or when nothing was accepted for ``gap``
    microseconds (``idle``): seen by the next accepted event, or by a timer once the watermark has passed that time. An event
    behind the high-water mark is counted as stale and changes nothing else. The mark outlives a stop, so that
    stragglers are still told from new work; the timer removes it too. From then on the watermark itself keeps out whatever
    lies behind it, so state never outlives a session's last event by more than gap and watermark delay.

    The sessions of a hash bucket share one state row and one timer, that of the first to end, as a call of Python costs far more
    than the few rows of a session.
    """

    def __init__(self, arrival: list[str], gap: int):
        self.arrival, self.gap = arrival, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", SESSION_STATE)

    def _due(self, high: np.ndarray) -> np.ndarray:
        return -(-(high + self.gap) // 1000)

    def _held(self) -> dict[str, np.ndarray]:
        """State of the bucket's sessions by ascending id."""
        held = self.open.get()[:-1] if self.open.exists() else [[]] * len(SESSION_FIELDS)
        return {name: np.array(v, np.int64) for name, v in zip(SESSION_FIELDS, held)}

    def _keep(self, held: dict[str, np.ndarray], timer: int, now: int) -> None:
        """Write the state; ``timer`` is when the bucket's timer is set to fire, -1 for none."""
        if not len(held["session"]):
            self.open.clear()
            return
        if timer < 0:
            timer = max(int(self._due(held["high"]).min()), now + 1)
            self.handle.registerTimer(timer)
        self.open.update((*[held[name].tolist() for name in SESSION_FIELDS], timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer = self.open.get()[-1] if self.open.exists() else -1
        old = self._held()
        pdf = _sorted(rows, ["session_id", "ts", "event", *self.arrival], ["session_id", *self.arrival])
        at = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        event = pdf["event"].to_numpy()
        ids, begins, of = np.unique(pdf["session_id"].to_numpy(np.int64), return_index=True, return_inverse=True)
        n = len(ids)
        # What the sessions of these rows held before; nothing for a new one.
        spot = np.searchsorted(old["session"], ids)
        known = np.zeros(n, bool)
        inside = spot < len(old["session"])
        known[inside] = old["session"][spot[inside]] == ids[inside]
        was = {name: np.full(n, _NEVER if name in ("first", "last", "high") else 0) for name in SESSION_FIELDS[1:]}
        for name in was:
            was[name][known] = old[name][spot[known]]
        # The mark before each row: the highest time of its session so far.
        top = pd.Series(np.maximum(at, was["high"][of])).groupby(of, sort=False).cummax().to_numpy()
        mark = np.concatenate([[0], top[:-1]])
        mark[begins] = was["high"]
        taken = at >= mark
        closes = taken & np.isin(event, CLOSING)
        breaks = taken & (mark > _NEVER) & (at - self.gap >= mark)
        # The first place of a session is the one that was open before; a stop ends its own place, a break begins one.
        step = np.cumsum(breaks) + np.cumsum(closes) - closes
        before = (np.cumsum(breaks) - breaks + np.cumsum(closes) - closes)[begins]  # steps of the sessions before
        ends = np.append(begins[1:], len(at)) - 1
        local = step - before[of]
        size = local[ends] + 2
        base = np.cumsum(size) - size
        place, total = base[of] + local, int(size.sum())
        count = lambda on: np.bincount(place[on], minlength=total)
        all_, late, asked, stopped = count(slice(None)), count(~taken), count(taken & (event == "UserPromptSubmit")), count(closes) > 0
        begin, end = np.full(total, np.iinfo(np.int64).max), np.full(total, _NEVER)
        np.minimum.at(begin, place[taken], at[taken])
        np.maximum.at(end, place[taken], at[taken])
        for found, name in ((all_, "processed"), (late, "stale"), (asked, "prompts")):
            found[base] += was[name]
        had = was["first"] != _NEVER
        begin[base[had]] = np.minimum(begin[base[had]], was["first"][had])
        end[base[had]] = np.maximum(end[base[had]], was["last"][had])
        now = base + local[ends] + closes[ends]  # the place of each session that is open from here on
        mine = end[now] != _NEVER
        new = {"session": ids, "processed": all_[now], "stale": late[now], "prompts": asked[now],
               "first": np.where(mine, begin[now], _NEVER), "last": end[now], "high": top[ends]}
        rest = np.ones(len(old["session"]), bool)
        rest[spot[known]] = False
        held = {name: np.concatenate([old[name][rest], new[name]]) for name in SESSION_FIELDS}
        order = np.argsort(held["session"])
        held = {name: v[order] for name, v in held.items()}
        first = int(self._due(held["high"]).min())
        if timer < 0 or first < timer:  # a session that ends before all others sets the timer anew
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = -1
        self._keep(held, timer, timerValues.getCurrentWatermarkInMs())
        owner = np.repeat(np.arange(n), size)
        done = np.flatnonzero((all_ > 0) & (np.arange(total) < now[owner]))
        if len(done):
            yield self._rows(ids[owner[done]], begin[done], end[done], all_[done], late[done], asked[done], np.where(stopped[done], "stop", "idle"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        over = self._due(held["high"]) <= now
        self._keep({name: v[~over] for name, v in held.items()}, -1, now)
        done = over & (held["processed"] > 0)
        if done.any():
            yield self._rows(*(held[name][done] for name in ("session", "first", "last", "processed", "stale", "prompts")), "idle")

    @staticmethod
    def _rows(session, first, last, processed, stale, prompts, reason) -> pd.DataFrame:
        some = last != _NEVER  # nothing but stale events has no times
        when = lambda us: pd.Series(np.where(some, us, 0).astype("datetime64[us]")).where(some)
        return pd.DataFrame({"session_id": session, "first_ts": when(first), "last_ts": when(last), "processed": processed, "stale": stale,
                             "prompts": prompts, "reason": reason})

    def close(self) -> None:
        pass


def session_state(events: DataFrame, arrival: list[str], delay: str, gap: str) -> DataFrame:
    """Closed sessions of a stream of (session_id, ts, event, arrival columns), see ``Sessions``; run with ``drain(..., timers=True)``.

    A micro-batch is taken in the order of ``arrival``. Events without a time or session are left out.
    """
    live = (events.where("ts IS NOT NULL AND session_id IS NOT NULL").withWatermark("ts", delay)
            .select(F.pmod(F.xxhash64(F.col("session_id").cast("long")), F.lit(SESSION_BUCKETS)).alias("bucket"), F.col("session_id").cast("long").alias("session_id"), "ts", "event", *arrival))
    processor = Sessions(arrival, int(pd.Timedelta(gap).value // 1000))
    return live.groupBy("bucket").transformWithStateInPandas(processor, SESSION_OUT, "Append", "EventTime")


RETRY_OUT = "session_id long, attempts long, parked boolean, delay long, due timestamp"


def resume_time(value: str | None) -> pd.Timestamp | None:
    """The end of a pause as UTC; None without one. A time that is no ISO time with a zone never comes: the pause does not end."""
    if not value:
        return None
    try:
        at = pd.Timestamp(value)
    except ValueError:
        return pd.Timestamp.max.tz_localize("UTC")
    return pd.Timestamp.max.tz_localize("UTC") if at is pd.NaT or at.tzinfo is None else at.tz_convert("UTC")


def retry_timers(events: DataFrame, delay: str, park_after: int = 8, quiet: str = "1 day", resume_after: str | None = None) -> DataFrame:
    """Back-off per session: failures raise the attempt count, a Stop clears it, ``park_after`` park the session.

    Before ``resume_after`` (a provider's cooldown) a failure uses up no attempt, and nothing is due. ``due`` is when the
    next attempt may run: now plus the delay, but not within the pause; null for a session without failures or parked.

    Pending and parked sessions keep their state until a Stop clears it. A cleared session that stays
    ``quiet`` is forgotten by an event-time timer, which changes nothing: it would start from zero again.
    """
    rest = int(pd.Timedelta(quiet).total_seconds() * 1000)
    resume = resume_time(resume_after)
    begin = np.datetime64("1678-01-01", "us") if resume is None else resume.tz_localize(None).to_datetime64().astype("datetime64[us]")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        attempts, last = state.get if state.exists else (0, 0)
        pdf = _sorted(frames, ["ts", "event_id", "event"], ["ts", "event_id"])
        event, at = pdf["event"].to_numpy(), pdf["ts"].to_numpy().astype("datetime64[us]")
        stops = np.flatnonzero(event == "Stop")
        if len(stops):
            attempts, event, at = 0, event[stops[-1]:], at[stops[-1]:]
        counted = np.flatnonzero((event == "PostToolUseFailure") & (at >= begin))
        if len(counted):
            last = int(at[counted[-1]].astype(np.int64))
        attempts += len(counted)
        state.update((attempts, last))
        if not attempts:
            state.setTimeoutTimestamp(max(int(pdf["ts"].iloc[-1].timestamp() * 1000) + rest, state.getCurrentWatermarkMs() + 1))
        wait = min(3600, 60 * 2 ** min(attempts - 1, 6)) if attempts else 0
        due = np.maximum(np.datetime64(last, "us") + np.timedelta64(wait, "s"), begin) if 0 < attempts < park_after else None
        yield pd.DataFrame({"session_id": [key[0]], "attempts": [attempts], "parked": [attempts >= park_after], "delay": [wait],
                            "due": [pd.NaT if due is None else pd.Timestamp(due)]})

    return (events.withWatermark("ts", delay).groupBy("session_id")
            .applyInPandasWithState(step, RETRY_OUT, "attempts long, last long", "update", GroupStateTimeout.EventTimeTimeout))


SUPPRESS_BUCKETS = 1024
_KEPT = "name string, event_id long"


def suppress_repeats(failures: DataFrame, delay: str, ttl: float) -> DataFrame:
    """Let a failure signature through once per session and time to live.

    The state is one timestamp per (session, signature), dropped when the time to live has passed. The pairs are kept together by
    a bucket of their hash: a call of Python costs far more than the few rows of a pair, and a noisy session
    still spreads over many buckets.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            pdf = _sorted(frames, ["ts", "event_id", "name"], ["ts", "event_id"])
            at = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6
            keep = []
            for i, (name, now) in enumerate(zip(pdf["name"], at.tolist())):
                if now >= last.get(name, float("-inf")) + ttl:
                    keep.append(i)
                    last[name] = now
            yield pdf.iloc[keep][["name", "event_id"]]
        mark = state.getCurrentWatermarkMs()
        last = {name: at for name, at in last.items() if (at + ttl) * 1000 > mark}
        if not last:
            if state.exists:
                state.remove()
            return
        state.update((list(last), list(last.values())))
        state.setTimeoutTimestamp(max(int((min(last.values()) + ttl) * 1000), mark + 1))

    name = F.to_json(F.struct("session_id", "signature"))
    rows = failures.withColumn("name", name).withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(SUPPRESS_BUCKETS)))
    kept = (rows.withWatermark("ts", delay).select("bucket", "name", "ts", "event_id").groupBy("bucket")
            .applyInPandasWithState(step, _KEPT, "names array<string>, last array<double>", "append", GroupStateTimeout.EventTimeTimeout))
    return kept.select(F.from_json("name", "session_id long, signature string").alias("n"), "event_id").select("n.*", "event_id")


# -- index refresh -----------------------------------------------------------------------------------------

MARKS = "version long, upto long"
NOTES = "doc_id long, generation long, batch long"


def _mark(spark: SparkSession, root: str) -> tuple[int, int]:
    """(version, upto): the newest finished merge and the last batch in it; (0, -1) before the first."""
    marks = spark.read.schema(MARKS).parquet(f"{root}/marks").orderBy(F.desc("version")).limit(1).collect()
    return (marks[0].version, marks[0].upto) if marks else (0, -1)


def _held(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """Rows of the newest merge and of the batches after it. A merge that did not end has no mark and is not seen."""
    version, upto = _mark(spark, root)
    found = spark.read.schema(schema).parquet(f"{root}/{name}").where(F.col("batch") > upto)
    if not version:
        return found
    return found.unionByName(spark.read.schema(schema).parquet(f"{root}/merged-{version}/{name}"))


def indexed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """What index ``name`` holds now: rows of the newest generation of each note that it has acknowledged."""
    schema = spark.read.parquet(f"{root}/schema-{name}").schema
    latest = _held(spark, root, f"{name}-notes", NOTES).groupBy("doc_id").agg(F.max("generation").alias("generation"))
    return _held(spark, root, name, schema).join(latest, ["doc_id", "generation"], "left_semi").drop("batch")


def dirty(spark: SparkSession, root: str, changes: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, generation): notes whose newest change some index has not acknowledged, such as arrivals during a refresh."""
    last = changes.groupBy("doc_id").agg(F.max("generation").alias("generation"))
    for name in names:
        done = _held(spark, root, f"{name}-notes", NOTES).groupBy("doc_id").agg(F.max("generation").alias(f"__{name}"))
        last = last.join(done, "doc_id", "left")
    return last.where(" OR ".join(f"`__{n}` IS NULL OR `__{n}` < generation" for n in names)).select("doc_id", "generation")


def merge(spark: SparkSession, root: str, names: list[str], batches: int = 8) -> bool:
    """Merge the batches since the last merge if there are more than ``batches``: only newest generations stay.

    Of an emptied or deleted note its generation stays, as a tombstone: a late older change cannot bring it back. Readers
    see the merge when its mark is written, after all tables; what it replaces is not touched.
    """
    version, upto = _mark(spark, root)
    last = spark.read.schema(NOTES).parquet(f"{root}/{names[0]}-notes").where(F.col("batch") > upto).agg(F.max("batch").alias("b"), F.countDistinct("batch").alias("n")).first()
    if last.n <= batches:
        return False
    for name in names:
        target = f"{root}/merged-{version + 1}/{name}"
        indexed(spark, root, name).withColumn("batch", F.lit(last.b).cast("long")).write.mode("overwrite").parquet(target)
        notes = _held(spark, root, f"{name}-notes", NOTES).groupBy("doc_id").agg(F.max("generation").alias("generation"), F.max("batch").alias("batch"))
        notes.write.mode("overwrite").parquet(f"{target}-notes")
    spark.createDataFrame([(version + 1, last.b)], MARKS).coalesce(1).write.mode("append").parquet(f"{root}/marks")
    return True


def refresh_index(spark: SparkSession, changes: DataFrame, root: str, builds: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str, batches: int = 8,
                  prepare: Callable[[DataFrame], DataFrame] = lambda notes: notes) -> None:
    """Bring each index of ``builds`` up to the changes (doc_id, generation, ...) that are there when the run starts.

    A micro-batch builds the rows (doc_id, generation, ...) of its changed notes for every index, say postings and vectors, and
    then acknowledges the generation of every note that it saw, whether or not rows came of it: an emptied or deleted
    note (null text) so hides its older rows. Batches are written under their own id, so a replayed batch overwrites
    itself. What arrives during a run stays ``dirty`` until a second run acknowledges it. Many batches are merged.
    What all builds need, such as the words of a note, ``prepare`` works out once per batch; it keeps a row (doc_id, generation, ...) for each note.
    """
    spark.createDataFrame([], MARKS).write.mode("append").parquet(f"{root}/marks")  # the folder is there from now on
    typed = spark.createDataFrame([], changes.schema)
    for name, build in builds.items():
        build(prepare(typed)).withColumn("batch", F.lit(0).cast("long")).limit(0).write.mode("overwrite").parquet(f"{root}/schema-{name}")

    def apply(batch: DataFrame, batch_id: int) -> None:
        newest = prepare(batch.groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), "generation").alias("n")).select("n.*")).persist()
        for name, build in builds.items():
            build(newest).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
            newest.select("doc_id", "generation").write.mode("overwrite").parquet(f"{root}/{name}-notes/batch={batch_id}")
        newest.unpersist()

    drain_batches(changes, apply, checkpoint)
    merge(spark, root, list(builds), batches)


# -- generations and retention (batch views over the change log) ----------------------------------------------

def generations(log: DataFrame) -> DataFrame:
    """Notes still dirty: newest change above what both index kinds acknowledged, or not saved yet."""
    acks = log.where("kind <> 'change'").groupBy("scope").agg(
        F.max(F.when(F.col("kind") == "lexical", F.col("generation"))).alias("lexical"), F.max(F.when(F.col("kind") == "vector", F.col("generation"))).alias("vector"))
    last = log.where("kind = 'change'").groupBy("scope", "doc_id").agg(F.max_by(F.struct("generation", "saved"), "generation").alias("c"))
    done = F.least(F.coalesce("lexical", F.lit(0)), F.coalesce("vector", F.lit(0)))
    return (last.join(acks, "scope", "left").where((F.col("c.generation") > done) | ~F.col("c.saved"))
            .select("scope", "doc_id", F.col("c.generation").alias("generation"), F.col("c.saved").alias("saved")))


def deletable(records: DataFrame, journal: str, today: str, keep_days: int) -> DataFrame:
    """Journals older than the limit whose records are all valid and captured."""
    per = records.groupBy(journal).agg(F.count(F.lit(1)).alias("records"), F.bool_and(F.col("valid") & F.col("captured")).alias("done"))
    age = F.datediff(F.lit(today).cast("date"), F.to_date(journal))
    return per.where(F.col("done") & (age > keep_days)).select(journal, "records")
