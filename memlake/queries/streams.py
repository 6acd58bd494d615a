"""Streaming family. Inputs arrive as three slices in event order, each drained before the next is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import failures as fl
from memlake.operators import index as ix, metrics as mt
from memlake.queries import demo
from memlake.queries.demo import HOOKS
from memlake.queries.evals import LOG_COLS
from memlake.queries.failures import TEXT
from memlake.queries.retrieval import TOK
from memlake.registry import query
from memlake.sources.files import scratch
from memlake.streaming import jobs as sj

SLICES = 3


def _slices(t, rows, resend: bool = False, flush: dict | None = None):
    """``rows`` (with ``event_id`` and zone-less ``ts``) in slices by event id.

    ``resend`` repeats the first slice with the last one. ``flush`` adds one far-future row at the end that
    moves the watermark past all real data.
    """
    n = t.events.count()
    rows = rows.withColumn("ts", sj.as_utc("ts"))
    part = F.floor(F.col("event_id") * SLICES / n)
    for i in range(SLICES):
        yield rows.where((part == i) | (part == 0) if resend and i == SLICES - 1 else part == i)
    if flush is not None:
        yield t.spark.range(1).select(*[F.lit(flush.get(f.name)).cast(f.dataType).alias(f.name) if f.name != "ts"
                                        else F.lit("2099-01-01").cast("timestamp").alias("ts") for f in rows.schema.fields])


def _arrivals(t, slices):
    """Write each slice, by as many tasks as it has partitions, and hand over the stream of the folder.

    A run takes all files that came since the last one as one micro-batch, so slices keep their order
    however many files they have.
    """
    path = scratch(t.spark, "stream")
    for rows in slices:
        rows.write.mode("append").parquet(path)
        yield sj.tail(t.spark, path, rows.schema)


def _drain(t, slices, job, timers: bool = False):
    """Rows that ``job`` has written once all slices are through."""
    out, checkpoint = scratch(t.spark, "out"), scratch(t.spark, "checkpoint")
    for stream in _arrivals(t, slices):
        rows = sj.drain(job(stream), out, checkpoint, timers=timers)
    return rows


def _updates(t, slices, job):
    """Every row that an update-mode job has emitted, with the batch (``at``) that emitted it."""
    seen, checkpoint = scratch(t.spark, "state"), scratch(t.spark, "checkpoint")
    for stream in _arrivals(t, slices):
        sj.drain_batches(job(stream), lambda b, i: b.write.mode("overwrite").parquet(f"{seen}/at={i}"), checkpoint, "update")
    return t.spark.read.parquet(seen)


@query("stream_journal", f"WITH {HOOKS} SELECT event_id, session_id, event FROM hooks")
def stream_journal(t):
    """Two runs with one checkpoint: the second resumes where the first stopped and delivers only what is new."""
    h = demo.hooks(t).select("event_id", "session_id", "event")
    path, out, cp = (scratch(t.spark, n) for n in ("journal", "out", "checkpoint"))
    for half in ("event_id % 2 = 0", "event_id % 2 = 1"):
        h.where(half).write.mode("append").parquet(path)
        rows = sj.drain(sj.tail(t.spark, path, h.schema), out, cp)
    return rows


@query("stream_dedupe", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def stream_dedupe(t):
    slices = _slices(t, t.events.select("event_id", "ts", "event_type"), resend=True)
    return _drain(t, slices, lambda s: sj.dedupe(s, "40 days")).groupBy("event_type").agg(mt.count_rows().alias("n"), F.sum("event_id").alias("ids"))


@query("stream_session_windows", """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM g GROUP BY user_id, g""")
def stream_session_windows(t):
    slices = _slices(t, t.events.select("event_id", "user_id", "ts"), flush={"user_id": -1, "event_id": -1})
    out = _drain(t, slices, lambda s: sj.session_windows(s, "user_id", "6 hours", "1 hour"))
    return out.where("user_id >= 0").select("user_id", sj.from_utc("first_ts").alias("first_ts"), sj.from_utc("last_ts").alias("last_ts"), "events")


GAP_H = 6
# Places as the fold counts them: a stop ends its place, an accepted event after an idle gap begins one.
FOLD = f"""{HOOKS}, a AS (SELECT *, floor(event_id * 3 / (SELECT count(*) FROM events)) AS sl FROM hooks),
 b0 AS (SELECT *, max(ts) OVER (PARTITION BY session_id ORDER BY sl, k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM a),
 b1 AS (SELECT *, coalesce(ts < high, false) AS late, ts >= high + INTERVAL {GAP_H} HOUR AS gap FROM b0),
 b AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER w + sum(CASE WHEN event = 'Stop' AND NOT late THEN 1 ELSE 0 END) OVER w - CASE WHEN event = 'Stop' AND NOT late THEN 1 ELSE 0 END AS place
   FROM b1 WINDOW w AS (PARTITION BY session_id ORDER BY sl, k, event_id ROWS UNBOUNDED PRECEDING))"""


def _closed(t):
    """Every closed session: all are, once the watermark has passed the last event."""
    rows = demo.hooks(t).select("event_id", "session_id", "event", "ts", "k")
    slices = _slices(t, rows, flush={"session_id": -1, "event_id": -1, "event": "SessionStart", "k": 0})
    out = _drain(t, slices, lambda s: sj.session_state(s, ["k", "event_id"], "1 hour", f"{GAP_H} hours"), timers=True)
    return out.where("session_id >= 0")


@query("stream_session_state", f"""WITH {FOLD} SELECT session_id, min(CASE WHEN NOT late THEN ts END) AS first_ts, max(CASE WHEN NOT late THEN ts END) AS last_ts, count(*) AS processed,
 count(CASE WHEN NOT late AND event = 'UserPromptSubmit' THEN 1 END) AS prompts, CASE WHEN bool_or(event = 'Stop' AND NOT late) THEN 'stop' ELSE 'idle' END AS reason FROM b GROUP BY session_id, place""")
def stream_session_state(t):
    return _closed(t).select("session_id", sj.from_utc("first_ts").alias("first_ts"), sj.from_utc("last_ts").alias("last_ts"), "processed", "prompts", "reason")


@query("stream_late_drop", f"WITH {FOLD} SELECT session_id, count(*) AS processed, count(CASE WHEN late THEN 1 END) AS stale FROM b GROUP BY session_id")
def stream_late_drop(t):
    return _closed(t).groupBy("session_id").agg(F.sum("processed").alias("processed"), F.sum("stale").alias("stale"))


# The provider asks for a pause up to this time: failures before it use up no attempt.
RESUME = "2024-01-10T06:00:00Z"
RETRY = f"""{HOOKS}, q AS (SELECT session_id, event, ts, event_id, count(CASE WHEN event = 'Stop' THEN 1 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS run
  FROM hooks WHERE event IN ('Stop', 'PostToolUseFailure')),
 l AS (SELECT session_id, max(run) AS run FROM q GROUP BY session_id),
 a0 AS (SELECT session_id, event = 'PostToolUseFailure' AND ts >= TIMESTAMP '2024-01-10 06:00:00' AS counts, ts FROM q JOIN l USING (session_id, run)),
 a1 AS (SELECT session_id, count(CASE WHEN counts THEN 1 END) AS attempts, max(CASE WHEN counts THEN ts END) AS last FROM a0 GROUP BY session_id),
 a AS (SELECT *, CASE WHEN attempts = 0 THEN 0 ELSE least(3600, 60 * pow(2, least(attempts - 1, 6))) END::BIGINT AS delay FROM a1)"""


@query("stream_retry_timers", f"WITH {RETRY} SELECT session_id, attempts, attempts >= 8 AS parked, delay, CASE WHEN attempts BETWEEN 1 AND 7 THEN greatest(last + to_seconds(delay), TIMESTAMP '2024-01-10 06:00:00') END AS due FROM a")
def stream_retry_timers(t):
    slices = _slices(t, demo.hooks(t).where("event IN ('Stop', 'PostToolUseFailure')").select("event_id", "session_id", "event", "ts"))
    rows = _updates(t, slices, lambda s: sj.retry_timers(s, "1 hour", resume_after=RESUME))
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("attempts", "parked", "delay", "due"), "at").alias("s")).select("session_id", "s.*")
    return last.withColumn("due", sj.from_utc("due"))


def _failures(t):
    f = fl.analysed(demo.failures(t))
    return f.select("event_id", F.col("user_id").alias("session_id"), "ts", "kind", "signature")


@query("stream_ttl_suppress", TEXT.replace("WITH ", "WITH RECURSIVE ", 1) + r""", sg AS (SELECT event_id, user_id AS session_id, ts, substr(sha1(kind || chr(10) || regexp_replace(line, '\d+', '#', 'g')), 1, 12) AS signature FROM an),
 f AS (SELECT *, row_number() OVER (PARTITION BY session_id, signature ORDER BY ts, event_id) AS k FROM sg),
 r AS (SELECT event_id, session_id, ts, signature FROM f WHERE k = 1 UNION ALL SELECT event_id, session_id, ts, signature FROM (
   SELECT f.*, row_number() OVER (PARTITION BY f.session_id, f.signature ORDER BY f.k) AS nth FROM r JOIN f ON f.session_id = r.session_id AND f.signature = r.signature AND f.ts >= r.ts + INTERVAL 6 HOUR) WHERE nth = 1)
 SELECT session_id, signature, event_id FROM r""")
def stream_ttl_suppress(t):
    """Once per signature and time to live."""
    return _drain(t, _slices(t, _failures(t)), lambda s: sj.suppress_repeats(s, "1 hour", ttl=6 * 3600.0))


@query("stream_failure_class", TEXT + " SELECT date_trunc('hour', ts) AS start, kind, count(*) AS n FROM an GROUP BY ALL")
def stream_failure_class(t):
    slices = _slices(t, _failures(t), flush={"kind": "flush", "event_id": -1})
    out = _drain(t, slices, lambda s: sj.windowed(s, ["kind"], "1 hour", None, "1 hour", [mt.count_rows().alias("n")]))
    return out.where("kind <> 'flush'").select(sj.from_utc("start").alias("start"), "kind", "n")


DAILY = f"""WITH l AS (SELECT {LOG_COLS} FROM events), k AS (SELECT * FROM l WHERE status IN ('hit', 'miss')),
 w AS (SELECT 'day' AS width, date_trunc('day', ts) AS start, * FROM k UNION ALL SELECT 'week', date_trunc('day', ts) - to_days(CAST(o AS INTEGER)), k.* FROM k, (SELECT unnest(range(0, 7)) AS o))
 SELECT width, start::TIMESTAMP AS start, count(*) AS prompts, sum((status = 'hit')::INT)::BIGINT AS hits, sum(ms)::BIGINT AS ms FROM w GROUP BY width, start"""


@query("stream_daily_metrics", DAILY)
def stream_daily_metrics(t):
    log = demo.project(t.events, LOG_COLS).where("status IN ('hit', 'miss')").select("event_id", "ts", "status", "ms")
    aggs = [mt.count_rows().alias("prompts"), F.sum((F.col("status") == "hit").cast("bigint")).alias("hits"), F.sum("ms").alias("ms")]
    outs = []
    for width, span, slide in (("day", "1 day", None), ("week", "7 days", "1 day")):
        slices = _slices(t, log, flush={"status": "flush", "event_id": -1, "ms": 0})
        rows = _drain(t, slices, lambda s: sj.windowed(s, [], span, slide, "1 day", aggs))
        outs.append(rows.where("start < TIMESTAMP '2098-01-01 00:00:00'").select(F.lit(width).alias("width"), sj.from_utc("start").alias("start"), "prompts", "hits", "ms"))
    return outs[0].unionByName(outs[1])


VECTOR = 4  # places of a note's vector: its words by length


@query("stream_index_refresh", rf"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS generation, CASE WHEN doc_id % 35 = 0 THEN NULL WHEN doc_id % 25 = 0 THEN '' WHEN doc_id % 5 = 0 THEN text || ' third' WHEN doc_id % 3 = 0 THEN text || ' second' ELSE text END AS x FROM documents),
 w AS (SELECT doc_id, generation, regexp_extract_all(lower(x), {TOK}) AS ws FROM v WHERE regexp_matches(x, {TOK}))
 SELECT doc_id, generation, len(list_distinct(ws)) AS terms, len(ws) AS tokens, {", ".join(f"len(list_filter(ws, lambda t: length(t) % {VECTOR} = {i})) AS v{i}" for i in range(VECTOR))} FROM w""")
def stream_index_refresh(t):
    """Three generations of changes; the last one also empties some notes and deletes others. Two batches are merged on the way."""
    d = t.documents.select("doc_id", F.lit(1).cast("bigint").alias("generation"), "text")
    third = F.expr("CASE WHEN doc_id % 35 = 0 THEN NULL WHEN doc_id % 25 = 0 THEN '' ELSE text || ' third' END")
    slices = [d.where(cond).select("doc_id", F.lit(g).cast("bigint").alias("generation"), text.alias("text"))
              for g, cond, text in ((1, "true", F.col("text")), (2, "doc_id % 3 = 0", F.expr("text || ' second'")), (3, "doc_id % 5 = 0", third))]
    ids = ["doc_id", "generation"]
    words = lambda notes: ix.counted(ix.tokenized(notes, ids, {"body": F.coalesce("text", F.lit(""))}), ids)

    def vectors(notes):
        held = F.get("fields", F.lit(0))["counts"]
        place = lambda i: F.aggregate(F.filter(held, lambda x: F.length(x["term"]) % VECTOR == i), F.lit(0).cast("bigint"), lambda n, x: n + x["tf"])
        return notes.where("len > 0").select(*ids, F.array(*map(place, range(VECTOR))).alias("vector"))

    # The postings of a note stay in its row, so that runs and merges join notes, not postings.
    builds = {"postings": lambda notes: notes.where("len > 0"), "vectors": vectors}
    root, checkpoint = scratch(t.spark, "index"), scratch(t.spark, "checkpoint")
    for stream in _arrivals(t, slices):
        sj.refresh_index(t.spark, stream, root, builds, checkpoint, batches=1, prepare=words)
    counts = (ix.exploded(sj.indexed(t.spark, root, "postings"), ids).groupBy(*ids)
              .agg(mt.count_rows().alias("terms"), F.sum("tf").alias("tokens")))
    return counts.join(sj.indexed(t.spark, root, "vectors"), ids).select(
        "doc_id", F.col("generation").cast("int").alias("generation"), "terms", "tokens", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(VECTOR)])


CHANGES = "user_id AS scope, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS doc_id, event_id AS generation, CASE event_type WHEN 'purchase' THEN 'lexical' WHEN 'signup' THEN 'vector' ELSE 'change' END AS kind, value > 5 AS saved"


@query("freshness_generations", f"""WITH l AS (SELECT {CHANGES} FROM events), a AS (SELECT scope, max(CASE WHEN kind = 'lexical' THEN generation END) AS lx, max(CASE WHEN kind = 'vector' THEN generation END) AS vc FROM l GROUP BY scope),
 c AS (SELECT scope, doc_id, max(generation) AS generation, arg_max(saved, generation) AS saved FROM l WHERE kind = 'change' GROUP BY ALL)
 SELECT scope, doc_id, generation, saved FROM c JOIN a USING (scope) WHERE generation > least(coalesce(lx, 0), coalesce(vc, 0)) OR NOT saved""")
def freshness_generations(t):
    return sj.generations(demo.project(t.events, CHANGES))


@query("retention", f"""WITH {HOOKS}, r AS (SELECT strftime(ts, '%Y-%m-%d') AS journal, value > 0.15 AS valid, event_id % 4001 <> 17 AS captured FROM hooks)
 SELECT journal, count(*) AS records FROM r GROUP BY journal HAVING bool_and(valid AND captured) AND date_diff('day', CAST(journal AS DATE), DATE '2024-01-31') > 7""")
def retention(t):
    r = demo.hooks(t).select(F.date_format("ts", "yyyy-MM-dd").alias("journal"), (F.col("value") > 0.15).alias("valid"), (F.col("event_id") % 4001 != 17).alias("captured"))
    return sj.deletable(r, "journal", "2024-01-31", 7)
