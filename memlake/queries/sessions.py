"""Sessions, timelines, windows over runs and ledgers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import metrics as mt, sessions as ss
from memlake.operators.ordered import number_rows, running
from memlake.queries import demo
from memlake.queries.demo import HOOKS
from memlake.queries.evals import DIGEST_SQL
from memlake.registry import query

OWN_SQL = "contains(cwd, '.memlake')"
AS_OF = "2024-01-30 23:58:00"


def _own():
    return tx.self_generated(F.col("cwd"), F.col("data"), [".memlake"])


REASON_SQL = f"""{HOOKS}, h0 AS (SELECT *, max(CASE WHEN NOT {OWN_SQL} THEN ts END) OVER (PARTITION BY session_id ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM hooks),
 h AS (SELECT *, coalesce(ts < high, false) AS late, CASE WHEN coalesce(ts < high, false) THEN 'stale-source-binding' WHEN {OWN_SQL} THEN 'recursion-policy' END AS reason FROM h0), hk AS (SELECT * FROM h WHERE reason IS NULL)"""


def reasoned(t):
    """Hook events with the reason that keeps them out of their session, by order of arrival."""
    return ss.mark_stale(demo.hooks(t), ["k", "event_id"], F.col("k"), _own())


@query("session_fold", f"""WITH {REASON_SQL}, c AS (SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS accepted, count(CASE WHEN event = 'UserPromptSubmit' THEN 1 END) AS prompts, bool_or(event = 'Stop') AS stopped,
   last(CASE WHEN cwd <> '' THEN cwd END ORDER BY cwd <> '', ts, event_id) AS cwd FROM hk GROUP BY session_id)
 SELECT h.session_id, first_ts, last_ts, count(*) AS processed, coalesce(accepted, 0) AS accepted, count(CASE WHEN reason = 'recursion-policy' THEN 1 END) AS recursive, count(CASE WHEN late THEN 1 END) AS stale, c.cwd,
  coalesce(prompts, 0) AS prompts, coalesce(stopped AND prompts > 0, false) AS completed FROM h LEFT JOIN c USING (session_id) GROUP BY ALL""")
def session_fold(t):
    return ss.fold(reasoned(t)).drop("processed_ids")


@query("session_timeline", f"WITH {REASON_SQL} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS place, event_id, event FROM hk")
def session_timeline(t):
    """The ordered events that a session is summarized from."""
    return ss.session_timeline(reasoned(t), ss.day()).select("session_id", "place", "event_id", "event")


@query("stale_events", f"""WITH {HOOKS}, h AS (SELECT *, max(CASE WHEN NOT {OWN_SQL} THEN ts END) OVER (PARTITION BY session_id ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM hooks)
 SELECT event_id, session_id, CASE WHEN ts < high THEN 'stale-source-binding' WHEN {OWN_SQL} THEN 'recursion-policy' END AS reason FROM h""")
def stale_events(t):
    return ss.mark_stale(demo.hooks(t), ["k", "event_id"], F.col("k"), _own()).select("event_id", "session_id", "reason")


@query("sessions_ready", f"""WITH {HOOKS}, l AS (SELECT session_id, max(ts) AS last_event, max(CASE WHEN event = 'SessionStart' THEN ts END) AS w, max(CASE WHEN event = 'Stop' THEN ts END) AS s FROM hooks GROUP BY session_id)
 SELECT session_id, last_event, (w IS NULL OR w < last_event) AND epoch(TIMESTAMP '{AS_OF}') - epoch(last_event) >= 900 AS ready, coalesce(s > coalesce(w, TIMESTAMP '1970-01-01'), false) AS flush FROM l""")
def sessions_ready(t):
    return ss.ready(demo.hooks(t), AS_OF, 900)


@query("synthesis_due", f"""WITH {HOOKS}, d AS (SELECT session_id, max(CASE WHEN event = 'Stop' THEN ts END) AS done FROM hooks GROUP BY session_id),
 f AS (SELECT session_id, count(*) AS attempts, max(ts) AS last_attempt FROM hooks JOIN d USING (session_id) WHERE event = 'PostToolUseFailure' AND (done IS NULL OR ts > done) GROUP BY session_id),
 g AS (SELECT *, least(3600, 60 * pow(2, least(attempts - 1, 6)))::BIGINT AS delay, attempts >= 8 AS parked FROM f)
 SELECT session_id, attempts, last_attempt, delay, parked, NOT parked AND epoch(TIMESTAMP '{AS_OF}') - epoch(last_attempt) >= delay AS due FROM g""")
def synthesis_due(t):
    return ss.retry_state(demo.hooks(t), AS_OF)


@query("transcript_summary", f"""WITH {HOOKS} SELECT session_id, CASE WHEN event LIKE 'PostToolUse%' THEN tool ELSE event END AS name, count(*) AS n, sum((event = 'PostToolUseFailure')::INT)::BIGINT AS errors,
 count(DISTINCT CASE WHEN event LIKE 'PostToolUse%' THEN data->>'$.tool_input.file_path' END) AS files FROM hooks GROUP BY ALL""")
def transcript_summary(t):
    h = _named(t)
    path = F.when(F.col("event").startswith("PostToolUse"), F.get_json_object("data", "$.tool_input.file_path"))
    return h.groupBy("session_id", "name").agg(mt.count_rows().alias("n"), F.sum((F.col("event") == "PostToolUseFailure").cast("bigint")).alias("errors"), F.countDistinct(path).alias("files"))


def _named(t):
    """Hook events with the name a timeline shows: the tool, else the event."""
    return demo.hooks(t).withColumn("name", F.when(F.col("event").startswith("PostToolUse"), F.col("tool")).otherwise(F.col("event")))


RECORD = "CASE WHEN event_id % 41 = 0 THEN substr(data, 1, length(data) - 1) ELSE data END"


@query("coverage_report", f"""WITH {HOOKS}, r AS (SELECT *, {RECORD} AS rec FROM hooks) SELECT cwd AS source, count(*) AS records, sum((NOT json_valid(rec))::INT)::BIGINT AS malformed,
 sum((event = 'PostToolUse')::INT)::BIGINT AS unknown_outcomes, sum(strlen(rec) + 1)::BIGINT AS bytes FROM r GROUP BY cwd""")
def coverage_report(t):
    r = demo.hooks(t).withColumn("rec", F.expr(RECORD))
    return r.groupBy(F.col("cwd").alias("source")).agg(
        mt.count_rows().alias("records"), F.sum(F.try_parse_json("rec").isNull().cast("bigint")).alias("malformed"),
        F.sum((F.col("event") == "PostToolUse").cast("bigint")).alias("unknown_outcomes"), F.sum(F.octet_length("rec").cast("bigint") + 1).alias("bytes"))


GROUPS = f"""{HOOKS}, nm AS (SELECT *, CASE WHEN event LIKE 'PostToolUse%' THEN tool ELSE event END AS name FROM hooks),
 fl AS (SELECT *, CASE WHEN lag(name) OVER w = name THEN 0 ELSE 1 END AS f FROM nm WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
 ig AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY ts, event_id)::BIGINT AS grp FROM fl),
 grps AS (SELECT session_id, grp, min(name) AS tool, count(*) AS "count", min(ts) AS first_ts, max(ts) AS last_ts FROM ig GROUP BY session_id, grp)"""


@query("timeline_groups", f"WITH {GROUPS} SELECT * FROM grps")
def timeline_groups(t):
    return ss.timeline(_named(t))


@query("timeline_compress", f"""WITH {GROUPS}, n AS (SELECT session_id, count(*) AS n FROM grps GROUP BY session_id), r AS (SELECT *, n > 30 AS long FROM grps JOIN n USING (session_id)),
 bt AS (SELECT session_id, n, tool, sum("count") AS c, min(first_ts) AS f, max(last_ts) AS l FROM r WHERE long AND grp > 10 AND grp <= n - 10 GROUP BY ALL)
 SELECT session_id, CASE WHEN long AND grp > 10 THEN grp - n + 21 ELSE grp END AS place, tool, "count", first_ts, last_ts, '' AS note FROM r WHERE NOT (long AND grp > 10 AND grp <= n - 10)
 UNION ALL SELECT session_id, 11, 'Summary', sum(c)::BIGINT, min(f), max(l), '... ' || (n - 20) || ' operations (' || string_agg(tool || 'x' || c::BIGINT, ', ' ORDER BY c DESC, tool) || ') ...' FROM bt GROUP BY session_id, n""")
def timeline_compress(t):
    return ss.compress(ss.timeline(_named(t)), most=30)


@query("import_ordinals", f"""WITH {HOOKS}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id, event ORDER BY ts, event_id) AS ordinal FROM hooks)
 SELECT event_id, session_id, event, ordinal, coalesce(ordinal < max(ordinal) OVER (PARTITION BY session_id, event ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM o""")
def import_ordinals(t):
    numbered = number_rows(demo.hooks(t).select("event_id", "session_id", "event", "ts", "k"), ["session_id", "event"], ["ts", "event_id"], ss.day(), "ordinal")
    r = running(numbered, ["session_id", "event"], ["k", "event_id"], F.col("k"), {"high": ("max", F.col("ordinal"), False)})
    return r.select("event_id", "session_id", "event", "ordinal", F.coalesce(F.col("ordinal") < F.col("high"), F.lit(False)).alias("stale"))


ENTRY_COLS = "doc_id, source AS scope, 'k' || doc_id % 40 AS key, CAST(doc_id AS BIGINT) AS sequence, CASE WHEN doc_id % 10 = 0 THEN 'k' || (doc_id + 20) % 40 END AS drops"


def entries(t):
    return demo.project(t.documents, ENTRY_COLS).withColumn("supersedes", F.array_compact(F.array("drops")))


@query("active_revision", f"""WITH e AS (SELECT {ENTRY_COLS} FROM documents), l AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY sequence DESC) AS rn FROM e)
 SELECT doc_id, scope, key, sequence FROM l WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.scope = l.scope AND x.drops = l.key AND x.sequence > l.sequence)""")
def active_revision(t):
    return ss.active_revisions(entries(t), "scope", "key", "sequence", "supersedes").select("doc_id", "scope", "key", "sequence")


@query("frozen_cutoff", """WITH q AS (SELECT item_id, item_id * 23 AS cutoff FROM benchmark) SELECT item_id, cutoff, count(doc_id) AS visible, max(doc_id) AS last_sequence FROM q LEFT JOIN documents ON doc_id < cutoff GROUP BY ALL""")
def frozen_cutoff(t):
    q = t.benchmark.select("item_id", (F.col("item_id") * 23).alias("cutoff"))
    return ss.visible_before(t.documents, "doc_id", q, "item_id", "cutoff")


@query("ack_prefix", f"""WITH {HOOKS}, f AS (SELECT strftime(ts, '%Y-%m-%d') AS file, value >= 0.2 AS captured, strlen(data) + 1 AS size, sum(strlen(data) + 1) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS e FROM hooks)
 SELECT file, count(*) AS records, max(e)::BIGINT AS size, coalesce(min(CASE WHEN NOT captured THEN e - size END), max(e))::BIGINT AS "offset" FROM f GROUP BY file""")
def ack_prefix(t):
    h = demo.hooks(t).select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("file"), (F.octet_length("data") + 1).cast("bigint").alias("size"))
    return ss.acknowledged(h, "file", ["event_id"], F.floor(F.col("event_id") / 1000), "size", F.col("value") >= 0.2)


@query("budget_prefix", """WITH r AS (SELECT doc_id, source, sum(octet_length(encode(text))) OVER w AS used, row_number() OVER w AS nth FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
 SELECT doc_id, source, used::BIGINT AS used, nth FROM r WHERE used <= 40000 AND nth <= 25""")
def budget_prefix(t):
    d = t.documents.select("doc_id", "source", F.octet_length("text").cast("bigint").alias("size"))
    return ss.budget_prefix(d, "source", "doc_id", "size", F.floor(F.col("doc_id") / 1000), most=25, budget=40_000).select("doc_id", "source", "used", "nth")


@query("stratified_sample", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS rn FROM documents)
 SELECT doc_id, lang, rn FROM r ORDER BY rn, lang LIMIT 60""")
def stratified_sample(t):
    w = W.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id")
    few = t.documents.select("doc_id", "lang").withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 60")
    return few.orderBy("rn", "lang").limit(60)


@query("candidate_cap", """SELECT doc_id, lang, rn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE n_chars >= 300 AND lang IN ('en', 'de', 'es')) WHERE rn <= 40""")
def candidate_cap(t):
    w = W.partitionBy("lang").orderBy("doc_id")
    ok = t.documents.where("n_chars >= 300 AND lang IN ('en', 'de', 'es')").select("doc_id", "lang")
    return ok.withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 40")


@query("per_tool_recent", f"""WITH {GROUPS}, a AS (SELECT session_id, event_id, name, ts, row_number() OVER (PARTITION BY session_id, name ORDER BY ts DESC, event_id DESC) AS n FROM nm)
 SELECT * FROM (SELECT session_id, event_id, name, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS place FROM a WHERE n <= 3) WHERE place <= 12""")
def per_tool_recent(t):
    return ss.recent_per_tool(_named(t), 3, 12).select("session_id", "event_id", "name", "place")


@query("turn_bounds", """SELECT conv_id, turn, role, (SELECT min(turn) FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn > c.turn AND n.role = 'user') AS next_prompt FROM conversations c""")
def turn_bounds(t):
    c = t.conversations.select("conv_id", "turn", "role")
    return running(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000),
                   {"next_prompt": ("last", F.when(F.col("role") == "user", F.col("turn")), False)}, reverse=True)


# -- runs ----------------------------------------------------------------------------------------

RUNS = """runs AS (SELECT event_type AS fingerprint, strftime(ts, '%Y-%m-%d') AS day, count(*) AS scheduled, round(avg((value > 30)::INT), 6) AS hit, round(avg((value > 90)::INT), 6) AS junk,
 round(avg((value < 5)::INT), 6) AS unavailable, max(CAST(round(value * 10) AS BIGINT)) AS p95 FROM events GROUP BY ALL)"""


def runs(t):
    rate = lambda c, a: F.round(F.avg(c.cast("int")), 6).alias(a)
    v = F.col("value")
    return (t.events.groupBy(F.col("event_type").alias("fingerprint"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
            .agg(mt.count_rows().alias("scheduled"), rate(v > 30, "hit"), rate(v > 90, "junk"), rate(v < 5, "unavailable"), F.max(F.round(v * 10).cast("bigint")).alias("p95")))


@query("comparable_runs", f"WITH {RUNS} SELECT fingerprint, day, hit, count(*) OVER w AS prior, min(day) OVER w AS oldest FROM runs WINDOW w AS (PARTITION BY fingerprint ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def comparable_runs(t):
    w = W.partitionBy("fingerprint").orderBy("day").rowsBetween(-5, -1)
    return ss.compare_runs(runs(t), "fingerprint", "day", 5).select("fingerprint", "day", "hit", "prior", F.min("day").over(w).alias("oldest"))


MED = lambda c: f"list_sort(list({c}) OVER w)[len(list({c}) OVER w) // 2 + 1] AS m_{c}"


@query("metric_regressions", f"""WITH {RUNS}, m AS (SELECT *, {', '.join(MED(c) for c in ('hit', 'junk', 'unavailable', 'p95'))} FROM runs WINDOW w AS (PARTITION BY fingerprint ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT fingerprint, day, 'hit' AS finding FROM m WHERE round(m_hit - hit, 6) >= 0.08 UNION ALL SELECT fingerprint, day, 'junk' FROM m WHERE round(junk - m_junk, 6) >= 0.10
 UNION ALL SELECT fingerprint, day, 'unavailable' FROM m WHERE round(unavailable - m_unavailable, 6) >= 0.10 UNION ALL SELECT fingerprint, day, 'latency' FROM m WHERE m_p95 > 0 AND p95 > greatest(m_p95 * 1.5, m_p95 + 500)""")
def metric_regressions(t):
    r = ss.compare_runs(runs(t), "fingerprint", "day", 5)
    med = lambda c: ss.upper_middle(F.col(f"prior_{c}"))
    rise = lambda c: F.round(F.col(c) - med(c), 6)
    p = med("p95")
    found = F.array_compact(F.array(
        F.when(-rise("hit") >= 0.08, "hit"), F.when(rise("junk") >= 0.10, "junk"), F.when(rise("unavailable") >= 0.10, "unavailable"),
        F.when((p > 0) & (F.col("p95") > F.greatest(p * 1.5, (p + 500).cast("double"))), "latency")))
    return r.select("fingerprint", "day", F.explode(found).alias("finding"))


@query("task_regressions", f"""WITH {RUNS}, m AS (SELECT *, list_sort(list(hit) OVER w)[2] AS med, count(*) OVER w AS n FROM runs WINDOW w AS (PARTITION BY fingerprint ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
 SELECT fingerprint, day, hit, med FROM m WHERE n = 3 AND med - hit >= greatest(0.10::DOUBLE, 1 / scheduled) - 1e-9""")
def task_regressions(t):
    r = ss.compare_runs(runs(t), "fingerprint", "day", 3).where("prior = 3").withColumn("med", F.get(F.array_sort("prior_hit"), F.lit(1)))
    return r.where(F.col("med") - F.col("hit") >= F.greatest(F.lit(0.10), 1 / F.col("scheduled")) - 1e-9).select("fingerprint", "day", "hit", "med")


@query("trend_delta", f"""WITH {RUNS}, d AS (SELECT fingerprint, day, hit, round(hit - lag(hit) OVER (PARTITION BY fingerprint ORDER BY day), 6) AS delta FROM runs)
 SELECT *, CASE WHEN delta IS NULL OR abs(delta) < 0.005 THEN 'same' WHEN delta > 0 THEN 'good' ELSE 'bad' END AS direction FROM d""")
def trend_delta(t):
    prev = F.lag("hit").over(W.partitionBy("fingerprint").orderBy("day"))
    d = runs(t).select("fingerprint", "day", "hit", F.round(F.col("hit") - prev, 6).alias("delta"))
    return d.withColumn("direction", F.when(F.col("delta").isNull() | (F.abs("delta") < 0.005), "same").when(F.col("delta") > 0, "good").otherwise("bad"))


@query("running_ceiling", """WITH r AS (SELECT o_orderkey AS call, 0 AS kind, o_orderdate AS ts, CAST(round(o_totalprice * 100) AS BIGINT) AS delta FROM orders),
 s AS (SELECT l_orderkey AS call, max(l_shipdate) AS ts, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS settled FROM lineitem GROUP BY l_orderkey),
 l AS (SELECT * FROM r UNION ALL SELECT s.call, 1, s.ts, settled - delta FROM s JOIN r USING (call))
 SELECT call, kind, sum(delta) OVER (ORDER BY ts, kind, call)::BIGINT AS exposure FROM l""")
def running_ceiling(t):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    r = t.orders.select(F.col("o_orderkey").alias("call"), F.lit(0).alias("kind"), F.col("o_orderdate").alias("ts"), cents("o_totalprice").alias("delta"))
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("call")).agg(F.max("l_shipdate").alias("ts"), F.sum(cents("l_extendedprice")).alias("settled"))
    settle = s.join(r.select("call", "delta"), "call").select("call", F.lit(1).alias("kind"), "ts", (F.col("settled") - F.col("delta")).alias("delta"))
    return ss.ceiling(r.unionByName(settle)).select("call", "kind", "exposure")


# -- joins on sessions ------------------------------------------------------------------------------

@query("tool_call_results", f"""WITH {HOOKS}, res AS (SELECT session_id, k, arg_max(value > 20, event_id) AS is_error, arg_max(CASE WHEN event_id % 2 = 0 THEN 'Process exited with code ' || (event_id % 3) ELSE 'text' END, event_id) AS output
  FROM hooks WHERE event = 'PostToolUseFailure' GROUP BY session_id, k)
 SELECT event_id, session_id, CASE WHEN is_error OR regexp_matches(output, 'code [1-9]') THEN false WHEN regexp_matches(output, 'code 0') THEN true END AS success FROM hooks LEFT JOIN res USING (session_id, k) WHERE event = 'PostToolUse'""")
def tool_call_results(t):
    h = demo.hooks(t)
    calls = h.where("event = 'PostToolUse'").select("event_id", "session_id", "k")
    results = h.where("event = 'PostToolUseFailure'").select(
        "session_id", "k", "ts", "event_id", (F.col("value") > 20).alias("is_error"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'Process exited with code ' || (event_id % 3) ELSE 'text' END").alias("output"))
    return ss.tool_outcomes(calls, results, ["session_id", "k"]).select("event_id", "session_id", "success")


@query("files_touched", f"""WITH {HOOKS}, p AS (SELECT session_id, data->>'$.tool_input.file_path' AS path, min(event_id) AS e FROM hooks WHERE event LIKE 'PostToolUse%' GROUP BY ALL)
 SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY e) AS place FROM p""")
def files_touched(t):
    rows = (demo.hooks(t).where("event LIKE 'PostToolUse%'")
            .select("session_id", "ts", "event_id", F.get_json_object("data", "$.tool_input.file_path").alias("path")))
    return ss.first_seen(rows, "session_id", "path").select("session_id", "path", "place")


@query("derivation_sources", f"""WITH {HOOKS}, s AS (SELECT session_id, cwd, data->>'$.tool_input.file_path' AS p FROM hooks)
 SELECT DISTINCT session_id, origin FROM (SELECT session_id, cwd AS origin FROM s UNION ALL SELECT session_id, CASE WHEN starts_with(p, '/') THEN p ELSE cwd || '/' || p END FROM s WHERE p <> '' UNION ALL SELECT session_id, 'transcript/' || session_id FROM s)""")
def derivation_sources(t):
    p = F.get_json_object("data", "$.tool_input.file_path")
    web = p.startswith("http:") | p.startswith("https:")
    path = F.when((p != "") & ~web, F.when(p.startswith("/"), p).otherwise(F.concat_ws("/", "cwd", p)))
    origins = F.array_compact(F.array(F.col("cwd"), path, F.concat(F.lit("transcript/"), F.col("session_id").cast("string"))))
    return demo.hooks(t).select("session_id", F.explode(origins).alias("origin")).distinct()


@query("anchor_events", """WITH h AS (SELECT conv_id, turn, role, text, sha256(role || chr(10) || text) AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM conversations),
 r AS (SELECT conv_id, """ + DIGEST_SQL("d") + """ AS revision FROM h GROUP BY conv_id)
 SELECT conv_id, turn, 'conv-' || conv_id || '#L' || line || '@' || revision AS anchor, d AS record_digest FROM h JOIN r USING (conv_id)""")
def anchor_events(t):
    c = t.conversations.select("conv_id", "turn", F.sha2(F.concat_ws("\n", "role", "text"), 256).alias("record_digest"))
    lined = number_rows(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000), "line")
    rev = c.groupBy("conv_id").agg(mt.multiset_digest(F.col("record_digest")).alias("revision"))
    anchor = F.format_string("conv-%d#L%d@%s", "conv_id", "line", "revision")
    return lined.join(rev, "conv_id").select("conv_id", "turn", anchor.alias("anchor"), "record_digest")
