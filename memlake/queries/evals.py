"""Evaluation, logs, ledgers and study statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.functions.text import split_of
from memlake.operators import metrics as mt, vectors as vx
from memlake.operators.ordered import value_at_index
from memlake.queries import demo
from memlake.queries.demo import NOTES
from memlake.queries.retrieval import CENTROID_SQL, COSINE_SQL, DIM, label_centroids
from memlake.queries.text import INDEX, note_index_frame
from memlake.registry import query

# Each vector is a case: its own label is the expected answer, centroids are the candidates, and
# the labels above 7 play questions without an answer.
CASES_SQL = f"""{CENTROID_SQL}, cs AS (SELECT vec_id, e.label AS own, c.label AS cand, {COSINE_SQL} AS score, round(list_inner_product(embedding::DOUBLE[], c), 6) AS dotp FROM embeddings e, cen c),
 cr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cand) AS r, row_number() OVER (PARTITION BY vec_id ORDER BY dotp DESC, cand) AS rd FROM cs),
 cases AS (SELECT vec_id, max(own) <= 7 AS positive, CASE WHEN right(sha1('label-' || max(own)), 1) IN ('1','3','5','7','9','b','d','f') THEN 'test' ELSE 'dev' END AS split,
  CASE WHEN vec_id % 53 = 0 THEN 'unavailable' WHEN max(score) >= 0.25 THEN 'hit' ELSE 'miss' END AS status,
  min(CASE WHEN own = cand AND r <= 2 THEN r END) AS rank, bool_or(own = cand AND r <= 5) AS in_candidates, min(CASE WHEN own = cand AND rd <= 2 THEN rd END) AS baseline_rank,
  min(CASE WHEN own = cand AND r <= 4 AND own % 2 = cand % 2 THEN r END) AS scoped_rank, greatest(0, max(score)) AS overlap, vec_id * 37 % 1000 AS ms FROM cr GROUP BY vec_id)"""


def scored_cases(t):
    q = label_centroids(t).withColumnRenamed("label", "cand")
    e, c = "embedding", "centroid"
    # One query per label; all vectors are cases.
    pairs = vx.against_all(t.embeddings, q).select("vec_id", F.col("label").alias("own"), "cand",
                                           F.round(vx.cosine(e, c, DIM), 6).alias("score"), F.round(vx.dot(e, c, DIM), 6).alias("dotp"))
    # A window per case holds one row per candidate label.
    by = lambda col: F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc(col), F.asc("cand"))).cast("bigint")
    ranked = pairs.withColumn("r", by("score")).withColumn("rd", by("dotp"))
    mine = F.col("own") == F.col("cand")
    return (ranked.groupBy("vec_id").agg(
        F.max("own").alias("own"), F.max("score").alias("best"),
        F.min(F.when(mine & (F.col("r") <= 2), F.col("r"))).alias("rank"), F.bool_or(mine & (F.col("r") <= 5)).alias("in_candidates"),
        F.min(F.when(mine & (F.col("rd") <= 2), F.col("rd"))).alias("baseline_rank"),
        F.min(F.when(mine & (F.col("r") <= 4), F.col("r"))).alias("scoped_rank"))
        .select("vec_id", (F.col("own") <= 7).alias("positive"), split_of(F.concat(F.lit("label-"), F.col("own").cast("string"))).alias("split"),
                F.when(F.col("vec_id") % 53 == 0, "unavailable").when(F.col("best") >= 0.25, "hit").otherwise("miss").alias("status"),
                "rank", "in_candidates", "baseline_rank", "scoped_rank", F.greatest(F.lit(0.0), "best").alias("overlap"),
                (F.col("vec_id") * 37 % 1000).alias("ms")))


@query("score_cases", f"WITH {CASES_SQL} SELECT * FROM cases")
def score_cases(t):
    return scored_cases(t)


S = lambda cond, of="true": f"round(sum(CASE WHEN ({of}) AND coalesce({cond}, false) THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN {of} THEN 1 ELSE 0 END), 0), 6)"


@query("retrieval_metrics", f"""WITH {CASES_SQL}, g AS (SELECT 'all' AS split, * EXCLUDE split FROM cases UNION ALL SELECT split, * EXCLUDE split FROM cases),
 pc AS (SELECT split, list(ms ORDER BY ms) AS l FROM g WHERE status IN ('hit', 'miss') GROUP BY split)
 SELECT g.split, count(*) AS cases, sum(positive::INT)::BIGINT AS positives, {S("status = 'unavailable'")} AS unavailable_rate, {S('rank IS NOT NULL', 'positive')} AS hit_at_k, {S('rank = 1', 'positive')} AS hit_at_1,
 round(sum(CASE WHEN positive AND rank IS NOT NULL THEN 1 / rank ELSE 0 END) / nullif(sum(positive::INT), 0), 6) AS mrr, {S("status <> 'hit'", 'positive')} AS miss_rate,
 {S('rank IS NULL AND in_candidates', 'positive')} AS ranked_out, {S('baseline_rank IS NOT NULL', 'positive')} AS baseline_hit_at_k, {S('scoped_rank IS NOT NULL', 'positive')} AS scoped_hit_at_k,
 {S('rank IS NOT NULL', 'positive AND overlap < 0.34')} AS hard_hit_at_k, {S("status = 'hit'", 'NOT positive')} AS false_injection_rate,
 max(l[len(l) // 2 + 1]) AS p50_ms, max(l[least(len(l) - 1, floor(len(l) * 0.95::DOUBLE)::BIGINT) + 1]) AS p95_ms FROM g LEFT JOIN pc ON pc.split = g.split GROUP BY g.split""")
def retrieval_metrics(t):
    return mt.retrieval_metrics(scored_cases(t))


@query("failure_breakdown", f"""WITH {CASES_SQL}, f AS (SELECT vec_id, CASE WHEN NOT positive AND status = 'hit' THEN 'noise' WHEN positive AND status <> 'hit' THEN 'nothing found'
 WHEN positive AND rank IS NULL AND in_candidates THEN 'ranked out' WHEN positive AND rank IS NULL THEN 'competing notes' END AS cause FROM cases),
 x AS (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY vec_id) AS rn FROM f WHERE cause IS NOT NULL)
 SELECT cause, count(*) AS n, string_agg(CASE WHEN rn <= 8 THEN vec_id::VARCHAR END, ' ' ORDER BY vec_id) AS examples FROM x GROUP BY cause""")
def failure_breakdown(t):
    c = scored_cases(t)
    rows = c.select("vec_id", mt.failure_cause({n: F.col(n) for n in c.columns}).alias("cause")).where("cause IS NOT NULL")
    return mt.counted_with_examples(rows, "cause", "vec_id", 8)


# -- recall log ------------------------------------------------------------------------------

LOG_COLS = """event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'failure' ELSE 'prompt' END AS kind,
 CASE event_type WHEN 'error' THEN 'miss' WHEN 'signup' THEN 'skipped' ELSE 'hit' END AS status, CAST(round(value * 10) AS BIGINT) AS ms,
 'query ' || regexp_extract(props, '([0-9]+)', 1) AS q, 'src/m' || regexp_extract(props, '([0-9]+)', 1) || '/file' || (event_id % 7) || '.py' AS path"""
LOG = f"rlog AS (SELECT {LOG_COLS} FROM events)"


def recall_log(t):
    return demo.project(t.events, LOG_COLS)


@query("recall_stats", f"""WITH {LOG}, w AS (SELECT * FROM rlog WHERE ts >= TIMESTAMP '2024-01-24'), l AS (SELECT list(ms ORDER BY ms) AS l FROM w WHERE status IN ('hit', 'miss'))
 SELECT kind, status, count(*) AS n, max(l[len(l) // 2 + 1]) AS p50_ms, max(l[floor(len(l) * 0.95::DOUBLE)::BIGINT + 1]) AS p95_ms FROM w, l GROUP BY kind, status""")
def recall_stats(t):
    w = recall_log(t).where("ts >= TIMESTAMP_NTZ '2024-01-24 00:00:00'")
    p = mt.index_percentiles(w.where("status IN ('hit', 'miss')"), [], "ms", 100, capped=False)
    return (w.groupBy("kind", "status").agg(mt.count_rows().alias("n"))
            .select("kind", "status", "n", p.select("p50").scalar().alias("p50_ms"), p.select("p95").scalar().alias("p95_ms")))


OPEN_SQL = f"""{LOG}, {demo.HOOKS}, lh AS (SELECT event_id AS id, user_id, ts, path FROM rlog WHERE kind = 'prompt' AND status = 'hit' AND event_id IN (SELECT event_id FROM events WHERE event_type = 'click')),
 rw AS (SELECT session_id AS user_id, ts, event = 'UserPromptSubmit' AS is_prompt, CASE WHEN event = 'PostToolUse' THEN data ELSE '' END AS tool_text FROM hooks WHERE event IN ('UserPromptSubmit', 'PostToolUse')),
 nx AS (SELECT id, min(r.ts) AS nxt FROM lh JOIN rw r ON r.user_id = lh.user_id AND is_prompt AND r.ts > lh.ts + INTERVAL 5 SECOND AND r.ts <= lh.ts + INTERVAL 3 DAY GROUP BY id),
 op AS (SELECT DISTINCT lh.id FROM lh LEFT JOIN nx USING (id) JOIN rw r ON r.user_id = lh.user_id AND NOT is_prompt AND r.ts >= lh.ts - INTERVAL 2 SECOND AND r.ts <= lh.ts + INTERVAL 3 DAY
   AND (nxt IS NULL OR r.ts < nxt) AND (contains(tool_text, path) OR contains(tool_text, regexp_extract(path, '([^/]*)$', 1)))),
 opened AS (SELECT lh.*, op.id IS NOT NULL AS opened FROM lh LEFT JOIN op USING (id))"""


def opened_hits(t):
    hooks = demo.hooks(t)
    hits = (recall_log(t).join(t.events.where("event_type = 'click'").select("event_id"), "event_id", "left_semi")
            .where("kind = 'prompt' AND status = 'hit'").select(F.col("event_id").alias("id"), "user_id", "ts", "path"))
    rows = (hooks.where("event IN ('UserPromptSubmit', 'PostToolUse')")
            .select(F.col("session_id").alias("user_id"), "ts", (F.col("event") == "UserPromptSubmit").alias("is_prompt"),
                    F.when(F.col("event") == "PostToolUse", F.col("data")).otherwise("").alias("tool_text")))
    return mt.opened_after(hits, rows, "user_id", before=2, horizon=3 * 86_400, grace=5)


@query("opened_after_hit", f"WITH {OPEN_SQL} SELECT id, user_id, path, opened FROM opened")
def opened_after_hit(t):
    return opened_hits(t).select("id", "user_id", "path", "opened")


@query("live_summary", f"""WITH {OPEN_SQL}, p AS (SELECT * FROM rlog WHERE kind = 'prompt' AND status IN ('hit', 'miss')), l AS (SELECT list(ms ORDER BY ms) AS l FROM p)
 SELECT count(*) AS prompts, {S("status = 'hit'")} AS hit_rate, round(1 - {S("status = 'hit'")}, 6) AS miss_rate, max(l[len(l) // 2 + 1]) AS p50_ms, max(l[least(len(l) - 1, floor(len(l) * 0.95::DOUBLE)::BIGINT) + 1]) AS p95_ms,
 (SELECT count(*) FROM opened) AS turns_checked, (SELECT {S('opened')} FROM opened) AS opened_rate FROM p, l""")
def live_summary(t):
    prompts = recall_log(t).where("kind = 'prompt' AND status IN ('hit', 'miss')")
    p = mt.index_percentiles(prompts, [], "ms", 100)
    opened = opened_hits(t).agg(mt.count_rows().alias("turns_checked"), mt.share(F.col("opened")).alias("opened_rate"))
    rate = mt.share(F.col("status") == "hit")
    return (prompts.agg(mt.count_rows().alias("prompts"), rate.alias("hit_rate"))
            .select("prompts", "hit_rate", F.round(1 - F.col("hit_rate"), 6).alias("miss_rate"), p.select("p50").scalar().alias("p50_ms"),
                    p.select("p95").scalar().alias("p95_ms"), opened.select("turns_checked").scalar().alias("turns_checked"),
                    opened.select("opened_rate").scalar().alias("opened_rate")))


@query("live_notes", f"""WITH {OPEN_SQL}, n AS (SELECT path, count(*) AS shown, sum(opened::INT)::BIGINT AS opened FROM opened GROUP BY path)
 (SELECT 'never_opened' AS list, path, shown, opened FROM n WHERE opened = 0 ORDER BY shown DESC, path LIMIT 10) UNION ALL (SELECT 'most_used', path, shown, opened FROM n WHERE opened > 0 ORDER BY opened DESC, path LIMIT 10)""")
def live_notes(t):
    n = opened_hits(t).groupBy("path").agg(mt.count_rows().alias("shown"), F.sum(F.col("opened").cast("bigint")).alias("opened"))
    never = n.where("opened = 0").orderBy(F.desc("shown"), "path").limit(10).select(F.lit("never_opened").alias("list"), "*")
    used = n.where("opened > 0").orderBy(F.desc("opened"), "path").limit(10).select(F.lit("most_used").alias("list"), "*")
    return never.unionByName(used)


@query("live_missed", f"WITH {LOG} SELECT q, count(*) AS times FROM rlog WHERE kind = 'prompt' AND status = 'miss' GROUP BY q ORDER BY times DESC, q LIMIT 10")
def live_missed(t):
    return (recall_log(t).where("kind = 'prompt' AND status = 'miss'").groupBy("q").agg(mt.count_rows().alias("times"))
            .orderBy(F.desc("times"), "q").limit(10))


VERDICT_COLS = """doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'with' WHEN quality = 1 THEN 'both' WHEN toxic = 1 THEN 'without' WHEN doc_id % 3 = 0 THEN 'invalid' ELSE 'neither' END AS follows,
 doc_id % 4 = 0 AS control_scheduled, CASE WHEN doc_id % 4 = 0 AND doc_id % 28 <> 0 THEN CASE WHEN quality = 1 THEN 'neither' ELSE 'with' END END AS control"""


@query("answers_ab", f"""WITH r AS (SELECT {VERDICT_COLS} FROM labels) SELECT count(*) AS attempted, sum((follows <> 'invalid')::INT)::BIGINT AS judged,
 {S("follows IN ('with', 'both')")} AS with_follows, {S("follows IN ('without', 'both')")} AS without_follows, {S("follows IN ('with', 'both')", "follows <> 'invalid'")} AS judged_with_follows,
 {S("follows IN ('without', 'both')", "follows <> 'invalid'")} AS judged_without_follows, {S("control = 'neither'", 'control_scheduled')} AS control_neither_rate,
 {S("control = 'neither'", 'control IS NOT NULL')} AS judged_control_neither_rate,
 coalesce({S("control = 'neither'", 'control IS NOT NULL')} >= 0.8 AND sum(control_scheduled::INT) = count(control), false) AS judge_trusted FROM r""")
def answers_ab(t):
    r = demo.project(t.labels, VERDICT_COLS)
    judged, ctl = F.col("follows") != "invalid", F.col("control").isNotNull()
    with_, without = F.col("follows").isin("with", "both"), F.col("follows").isin("without", "both")
    neither = F.col("control") == "neither"
    out = r.agg(mt.count_rows().alias("attempted"), F.sum(judged.cast("bigint")).alias("judged"), mt.share(with_).alias("with_follows"), mt.share(without).alias("without_follows"),
                mt.share(with_, judged).alias("judged_with_follows"), mt.share(without, judged).alias("judged_without_follows"),
                mt.share(neither, F.col("control_scheduled")).alias("control_neither_rate"), mt.share(neither, ctl).alias("judged_control_neither_rate"),
                (F.sum(F.col("control_scheduled").cast("int")) == F.count("control")).alias("all_judged"))
    return out.withColumn("judge_trusted", F.coalesce((F.col("judged_control_neither_rate") >= 0.8) & F.col("all_judged"), F.lit(False))).drop("all_judged")


GRID_SQL = """grid AS (SELECT doc_id, baseline, l.toxic IS NOT NULL AS attempted, coalesce(toxic = 0, false) AS completed, coalesce(toxic = 0 AND doc_id % 3 <> 0, false) AS passed,
 CASE WHEN l.toxic IS NULL THEN 'missing attempt' ELSE '' END AS error FROM (SELECT doc_id, unnest(['plain', 'hybrid']) AS baseline FROM documents) g
 LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'hybrid' ELSE 'plain' END AS baseline, toxic FROM labels) l USING (doc_id, baseline))"""


def task_grid(t):
    traces = t.labels.select("doc_id", F.when(F.col("quality") == 1, "hybrid").otherwise("plain").alias("baseline"),
                             (F.col("toxic") == 0).alias("completed"), (F.col("doc_id") % 3 != 0).alias("verified"))
    return mt.dense_grid(t.documents.select("doc_id"), "doc_id", ["plain", "hybrid"], traces)


@query("seed_grid_join", f"WITH {GRID_SQL} SELECT * FROM grid")
def seed_grid_join(t):
    return task_grid(t)


@query("task_metrics", f"WITH {GRID_SQL} SELECT baseline, count(*) AS scheduled, sum(attempted::INT)::BIGINT AS attempted, sum(completed::INT)::BIGINT AS completed, {S('passed')} AS success_rate FROM grid GROUP BY baseline")
def task_metrics(t):
    n = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    return task_grid(t).groupBy("baseline").agg(mt.count_rows().alias("scheduled"), n("attempted"), n("completed"), mt.share(F.col("passed")).alias("success_rate"))


@query("stage_counts", f"""WITH {GRID_SQL} SELECT baseline, 'attempted' AS stage, sum(attempted::INT)::BIGINT AS done, sum((NOT attempted)::INT)::BIGINT AS skipped FROM grid GROUP BY baseline
 UNION ALL SELECT baseline, 'completed', sum(completed::INT)::BIGINT, sum((NOT completed)::INT)::BIGINT FROM grid GROUP BY baseline UNION ALL SELECT baseline, 'passed', sum(passed::INT)::BIGINT, sum((NOT passed)::INT)::BIGINT FROM grid GROUP BY baseline""")
def stage_counts(t):
    stages = F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("v")) for c in ("attempted", "completed", "passed")])
    return (task_grid(t).select("baseline", F.explode(stages).alias("s")).groupBy("baseline", F.col("s.stage").alias("stage"))
            .agg(F.sum(F.col("s.v").cast("bigint")).alias("done"), F.sum((~F.col("s.v")).cast("bigint")).alias("skipped")))


# -- corpus ------------------------------------------------------------------------------------

@query("tag_stats", INDEX + """, c AS (SELECT tag, count(*) AS notes FROM note_tags GROUP BY tag) SELECT tag, notes, (SELECT count(*) FROM vault) AS note_count, (SELECT count(*) FROM c) AS tag_count,
 row_number() OVER (ORDER BY notes DESC, tag) <= 10 AS in_top FROM c""")
def tag_stats(t):
    notes = note_index_frame(t).select("doc_id", "tags")
    counts = tx.unnest(notes, [], F.col("tags"), "tag").groupBy("tag").agg(mt.count_rows().alias("notes"))
    top = counts.orderBy(F.desc("notes"), "tag").limit(10).select("tag", F.lit(True).alias("in_top"))
    return (counts.join(top, "tag", "left")
            .select("tag", "notes", F.lit(notes.agg(mt.count_rows()).scalar()).alias("note_count"), counts.agg(mt.count_rows()).scalar().alias("tag_count"),
                    F.coalesce("in_top", F.lit(False)).alias("in_top")))


DIGEST_SQL = lambda h: "sha256(" + " || ':' || ".join(f"CAST(sum(('0x' || substr({h}, {1 + 8 * i}, 8))::BIGINT) AS VARCHAR)" for i in range(8)) + ")"


@query("corpus_digest", f"WITH {NOTES}, h AS (SELECT collection, sha256(collection || chr(10) || doc_id || '.md' || chr(10) || revision) AS h FROM notes) SELECT collection, count(*) AS notes, {DIGEST_SQL('h')} AS digest FROM h GROUP BY collection UNION ALL SELECT '*', count(*), {DIGEST_SQL('h')} FROM h")
def corpus_digest(t):
    h = demo.notes(t).select("collection", F.sha2(F.concat_ws("\n", "collection", F.concat(F.col("doc_id").cast("string"), F.lit(".md")), "revision"), 256).alias("h"))
    out = h.groupingSets([["collection"], []], "collection").agg(mt.count_rows().alias("notes"), mt.multiset_digest(F.col("h")).alias("digest"))
    return out.withColumn("collection", F.coalesce("collection", F.lit("*")))


@query("case_set_id", f"WITH h AS (SELECT sha256(item_id || chr(10) || text) AS h FROM benchmark) SELECT 'benchmark:' || count(*) || ':' || substr({DIGEST_SQL('h')}, 1, 20) AS set_id FROM h")
def case_set_id(t):
    h = t.benchmark.select(F.sha2(F.concat_ws("\n", F.col("item_id").cast("string"), "text"), 256).alias("h"))
    return h.agg(mt.count_rows().alias("n"), mt.multiset_digest(F.col("h")).alias("d")).select(
        F.concat(F.lit("benchmark:"), F.col("n").cast("string"), F.lit(":"), F.substring("d", 1, 20)).alias("set_id"))


@query("vector_inventory", "SELECT label, len(embedding) AS dim, count(*) AS vectors, count(*) <= 20000 AS exact_search FROM embeddings GROUP BY ALL")
def vector_inventory(t):
    return (t.embeddings.groupBy("label", F.size("embedding").cast("bigint").alias("dim")).agg(mt.count_rows().alias("vectors"))
            .withColumn("exact_search", F.col("vectors") <= 20_000))


@query("exact_duplicates", "SELECT sha256(text) AS body, lang, count(*) AS copies, max(doc_id) AS kept, min(doc_id) AS oldest, count(DISTINCT source) AS sources FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(t):
    return (t.documents.select("doc_id", "lang", "source", F.sha2("text", 256).alias("body")).groupBy("body", "lang")
            .agg(mt.count_rows().alias("copies"), F.max("doc_id").alias("kept"), F.min("doc_id").alias("oldest"), F.countDistinct("source").alias("sources"))
            .where("copies > 1"))


@query("redundant_blocks", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
 SELECT doc_id, sha256(body) AS block, min(i)::BIGINT AS kept_line, count(*) - 1 AS removed FROM l WHERE body <> '' GROUP BY doc_id, body HAVING count(*) > 1""")
def redundant_blocks(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "body")).where("body <> ''")
    return (lines.groupBy("doc_id", F.sha2("body", 256).alias("block"))
            .agg((F.min("i") + 1).cast("bigint").alias("kept_line"), (mt.count_rows() - 1).alias("removed")).where("removed > 0"))


@query("store_usage", """SELECT source, count(*) AS entries, count(DISTINCT sha256(text)) AS bodies, sum(octet_length(encode(text)))::BIGINT AS used, sum(octet_length(encode(text))) <= 500000 AND count(*) <= 1000 AS admitted FROM documents GROUP BY source""")
def store_usage(t):
    """What each source holds, in bytes of text, against its quota of bytes and entries."""
    return (t.documents.groupBy("source").agg(mt.count_rows().alias("entries"), F.countDistinct(F.sha2("text", 256)).alias("bodies"), F.sum(F.octet_length("text")).alias("used"))
            .withColumn("admitted", (F.col("used") <= 500_000) & (F.col("entries") <= 1000)))


@query("import_report", """WITH f AS (SELECT doc_id, source, CASE WHEN n_chars < 100 THEN 'failure' WHEN min(doc_id) OVER (PARTITION BY sha256(text)) < doc_id THEN 'unchanged' ELSE 'queued' END AS outcome FROM documents),
 d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM f WHERE outcome = 'failure'), e AS (SELECT source, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS detail FROM d WHERE rn <= 100 GROUP BY source)
 SELECT f.source, count(*) AS examined, sum((outcome = 'queued')::INT)::BIGINT AS queued, sum((outcome = 'unchanged')::INT)::BIGINT AS unchanged, sum((outcome = 'failure')::INT)::BIGINT AS failures, coalesce(max(detail), '') AS detail
 FROM f LEFT JOIN e ON e.source = f.source GROUP BY f.source""")
def import_report(t):
    docs = t.documents.select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    rows = docs.join(first, "h").withColumn("outcome", F.when(F.col("n_chars") < 100, "failure").when(F.col("first") < F.col("doc_id"), "unchanged").otherwise("queued"))
    detail = mt.counted_with_examples(rows.where("outcome = 'failure'"), "source", "doc_id", 100).select("source", F.col("examples").alias("detail"))
    n = lambda o, a: F.sum((F.col("outcome") == o).cast("bigint")).alias(a)
    return (rows.groupBy("source").agg(mt.count_rows().alias("examined"), n("queued", "queued"), n("unchanged", "unchanged"), n("failure", "failures"))
            .join(detail, "source", "left").withColumn("detail", F.coalesce("detail", F.lit(""))))


# -- ledgers and studies -------------------------------------------------------------------------

@query("cost_ledger", """WITH s AS (SELECT l_orderkey AS call, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS settled, count(*) AS settles FROM lineitem GROUP BY l_orderkey),
 j AS (SELECT o_orderkey, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS reserved, s.* FROM orders FULL JOIN s ON s.call = o_orderkey)
 SELECT coalesce(o_orderpriority, 'none') AS grp, sum((o_orderkey IS NOT NULL)::INT)::BIGINT AS calls, sum((call IS NULL)::INT)::BIGINT AS unsettled, sum((o_orderkey IS NULL)::INT)::BIGINT AS orphan_settles,
 sum(coalesce(settles - 1, 0))::BIGINT AS repeated_settles, sum(coalesce(settled, reserved))::BIGINT AS accounted, sum((settled > reserved)::INT)::BIGINT AS over_reservation FROM j GROUP BY ALL""")
def cost_ledger(t):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    reserve = t.orders.select(F.col("o_orderkey").alias("call"), "o_orderpriority", cents("o_totalprice").alias("reserved"))
    settle = t.lineitem.groupBy(F.col("l_orderkey").alias("call")).agg(F.sum(cents("l_extendedprice")).alias("settled"), mt.count_rows().alias("settles"))
    j = reserve.join(settle, "call", "full_outer")
    flag = lambda c, a: F.sum(F.coalesce(c.cast("bigint"), F.lit(0))).alias(a)
    return j.groupBy(F.coalesce("o_orderpriority", F.lit("none")).alias("grp")).agg(
        flag(F.col("reserved").isNotNull(), "calls"), flag(F.col("settled").isNull(), "unsettled"), flag(F.col("reserved").isNull(), "orphan_settles"),
        F.sum(F.coalesce(F.col("settles") - 1, F.lit(0))).alias("repeated_settles"), F.sum(F.coalesce("settled", "reserved")).alias("accounted"),
        flag(F.col("settled") > F.col("reserved"), "over_reservation"))


# Named subsets of task ordinals (fixed values).
SUBSETS = {"acquisition": [1, 2, 3], "exposure": [1, 2, 3, 4, 6, 7, 11], "primary": [5, 8, 9, 10, 12], "early": [5], "middle": [8, 9],
           "late": [10, 12], "correction": [7], "all": list(range(1, 13))}


@query("arm_rates", f"""WITH c AS (SELECT event_type AS arm, event_id % 12 + 1 AS ordinal, CASE WHEN value < 10 THEN NULL ELSE value > 40 END AS ok FROM events),
 s AS ({' UNION ALL '.join(f"SELECT '{n}' AS subset, unnest({o}) AS ordinal" for n, o in SUBSETS.items())})
 SELECT arm, subset, count(*) AS scheduled, count(ok) AS known, sum(coalesce(ok, false)::INT)::BIGINT AS successes, {S('ok', 'ok IS NOT NULL')} AS rate_among_known, {S('ok')} AS lower_bound FROM c JOIN s USING (ordinal) GROUP BY arm, subset""")
def arm_rates(t):
    ok = F.when(F.col("value") >= 10, F.col("value") > 40)
    cells = t.events.select(F.col("event_type").alias("arm"), (F.col("event_id") % 12 + 1).alias("ordinal"), ok.alias("ok"))
    member = F.array_compact(F.array(*[F.when(F.col("ordinal").isin(o), F.lit(n)) for n, o in SUBSETS.items()]))
    return (cells.withColumn("subset", F.explode(member)).groupBy("arm", "subset").agg(
        mt.count_rows().alias("scheduled"), F.count("ok").alias("known"), F.sum(F.coalesce("ok", F.lit(False)).cast("bigint")).alias("successes"),
        mt.share(F.col("ok"), F.col("ok").isNotNull()).alias("rate_among_known"), mt.share(F.col("ok")).alias("lower_bound")))


@query("distributions", "SELECT grp_ AS grp, count(*) AS n, median(l_extendedprice) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM (SELECT l_returnflag || l_linestatus AS grp_, l_extendedprice FROM lineitem) GROUP BY 1")
def distributions(t):
    rows = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("grp"), F.col("l_extendedprice").alias("v"))
    n = F.col("n")
    p = value_at_index(rows, ["grp"], "v", F.floor(F.col("v") / 100), {"lo": F.floor((n - 1) / 2), "hi": F.floor(n / 2), "min": F.lit(0), "max": n - 1})
    return p.select("grp", "n", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "min", "max")


DIFF_SQL = """df AS (SELECT r_name AS cluster, round(avg(c_acctbal) - (SELECT avg(s_acctbal) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey), 2) AS d
 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey, r_name)"""


def region_differences(t):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("cluster"))
    c = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("cluster").agg(F.avg("c_acctbal").alias("a"))
    s = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("cluster").agg(F.avg("s_acctbal").alias("b"))
    return c.join(s, "cluster").select("cluster", F.round(F.col("a") - F.col("b"), 2).alias("d"))


@query("paired_sign_flip", f"""WITH {DIFF_SQL}, l AS (SELECT list(d) AS v, count(*) AS n, round(avg(d), 6) AS mean_difference, sum(d) AS s FROM df), m AS (SELECT *, unnest(range(0, (1 << n)::BIGINT)) AS mask FROM l),
 f AS (SELECT n, mean_difference, s, list_sum(list_transform(v, lambda x, i: CASE WHEN (mask >> (i - 1)::BIGINT) % 2 = 1 THEN x ELSE -x END)) AS t FROM m)
 SELECT n, mean_difference, round(avg((abs(t) >= abs(s) - 1e-9)::INT), 6) AS p, count(*) AS assignments FROM f GROUP BY n, mean_difference""")
def paired_sign_flip(t):
    return mt.sign_flip(region_differences(t), "d")


@query("bootstrap_ci", f"""WITH {DIFF_SQL}, l AS (SELECT list(d ORDER BY cluster) AS v FROM df), r AS (SELECT v, unnest(range(0, 10000)) AS r FROM l),
 m AS (SELECT round(list_sum(list_transform(v, lambda x, i: v[('0x' || substr(md5(r || ':' || (i - 1)), 1, 8))::BIGINT % len(v) + 1])) / len(v), 6) AS m FROM r), o AS (SELECT list(m ORDER BY m) AS l FROM m)
 SELECT len(l) AS n, l[floor(0.025::DOUBLE * (len(l) - 1))::BIGINT + 1] AS low, l[floor(0.975::DOUBLE * (len(l) - 1))::BIGINT + 1] AS high FROM o""")
def bootstrap_ci(t):
    return mt.bootstrap_ci(region_differences(t), "cluster", "d", 10_000)


JOURNAL = """WITH e AS (SELECT user_id AS trajectory, event_type AS arm, event_id % 3 AS phase, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 2 AS stage,
  CASE WHEN value < 2 THEN 'unknown' WHEN value < 6 THEN 'failed' WHEN value < 9 THEN 'skipped' ELSE 'completed' END AS st FROM events),
 c AS (SELECT trajectory, arm, phase, stage, min(st) AS st FROM e GROUP BY ALL),
 g AS (SELECT trajectory, arm, phase, stage, phase * 2 + stage AS pos FROM (SELECT DISTINCT trajectory FROM e), (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS arm), (SELECT unnest([0, 1, 2]) AS phase), (SELECT unnest([0, 1]) AS stage)),
 j AS (SELECT g.*, st FROM g LEFT JOIN c USING (trajectory, arm, phase, stage)), m AS (SELECT trajectory, arm, min(CASE WHEN st IS NULL OR st = 'unknown' THEN pos END) AS gap FROM j GROUP BY ALL),
 s AS (SELECT j.*, CASE WHEN gap IS NULL OR pos < gap THEN st WHEN pos = gap THEN coalesce(st, 'not_started') WHEN st IS NULL THEN 'blocked' ELSE 'corrupt' END AS state FROM j JOIN m USING (trajectory, arm)),
 cell AS (SELECT trajectory, arm, phase, CASE WHEN bool_or(state = 'corrupt') THEN 'corrupt' WHEN bool_or(state = 'unknown') THEN 'unknown' WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'skipped') THEN 'skipped'
   WHEN bool_or(state = 'not_started') THEN 'not_started' WHEN bool_or(state = 'blocked') THEN 'blocked' ELSE 'resolved' END AS state, bool_or(stage = 1 AND state = 'completed') AS success FROM s GROUP BY ALL)
 SELECT arm, state, count(*) AS cells, sum(success::INT)::BIGINT AS successes FROM cell GROUP BY ALL"""


@query("journal_summary", JOURNAL)
def journal_summary(t):
    from memlake.operators.journal import cell_states
    st = F.when(F.col("value") < 2, "unknown").when(F.col("value") < 6, "failed").when(F.col("value") < 9, "skipped").otherwise("completed")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    cells = (t.events.select(F.col("user_id").alias("trajectory"), F.col("event_type").alias("arm"), (F.col("event_id") % 3).alias("phase"), (k % 2).alias("stage"), st.alias("st"))
             .groupBy("trajectory", "arm", "phase", "stage").agg(F.min("st").alias("st")))
    arms = ["click", "error", "purchase", "signup", "view"]
    rows = cell_states(cells.select("trajectory").distinct(), cells, arms, phases=3, stages=2)
    return rows.groupBy("arm", "state").agg(mt.count_rows().alias("cells"), F.sum(F.col("success").cast("bigint")).alias("successes"))


@query("source_staleness", """WITH a AS (SELECT event_type AS source, max(CASE WHEN value > 1 THEN ts END) AS last_ok, max(ts) AS last_any FROM events GROUP BY ALL)
 SELECT source, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:30:00') - epoch(last_ok)) AS BIGINT) AS age_seconds, epoch(TIMESTAMP '2024-01-31 00:30:00') - epoch(last_ok) > 4000 AS stale, last_any > last_ok AS unfinished FROM a""")
def source_staleness(t):
    from memlake.operators.journal import staleness
    return staleness(t.events.withColumnRenamed("event_type", "source"), "source", "ts", F.col("value") > 1, as_of="2024-01-31 00:30:00", stale_after=4000)
