"""Sources, sinks, set operations and joins over notes."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from memlake.functions import packs as pk, text as tx
from memlake.operators import cells as cx, index as ix, metrics as mt, vectors as vx
from memlake.operators.ordered import number_rows, running
from memlake.operators.recall import in_collections
from memlake.queries import demo
from memlake.queries.demo import HALF, HOOKS, NL, NOTES, lit
from memlake.queries.evals import LOG
from memlake.queries.packs import CHUNKS, PASSAGE
from memlake.queries.retrieval import CENTROID_SQL, COSINE_SQL, DIM, ITEM_Q, label_centroids, stored_cells
from memlake.queries.sessions import ENTRY_COLS, entries
from memlake.queries.text import INDEX, note_index_frame
from memlake.registry import query
from memlake.sources import files as fi, store as st

# -- journals -----------------------------------------------------------------------------------

EVENT_COLS = """'e' || event_id AS event_id, CASE WHEN event_id % 71 = 0 THEN 'soon' ELSE '2024-01-' || substr(CAST(ts AS VARCHAR(40)), 9, 2) || 'T10:00:00Z' END AS ts, event,
 CASE WHEN event_id % 53 = 0 THEN 'bad session!' WHEN event_id % 59 = 0 THEN NULL ELSE 's-' || session_id END AS session_id, cwd, '/t/' || session_id AS transcript_path, CASE WHEN event_id % 61 = 0 THEN '[]' ELSE data END AS data, event_id AS n"""


def _events(t):
    return demo.project(demo.hooks(t), EVENT_COLS)


@query("scan_event_journal", f"""WITH {HOOKS}, e AS (SELECT {EVENT_COLS} FROM hooks) SELECT event_id, event, session_id FROM e WHERE n % 43 <> 0""")
def scan_event_journal(t):
    e = _events(t)
    line = F.to_json(F.struct("event_id", "ts", "event", "session_id", "cwd", "transcript_path", "data"))
    broken = F.when(F.col("n") % 43 == 0, F.substring(line, 1, 25)).otherwise(line)
    path = fi.scratch(t.spark, "journal")
    e.select(broken.alias("value"), F.substring("ts", 1, 10).alias("day")).write.partitionBy("day").text(path)
    return fi.read_journals(t.spark, path).select("event_id", "event", "session_id")


@query("validate_events", f"""WITH {HOOKS}, e AS (SELECT {EVENT_COLS} FROM hooks) SELECT event_id, CASE WHEN session_id IS NULL THEN 'field must be text' WHEN NOT regexp_matches(session_id, '^[A-Za-z0-9_-]{{1,200}}$') THEN 'invalid session identity'
 WHEN NOT starts_with(data, '{{') THEN 'invalid identity or payload' WHEN ts = 'soon' THEN 'invalid timestamp' END AS reason FROM e""")
def validate_events(t):
    e = _events(t)
    return e.select("event_id", fi.event_fault(e).alias("reason"))


# -- transcripts ----------------------------------------------------------------------------------

def _transcript_lines(t):
    """Transcript lines of both dialects, with thinking, tool calls and results; every transcript ends in a cut-off record."""
    text = tx.json_string(F.col("text"))
    said = F.concat(F.lit('{"type":"text","text":'), text, F.lit("}"))
    asks = (F.col("role") == "assistant") & (F.col("turn") % 3 == 2)
    gets = (F.col("role") == "user") & (F.col("turn") % 3 == 0)
    blocks = F.when(asks, F.concat(F.lit('{"type":"thinking","thinking":"hm"},'), said, F.lit(',{"type":"tool_use","id":"c'), "turn", F.lit('","name":"Read","input":{"file_path":"/f"}}'))).when(
        gets, F.concat(said, F.lit(',{"type":"tool_result","tool_use_id":"c'), "turn", F.lit('","content":"out","is_error":true}'))).otherwise(said)
    a = F.concat(F.lit('{"type":"'), "role", F.lit('","sessionId":"s'), "conv_id", F.lit('","cwd":"/w/'), F.col("conv_id") % 3, F.lit('","message":{"content":['), blocks, F.lit("]}}"))
    payload = F.when(F.col("turn") % 4 == 3, F.concat(F.lit('{"type":"function_call","name":"exec","arguments":"{}","call_id":"k'), "turn", F.lit('"}'))).when(
        F.col("turn") % 4 == 2, F.concat(F.lit('{"type":"function_call_output","output":"done","call_id":"k'), "turn", F.lit('"}'))).otherwise(
        F.concat(F.lit('{"type":"message","role":"'), "role", F.lit('","content":[{"type":"output_text","text":'), text, F.lit("}]}")))
    b = F.concat(F.lit('{"type":"response_item","payload":'), payload, F.lit("}"))
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, a).otherwise(b).alias("value"))
    ends = t.conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("value", F.lit('{"type": "user", "mess'))
    return rows.unionByName(ends)


@query("scan_native_transcripts", """WITH c AS (SELECT *, conv_id % 2 = 1 AS b, conv_id % 2 = 0 AND role = 'assistant' AND turn % 3 = 2 AS asks, conv_id % 2 = 0 AND role = 'user' AND turn % 3 = 0 AS gets FROM conversations)
 SELECT conv_id, turn + 1 AS line, b AS dialect_b, CASE WHEN NOT b OR turn % 4 < 2 THEN role END AS role, CASE WHEN NOT b OR turn % 4 < 2 THEN text END AS text, CASE WHEN asks THEN 'hm' WHEN NOT b THEN '' END AS thinking,
 CASE WHEN asks THEN 'Read c' || turn WHEN b AND turn % 4 = 3 THEN 'exec k' || turn ELSE '' END AS calls, CASE WHEN gets THEN 'c' || turn || ' true' WHEN b AND turn % 4 = 2 THEN 'k' || turn || ' false' ELSE '' END AS results FROM c
 UNION ALL SELECT conv_id, max(turn) + 2, conv_id % 2 = 1, NULL, NULL, NULL, '', '' FROM conversations GROUP BY conv_id""")
def scan_native_transcripts(t):
    path = fi.scratch(t.spark, "transcripts")
    (_transcript_lines(t).select(F.col("conv_id").cast("string").alias("file"), (F.col("turn") + 1).alias("line"), "value").write.json(path))
    r = fi.transcript_records(fi.read_bundles(t.spark, path))
    named = lambda c, *fields: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[f].cast("string") for f in fields])), ","), F.lit(""))
    return r.select(F.col("file").cast("bigint").alias("conv_id"), "line", "dialect_b", "role", "text", "thinking",
                    named("calls", "name", "id").alias("calls"), named("results", "id", "is_error").alias("results"))


@query("session_metadata", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 's' || conv_id END AS session_id, CASE WHEN conv_id % 2 = 0 THEN '/w/' || conv_id % 3 END AS cwd FROM conversations GROUP BY conv_id")
def session_metadata(t):
    lines = _transcript_lines(t).select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line"), "value")
    valid = lines.where(F.try_parse_json("value").isNotNull())
    return fi.session_meta(valid).select(F.col("file").alias("conv_id"), "session_id", "cwd")


@query("interactive_filter", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user' AND trim(text) <> '') AND bool_or(role = 'assistant' AND trim(text) <> '')")
def interactive_filter(t):
    return fi.interactive(t.conversations, "conv_id")


# -- exports -----------------------------------------------------------------------------------------

def _packed(t, item):
    """One JSON list of messages per conversation (an export holds a conversation as one document)."""
    return (t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("m")))).alias("l"))
            .select("conv_id", F.array_join(F.transform("l", lambda x: x["m"]), ",").alias("items"), F.size("l").alias("n")))


def _export_a(t):
    text = tx.json_string(F.col("text"))
    blocks = F.when(F.col("turn") % 3 == 2, F.lit("[]")).otherwise(F.concat(
        F.lit('[{"type":"thinking","thinking":"hm"},{"type":"text","text":'), text, F.lit('},{"type":"text","text":"more"},{"type":"tool_use","id":"u'), "turn", F.lit('","name":"Read","input":{"n":1}},{"type":"tool_result","tool_use_id":"u'), (F.col("turn") - 1), F.lit('","content":"ok"}]')))
    m = F.concat(F.lit('{"uuid":"'), "turn", F.lit('","sender":"'), F.when(F.col("role") == "user", "human").otherwise("assistant"), F.lit('","text":'), text,
                 F.lit(',"created_at":"2024-01-01T00:00:0'), F.col("turn") % 10, F.lit('Z","parent_uuid":"'), (F.col("turn") - 1), F.lit('","content":'), blocks, F.lit("}"))
    return _packed(t, m).select(F.concat(F.lit('{"uuid":"c'), "conv_id", F.lit('","chat_messages":['), "items", F.lit("]}")).alias("doc"))


@query("scan_export_messages_a", r"""SELECT 'c' || conv_id AS uuid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role,
 CASE WHEN turn % 3 = 2 THEN text ELSE text || chr(10) || chr(10) || 'more' END AS text, CASE WHEN turn % 3 = 2 THEN '' ELSE 'hm' END AS thinking, CASE WHEN turn % 3 = 2 THEN '' ELSE 'u' || turn || ' Read {"n":1}' END AS calls,
 CASE WHEN turn % 3 = 2 THEN '' ELSE 'u' || (turn - 1) || ' ok false' END AS results, '2024-01-01T00:00:0' || turn % 10 || 'Z' AS created_at, (turn - 1)::VARCHAR AS parent FROM conversations""")
def scan_export_messages_a(t):
    listed = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[f].cast("string") for f in fields])), ",")
    return (fi.messages_a(_export_a(t), "doc").withColumn("thinking", F.array_join("thinking", "\n"))
            .withColumn("calls", listed("calls", "id", "name", "input")).withColumn("results", listed("results", "id", "output", "is_error")))


def _export_b(t):
    parent = F.when((F.col("turn") == 0) & (F.col("conv_id") % 7 == 3), F.lit('"n1"')).when((F.col("turn") == 0) & (F.col("conv_id") % 7 == 5), F.lit('"gone"')).when(
        F.col("turn") == 0, F.lit("null")).otherwise(F.concat(F.lit('"n'), (F.col("turn") - 1), F.lit('"')))
    node = F.concat(F.lit('"n'), "turn", F.lit('":{"parent":'), parent, F.lit(',"message":{"id":"m'), "turn", F.lit('","author":{"role":"'), "role",
                    F.lit('"},"content":{"content_type":"text","parts":['), tx.json_string(F.col("text")), F.lit(',"end"]}}}'))
    return _packed(t, node).select(F.concat(F.lit('{"conversation_id":"c'), "conv_id", F.lit('","current_node":"n'), (F.col("n") - 1), F.lit('","mapping":{'), "items", F.lit("}}")).alias("doc"))


@query("scan_export_messages_b", r"""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT 'c' || conv_id AS conversation_id, turn + 1 AS depth, 'n' || turn AS node, role, trim(text || chr(10) || 'end') AS text
 FROM conversations JOIN n USING (conv_id) WHERE role IN ('user', 'assistant') AND conv_id % 7 NOT IN (3, 5)""")
def scan_export_messages_b(t):
    return fi.messages_b(_export_b(t), "doc")


KV = """bub AS (SELECT 'bubbleId:c' || conv_id || ':b' || turn AS key, CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN NULL ELSE '' END AS gap, conv_id, turn, role, text FROM conversations)"""


def _kv(t):
    c = t.conversations
    bubble = F.concat(F.lit('{"type":'), F.when(F.col("role") == "user", "1").otherwise("2"), F.lit(',"text":'), tx.json_string(F.col("text")), F.lit("}"))
    bubbles = c.where("NOT (conv_id % 10 = 3 AND turn = 1)").select(F.concat(F.lit("bubbleId:c"), "conv_id", F.lit(":b"), "turn").alias("key"), bubble.alias("value"))
    heads = _packed(t, F.concat(F.lit('{"bubbleId":"b'), "turn", F.lit('"}'))).select(
        F.concat(F.lit("composerData:c"), "conv_id").alias("key"),
        F.when(F.col("conv_id") % 17 != 0, F.concat(F.lit('{"fullConversationHeadersOnly":['), "items", F.lit("]}"))).alias("value"))
    return bubbles.unionByName(heads)


@query("scan_kv_conversations", """WITH bad AS (SELECT DISTINCT conv_id FROM conversations WHERE (conv_id % 10 = 3 AND turn = 1) OR conv_id % 17 = 0)
 SELECT 'c' || conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad)""")
def scan_kv_conversations(t):
    return fi.kv_conversations(_kv(t))


@query("zip_export_scan", """SELECT 'a' || conv_id || '.zip' AS path, 'x/conversations-' || conv_id || '.json' AS member, CASE WHEN conv_id % 9 = 4 THEN 'bad' ELSE 'ok' END AS state, CASE WHEN conv_id % 9 <> 4 THEN count(*) END AS messages FROM conversations GROUP BY conv_id""")
def zip_export_scan(t):
    docs = _packed(t, F.concat(F.lit('{"turn":'), "turn", F.lit("}"))).select(
        F.concat(F.lit("a"), "conv_id", F.lit(".zip")).alias("path"), F.concat(F.lit("x/conversations-"), "conv_id", F.lit(".json")).alias("member"),
        F.when(F.col("conv_id") % 9 == 4, F.lit("[{")).otherwise(F.concat(F.lit("["), "items", F.lit("]"))).alias("body"))

    def pack(batches):
        for pdf in batches:
            out = []
            for path, member, body in zip(pdf["path"], pdf["member"], pdf["body"]):
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w") as z:
                    z.writestr("readme.txt", "x")
                    z.writestr(member, body)
                out.append((path, buf.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    members = fi.archive_members(docs.mapInPandas(pack, "path string, content binary"))
    good = F.try_parse_json("body").isNotNull()
    return members.select("path", "member", F.when(good, "ok").otherwise("bad").alias("state"),
                          F.when(good, F.json_array_length("body")).cast("bigint").alias("messages"))


# -- notes, documents, labels, logs ------------------------------------------------------------------

MD_PATH = "CASE doc_id % 8 WHEN 0 THEN '.trash/' WHEN 1 THEN 'templates/' WHEN 2 THEN source || '/.obs/' ELSE source || '/' END || doc_id || CASE WHEN doc_id % 8 = 3 THEN '.txt' ELSE '.md' END"


@query("scan_markdown_corpus", f"WITH p AS (SELECT {MD_PATH} AS path, text FROM documents) SELECT path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM p WHERE ends_with(path, '.md') AND NOT regexp_matches(path, '(^|/)\\.') AND NOT starts_with(path, 'templates/')")
def scan_markdown_corpus(t):
    f = t.documents.select(F.expr(MD_PATH).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return fi.markdown_notes(f).select("path", "size", "sha256")


@query("scan_plain_documents", "SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'a' || text ELSE text END AS text FROM documents WHERE doc_id % 6 <> 0")
def scan_plain_documents(t):
    nul = F.expr("CASE doc_id % 6 WHEN 0 THEN chr(0) || ' ' WHEN 1 THEN 'a' || chr(0) || text ELSE text END")
    return fi.plain_documents(t.documents.select("doc_id", nul.alias("text")), "text")


CASE_LINE = """CASE item_id % 6 WHEN 0 THEN '# comment' WHEN 1 THEN '' ELSE '{"question": "' || replace(substr(text, 1, 60), chr(10), ' ') || '"' || CASE WHEN item_id % 2 = 0 THEN ', "expect": ["src1/' || item_id || '.md"]' ELSE '' END || CASE WHEN item_id % 6 = 2 THEN ', "id": "x' || item_id || '", "split": "dev"' ELSE '' END || '}' END"""


@query("load_eval_cases", f"""WITH l AS (SELECT item_id, {CASE_LINE} AS v FROM benchmark), j AS (SELECT v::JSON AS c FROM l WHERE v LIKE '{{%'), k AS (SELECT c->>'$.id' AS id, c->>'$.question' AS question, c->>'$.expect[0]' AS e, c->>'$.split' AS split FROM j)
 SELECT coalesce(id, substr(sha1(question), 1, 8)) AS id, question, coalesce(e, '') AS expect, coalesce(split, CASE WHEN right(sha1(coalesce(e, question)), 1) IN ('1','3','5','7','9','b','d','f') THEN 'test' ELSE 'dev' END) AS split FROM k""")
def load_eval_cases(t):
    return fi.eval_cases(t.benchmark.select(F.expr(CASE_LINE).alias("v")), "v").select("id", "question", F.array_join("expect", "|").alias("expect"), "split")


@query("scan_recall_log", f"WITH {LOG} SELECT q, status, ms, count(*) AS n FROM rlog WHERE status IN ('hit', 'miss') AND date_trunc('second', ts) >= TIMESTAMP '2024-01-24' GROUP BY ALL")
def scan_recall_log(t):
    from memlake.queries.evals import recall_log
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    even = F.col("event_id") % 2 == 0
    line = F.to_json(F.struct(F.when(even, F.concat(stamp, F.lit("Z"))).alias("ts"), F.when(~even, stamp).alias("t"), "kind", "status", "q", "ms"))
    rows = fi.recall_log(recall_log(t).select(line.alias("v")), "v", "2024-01-31T00:00:00Z", 7)
    return rows.groupBy("q", "status", "ms").agg(mt.count_rows().alias("n"))


# -- sinks ---------------------------------------------------------------------------------------------

@query("sink_run_history", "SELECT event_type AS fingerprint, count(*) AS runs, sum(scheduled)::BIGINT AS scheduled FROM (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS scheduled FROM events GROUP BY ALL UNION ALL SELECT event_type, CAST(ts AS DATE), count(*) FROM events GROUP BY ALL) GROUP BY event_type")
def sink_run_history(t):
    from memlake.queries.sessions import runs
    root = fi.scratch(t.spark, "runs")
    for _ in range(2):
        st.append_run(runs(t).withColumn("rows", F.lit("detail")), root, ["rows"])
    return t.spark.read.parquet(f"{root}/history").groupBy("fingerprint").agg(mt.count_rows().alias("runs"), F.sum("scheduled").alias("scheduled"))


def _chunks(t):
    return pk.chunks(t.documents, "doc_id", "text", 500)


@query("sink_chunk_store", CHUNKS + r""", body AS (SELECT c.doc_id, c.idx, string_agg(l.l || CASE WHEN l.i < l.n THEN chr(10) ELSE '' END, '' ORDER BY l.i) AS b FROM ch c JOIN l0 l ON l.doc_id = c.doc_id AND l.i > c.s AND l.i <= c.e GROUP BY ALL),
 r AS (SELECT lang AS scope, sha256(b) AS revision, octet_length(encode(b)) AS bytes, doc_id FROM body JOIN documents USING (doc_id)) SELECT DISTINCT scope, revision, bytes FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id % 3 = 0 AND y.scope = x.scope AND y.revision = x.revision)""")
def sink_chunk_store(t):
    c = _chunks(t).join(t.documents.select("doc_id", F.col("lang").alias("scope")), "doc_id")
    stored = c.where("doc_id % 3 = 0").select("scope", "revision").distinct()
    return st.missing_chunks(c, stored).select("scope", "revision", "bytes")


@query("manifest_verify", CHUNKS + """ SELECT doc_id AS scope, idx, CASE WHEN doc_id % 9 = 0 AND idx = 0 THEN 'missing chunk' WHEN doc_id % 9 = 1 AND idx = 0 THEN 'hash mismatch' WHEN doc_id % 9 = 2 THEN 'line mismatch' ELSE 'ok' END AS reason FROM chunks""")
def manifest_verify(t):
    c = _chunks(t).withColumnRenamed("doc_id", "scope")
    manifest = c.select("scope", "idx", "revision", "bytes", (F.col("lines") + F.when(F.col("scope") % 9 == 2, 1).otherwise(0)).alias("lines"))
    held = c.where("NOT (scope % 9 = 0 AND idx = 0)").withColumn("body", F.when((F.col("scope") % 9 == 1) & (F.col("idx") == 0), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return st.verify(manifest, held)


@query("segment_offsets", CHUNKS + " SELECT doc_id, idx, first_line::BIGINT AS start_line FROM chunks")
def segment_offsets(t):
    return st.offsets(_chunks(t).select("doc_id", "idx", "lines"), "doc_id").select("doc_id", "idx", "start_line")


@query("locate_in_chunks", CHUNKS + " SELECT l.doc_id, l.i::BIGINT AS line, idx, (l.i - first_line + 1)::BIGINT AS local_line FROM l1 l JOIN chunks c ON c.doc_id = l.doc_id AND l.i BETWEEN first_line AND first_line + lines - 1")
def locate_in_chunks(t):
    seg = st.offsets(_chunks(t).select("doc_id", "idx", "lines"), "doc_id")
    total = seg.groupBy("doc_id").agg(F.max(F.col("start_line") + F.col("lines") - 1).alias("n"))
    lines = total.select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("line"))
    return st.locate(lines, seg, "doc_id")


PUB = f"""pub AS (SELECT event_id, session_id, sha256('["' || event || '","s-' || session_id || '","' || event_id || '","' || sha256(data) || '"]') AS pid, event_id % 3 = 0 AS processed, event_id % 4 = 0 AS visible FROM hooks)"""


@query("publication_status", f"WITH {HOOKS}, {PUB} SELECT event_id, pid AS publication_id, CASE WHEN processed THEN 'captured' WHEN visible THEN 'replayed' ELSE 'published' END AS status FROM pub")
def publication_status(t):
    h = demo.hooks(t)
    pid = st.identity(F.col("event"), F.concat(F.lit("s-"), F.col("session_id").cast("string")), F.col("event_id").cast("string"), F.sha2("data", 256))
    p = h.select("event_id", pid.alias("publication_id"))
    done = p.where("event_id % 3 = 0").select("publication_id", F.lit(True).alias("c"))
    seen = p.where("event_id % 4 = 0").select("publication_id", F.lit(True).alias("v"))
    return p.join(done, "publication_id", "left").join(seen, "publication_id", "left").select(
        "event_id", "publication_id", F.when(F.col("c"), "captured").when(F.col("v"), "replayed").otherwise("published").alias("status"))


@query("receipt_validation", f"""WITH {HOOKS} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'session' WHEN event_id % 13 = 0 THEN 'revision' WHEN event_id % 17 = 0 THEN 'publication id' WHEN event_id % 19 = 0 THEN 'stream' WHEN event_id % 23 = 0 THEN 'ordinal'
 WHEN event_id % 29 = 0 THEN 'event pair' WHEN event_id % 31 = 0 THEN 'event order' END AS reason FROM hooks""")
def receipt_validation(t):
    h = demo.hooks(t)
    bad = lambda k: F.col("event_id") % k == 0
    sess = F.when(bad(11), "bad session").otherwise(F.concat(F.lit("s-"), F.col("session_id").cast("string")))
    rev = F.when(bad(13), "short").otherwise(F.sha2("data", 256))
    r = h.select("event_id", "event", "ts", sess.alias("session_id"), F.col("event_id").cast("string").alias("logical_id"), rev.alias("logical_revision"))
    r = r.withColumn("publication_id", F.when(bad(17), "x").otherwise(st.identity(F.col("event"), F.col("session_id"), F.col("logical_id"), F.col("logical_revision"))))
    r = (r.withColumn("stream", F.when(bad(19), "x").otherwise(st.identity(F.col("event"), F.col("session_id"))))
         .withColumn("ordinal", F.when(bad(23), 0).otherwise(F.col("event_id") + 1))
         .withColumn("first_id", st.identity(F.col("publication_id"), F.lit("UserPromptSubmit")))
         .withColumn("last_id", F.when(bad(29), "x").otherwise(st.identity(F.col("publication_id"), F.lit("Stop"))))
         .withColumn("last_ts", F.when(bad(31), F.col("ts")).otherwise(F.expr("ts + INTERVAL 1 SECOND"))))
    c = {n: F.col(n) for n in ("session_id", "logical_id", "logical_revision", "publication_id", "stream", "ordinal", "first_id", "last_id", "last_ts")}
    return r.select("event_id", st.receipt_fault({**c, "source": F.col("event"), "first_ts": F.col("ts")}).alias("reason"))


@query("sink_idempotent_upsert", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def sink_idempotent_upsert(t):
    root = fi.scratch(t.spark, "upsert")
    for part in (t.events.where("event_id % 2 = 0"), t.events, t.events.where("event_id % 3 = 0")):
        st.upsert(part.select("event_id", "event_type"), root, "event_id")
    return t.spark.read.parquet(root).groupBy("event_type").agg(mt.count_rows().alias("n"))


# -- set operations ----------------------------------------------------------------------------------------

@query("scope_union", f"WITH {NOTES}, u AS (SELECT collection, 0 AS k, doc_id FROM notes WHERE lang = 'de' UNION ALL SELECT collection, 1, doc_id FROM notes WHERE lang = 'es') SELECT collection, row_number() OVER (ORDER BY min(k * 1000000000 + doc_id)) AS pos FROM u GROUP BY collection")
def scope_union(t):
    n = demo.notes(t)
    part = lambda lang, k: n.where(F.col("lang") == lang).select("collection", F.struct(F.lit(k).alias("k"), "doc_id").alias("at"))
    first = part("de", 0).unionByName(part("es", 1)).groupBy("collection").agg(F.min("at").alias("at")).select("collection", "at.k", "at.doc_id")
    return number_rows(first, [], ["k", "doc_id"], None, "pos").select("collection", "pos")


@query("key_set_equality", """WITH a AS (SELECT source, doc_id FROM documents), b AS (SELECT source, doc_id FROM documents WHERE NOT (source = 'src3' AND doc_id % 50 = 3) UNION ALL SELECT source, doc_id FROM documents WHERE source = 'src4' AND doc_id % 50 = 4 UNION ALL SELECT 'src5', -1),
 f AS (SELECT coalesce(a.source, x.source) AS source, a.doc_id IS NOT NULL AND x.n = 1 AS ok FROM a FULL JOIN (SELECT source, doc_id, count(*) AS n FROM b GROUP BY ALL) x ON a.source = x.source AND a.doc_id = x.doc_id) SELECT source, bool_and(coalesce(ok, false)) AS equal FROM f GROUP BY source""")
def key_set_equality(t):
    a = t.documents.select("source", "doc_id")
    b = (a.where("NOT (source = 'src3' AND doc_id % 50 = 3)").unionByName(a.where("source = 'src4' AND doc_id % 50 = 4"))
         .unionByName(a.limit(1).select(F.lit("src5").alias("source"), F.lit(-1).cast("bigint").alias("doc_id"))))
    side = a.select("source", "doc_id", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("source", "doc_id", F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = side.groupBy("source", "doc_id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return per.groupBy("source").agg(F.bool_and((F.col("x") == 1) & (F.col("y") == 1)).alias("equal"))


@query("equivalent_revisions", "SELECT conv_id, conv_id % 5 <> 2 AND conv_id % 7 <> 1 AS equivalent FROM conversations GROUP BY conv_id")
def equivalent_revisions(t):
    a = t.conversations.select("conv_id", "turn", "text")
    b = a.where("NOT (conv_id % 7 = 1 AND turn = 0)").withColumn("text", F.when(F.col("conv_id") % 5 == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return st.equivalent(a, b, "conv_id", "turn", "text")


@query("append_only_delta", "SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 THEN 'full-replay' ELSE 'append-only-delta' END AS mode FROM conversations WHERE conv_id % 4 = 1 OR turn >= 2")
def append_only_delta(t):
    new = t.conversations.select("conv_id", "turn", "text")
    old = new.where("turn < 2").withColumn("text", F.when((F.col("conv_id") % 4 == 1) & (F.col("turn") == 0), F.lit("changed")).otherwise(F.col("text")))
    return st.append_only_delta(old, new, "conv_id", "turn", "text")


# -- joins over notes --------------------------------------------------------------------------------------

@query("admit_hits", PASSAGE + """ SELECT d.doc_id, CASE WHEN d.source = 'src9' THEN 'out of scope' WHEN p.doc_id IS NULL THEN 'no passage' WHEN d.doc_id % 5 = 0 AND p.s = 0 THEN 'stale without overlap' WHEN d.doc_id % 31 = 0 THEN 'session note' ELSE 'admitted' END AS reason
 FROM documents d LEFT JOIN passage p ON p.doc_id = d.doc_id AND p.rn = 1""")
def admit_hits(t):
    from memlake.operators.passages import select_passage
    hits = t.documents.select("doc_id", "source", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("indexed"),
                              (F.col("doc_id") % 31 == 0).alias("is_session"))
    best = select_passage(demo.pairs(t), ["doc_id"], "text", "question", 260).select("doc_id", "revision", "score")
    j = hits.join(best, "doc_id", "left")
    scoped = F.col("source") != "src9"
    reason = (F.when(~scoped, "out of scope").when(F.col("score").isNull(), "no passage").when((F.col("indexed") != F.col("revision")) & (F.col("score") == 0), "stale without overlap")
              .when(F.col("is_session"), "session note").otherwise("admitted"))
    return j.select("doc_id", reason.alias("reason"))


@query("label_match", "SELECT doc_id, doc_id % 4 IN (0, 2) AS matched FROM documents")
def label_match(t):
    n = demo.notes(t)
    hits = n.select("doc_id", tx.normalize_ref(F.col("uri")).alias("ref"), "revision")
    m4 = F.col("doc_id") % 4
    none = F.lit(None).cast("string")
    label = lambda sid, rev, mirror: F.struct(sid.alias("source_id"), rev.alias("revision"), mirror.alias("mirror"))
    src = F.concat(F.col("collection"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    labels = n.select("doc_id", F.explode(F.array(
        label(F.when(m4 == 0, src).otherwise(F.lit("other/x.md")), none, F.lit(False)),
        label(F.when(m4 == 2, src), F.when(m4 == 2, F.col("revision")), F.lit(True)),
        label(F.when(m4 == 3, src), F.when(m4 == 3, F.lit("old")), F.lit(False)),
        label(F.when(m4 == 1, src), none, F.lit(True)))).alias("l"))
    # A mirror of a revisioned label must name the revision itself.
    usable = labels.select("doc_id", tx.normalize_ref(F.col("l.source_id")).alias("ref"), F.col("l.revision").alias("want"), F.col("l.mirror").alias("mirror")).where("ref <> '' AND NOT (mirror AND want IS NULL)")
    ok = hits.join(usable, ["doc_id", "ref"]).groupBy("doc_id").agg(F.bool_or(F.col("want").isNull() | (F.col("want") == F.col("revision"))).alias("m"))
    return hits.join(ok, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(False)).alias("matched"))


@query("path_to_collection", r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), r AS (SELECT DISTINCT regexp_extract(u, '^(https?://[^/]+)', 1) AS root FROM p UNION SELECT DISTINCT regexp_extract(u, '^(https?://[^/]+/fr)/', 1) FROM p WHERE contains(u, '/fr/')),
 m AS (SELECT page_id, u, root FROM p JOIN r ON starts_with(u, root || '/')), c AS (SELECT page_id, min(u) AS u, min(root) AS root, count(*) AS n FROM m GROUP BY page_id)
 SELECT p.page_id, CASE WHEN n = 1 THEN 'qmd://' || regexp_replace(root, '^https?://', '') || substr(p.u, length(root) + 1) ELSE p.u END AS ref FROM p LEFT JOIN c USING (page_id)""")
def path_to_collection(t):
    p = t.pages.select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u"))
    host = F.regexp_extract("u", r"^(https?://[^/]+)", 1)
    roots = p.select(host.alias("root")).union(p.where("u LIKE '%/fr/%'").select(F.regexp_extract("u", r"^(https?://[^/]+/fr)/", 1))).where("root <> ''").distinct()
    # A path has few ancestors: explode them and join on equality instead of a prefix scan.
    steps = F.split("u", "/")
    up = p.select("page_id", "u", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.size(steps) - 1, F.lit(3))), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("root"))
    one = up.join(roots, "root").groupBy("page_id").agg(F.min("root").alias("root"), mt.count_rows().alias("n")).where("n = 1")
    ref = F.concat(F.lit("qmd://"), F.regexp_replace("root", "^https?://", ""), F.expr("substr(u, length(root) + 1)"))
    return p.join(one, "page_id", "left").select("page_id", F.coalesce(ref, F.col("u")).alias("ref"))


@query("unchanged_skip", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING conv_id % 3 = 0 OR conv_id % 5 = 0")
def unchanged_skip(t):
    c = t.conversations.groupBy("conv_id").agg(mt.multiset_digest(F.sha2(F.concat_ws("\n", F.col("turn").cast("string"), "role", "text"), 256)).alias("digest"))
    seen = c.where("conv_id % 5 <> 0").select("conv_id", F.when(F.col("conv_id") % 3 == 0, "older").otherwise(F.col("digest")).alias("digest"))
    return c.join(seen, ["conv_id", "digest"], "left_anti").select("conv_id")


@query("pending_events", "SELECT user_id AS session_id, count(*) AS pending, min(event_id) AS first_event FROM events WHERE value < 20 GROUP BY user_id")
def pending_events(t):
    processed = t.events.where("value >= 20").select("event_id")
    return (t.events.join(processed, "event_id", "left_anti").groupBy(F.col("user_id").alias("session_id"))
            .agg(mt.count_rows().alias("pending"), F.min("event_id").alias("first_event")))


@query("folder_lookup", "SELECT c_custkey, coalesce(n_name, 'default') AS folder FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey")
def folder_lookup(t):
    folders = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(folders, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("default")).alias("folder"))


# One set per benchmark item, from the first words of its text, and one more that names notes.
OWN_SET, TG = [(-1, k) for k in ("n1", "the", "src1-5", "alt de")], [(-1, "en"), (-1, "decision"), (3, "fr"), (4, "decision")]
SETS_SQL = f"""{ITEM_Q}, ks AS (SELECT item_id, qterm AS k FROM qt UNION ALL SELECT * FROM (VALUES {', '.join(map(str, OWN_SET))})), tg AS (SELECT * FROM (VALUES {', '.join(map(str, TG))}) t(item_id, tag))"""


@query("related_notes", INDEX + f""", {SETS_SQL}, al AS (SELECT doc_id, unnest(string_split(lower(aliases), '|')) AS a FROM note_index WHERE aliases <> ''),
 pt AS (SELECT item_id, doc_id, CASE WHEN lower(stem) = k THEN 100 WHEN contains(lower(stem), k) THEN 50 ELSE 0 END + CASE WHEN contains(lower(title), k) THEN 20 ELSE 0 END + CASE WHEN contains(lower(preview), k) THEN 5 ELSE 0 END AS p FROM note_index, ks
  UNION ALL SELECT item_id, doc_id, CASE WHEN a = k THEN 80 ELSE 40 END FROM al JOIN ks ON contains(a, k)
  UNION ALL SELECT item_id, doc_id, 30 FROM (SELECT DISTINCT doc_id, unnest(string_split(tags, '|')) AS tag FROM note_index) JOIN tg USING (tag)),
 s AS (SELECT item_id, doc_id, sum(p)::BIGINT AS score FROM pt GROUP BY ALL HAVING sum(p) > 0)
 SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS pos FROM s) WHERE pos <= 50""")
def related_notes(t):
    from memlake.operators.notes import related_sets
    make = t.spark.createDataFrame
    asked = ix.query_terms(t.benchmark, ["item_id"], tx.keyword_query(F.col("text"))).select("item_id", F.col("qterm").alias("keyword"))
    keywords = asked.unionByName(make(OWN_SET, "item_id bigint, keyword string"))
    scored = related_sets(note_index_frame(t), "doc_id", "item_id", keywords, make(TG, "item_id bigint, tag string"))
    return ix.top(scored, ["item_id"], [F.desc("score"), F.asc("doc_id")], 50).select("item_id", "doc_id", "score", "pos")


@query("link_suggestions", f"""WITH {CENTROID_SQL}, s AS (SELECT c.label AS concept, vec_id, e.label AS own, {COSINE_SQL} AS score FROM embeddings e, cen c), k AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY score DESC, vec_id) AS rn FROM s WHERE score >= 0.1)
 SELECT concept, vec_id, score FROM k WHERE rn <= 5 AND vec_id <> concept AND own <> 9 AND vec_id % 10 <> concept""")
def link_suggestions(t):
    q = label_centroids(t).withColumnRenamed("label", "concept")
    best = cx.nearest(stored_cells(t), q, ["concept"], "centroid", "vec_id", 5, floor=0.1)
    linked = t.embeddings.select("vec_id", (F.col("vec_id") % 10).cast("int").alias("concept"))
    return best.where("vec_id <> concept AND label <> 9").join(linked, ["vec_id", "concept"], "left_anti").select("concept", "vec_id", "score")


@query("semantic_duplicate", f"""WITH {CENTROID_SQL}, s AS (SELECT label, vec_id, {COSINE_SQL} AS score FROM embeddings JOIN cen USING (label)), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s)
 SELECT label, vec_id, score FROM k WHERE rn = 1 AND score >= 0.30""")
def semantic_duplicate(t):
    scored = vx.similar(t.embeddings, label_centroids(t), "embedding", "centroid", DIM, on=["label"], floor=0.30)
    return ix.top(scored, ["label"], [F.desc("score"), F.asc("vec_id")], 1).select("label", "vec_id", "score")


@query("merge_decision", """WITH g AS (SELECT lang, source, count(*) AS sources, count(CASE WHEN n_chars > 300 THEN 1 END) AS origins, sum(n_chars) AS size, count(DISTINCT sha256(text)) AS fresh FROM documents GROUP BY ALL)
 SELECT lang, source, CASE WHEN lang = 'es' THEN 'merge disabled' WHEN sources >= 30 THEN 'concept source limit reached' WHEN origins = 0 THEN 'actual source path unavailable' WHEN size > 24000 THEN 'existing note exceeds bounded merge assessment' WHEN fresh < sources THEN 'no new addition' ELSE 'merge' END AS decision FROM g""")
def merge_decision(t):
    from memlake.operators.notes import merge_rule
    g = t.documents.groupBy("lang", "source").agg(mt.count_rows().alias("sources"), F.count(F.when(F.col("n_chars") > 300, 1)).alias("origins"), F.sum("n_chars").alias("size"), F.countDistinct(F.sha2("text", 256)).alias("fresh"))
    return g.select("lang", "source", merge_rule(F.col("lang") != "es", F.col("sources"), F.col("origins"), F.col("size"), F.col("fresh") == F.col("sources"), most=30).alias("decision"))


@query("index_diff", """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '1') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0)
 SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def index_diff(t):
    from memlake.operators.notes import diff
    old = t.documents.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("1"))).otherwise(F.col("text")), 256).alias("h"))
    new = t.documents.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    return diff(old, new, "doc_id", "h")


@query("source_concept_index", INDEX + """, l AS (SELECT v.source, nl.link, min(v.doc_id * 100 + nl.i) AS at0 FROM note_links nl JOIN vault v USING (doc_id) WHERE nl.link IN (SELECT stem FROM vault) GROUP BY ALL)
 SELECT source, link, row_number() OVER (PARTITION BY source ORDER BY at0) AS place FROM l""")
def source_concept_index(t):
    n = note_index_frame(t)
    links = tx.unnest(n, ["doc_id", "source"], F.col("links"), "link", "i")
    known = demo.vault(t).select(F.col("stem").alias("link"))
    first = links.join(known, "link", "left_semi").groupBy("source", "link").agg(F.min(F.struct("doc_id", "i")).alias("f")).select("source", "link", "f.doc_id", "f.i")
    return number_rows(first, ["source"], ["doc_id", "i", "link"], F.floor(F.col("doc_id") / 1000), "place").select("source", "link", "place")


@query("lesson_changes", f"""WITH e AS (SELECT {ENTRY_COLS} FROM documents), ev AS (SELECT scope, key, sequence * 2 + 1 AS s, 1 AS live, doc_id FROM e UNION ALL SELECT scope, drops, sequence * 2, 0, NULL FROM e WHERE drops IS NOT NULL),
 p AS (SELECT *, lag(live) OVER (PARTITION BY scope, key ORDER BY s) AS was FROM ev) SELECT doc_id, key, CASE WHEN was = 1 THEN 'updated' ELSE 'created' END AS change FROM p WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, drops, 'superseded' FROM e WHERE drops IS NOT NULL""")
def lesson_changes(t):
    e = entries(t)
    sets = e.select("scope", "key", (F.col("sequence") * 2 + 1).alias("s"), F.lit(1).alias("live"), "doc_id")
    drops = e.where("drops IS NOT NULL").select("scope", F.col("drops").alias("key"), (F.col("sequence") * 2).alias("s"), F.lit(0).alias("live"), F.lit(None).cast("bigint").alias("doc_id"))
    r = running(sets.unionByName(drops), ["scope", "key"], ["s"], F.floor(F.col("s") / 100_000), {"was": ("lag", F.col("live"), False)})
    known = r.where("doc_id IS NOT NULL").select("doc_id", "key", F.when(F.col("was") == 1, "updated").otherwise("created").alias("change"))
    return known.unionByName(e.where("drops IS NOT NULL").select("doc_id", F.col("drops").alias("key"), F.lit("superseded").alias("change")))


@query("freshness_reconcile", """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'edited' END AS outcome FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0""")
def freshness_reconcile(t):
    from memlake.operators.notes import reconcile
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("revision"))
    tracked = d.withColumn("status", F.when(F.col("doc_id") % 10 == 0, "pending").otherwise("saved"))
    current = d.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("revision")).alias("now"))
    return reconcile(tracked, current, "doc_id")


PROOF = """CASE WHEN doc_id % 13 = 1 THEN 'proof_revision_absent' WHEN doc_id % 13 = 2 THEN 'proof_revision_ambiguous' WHEN doc_id % 13 = 3 THEN 'proof_revision_inactive' WHEN doc_id % 13 = 4 THEN 'proof_revision_mismatch'
 WHEN doc_id % 13 = 5 THEN 'proof_content_hash_mismatch' WHEN doc_id % 13 = 6 THEN 'proof_fts_mismatch' ELSE 'ok' END"""


def _proved(t):
    from memlake.operators.notes import proof
    d = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("revision"), "text")
    m = F.col("doc_id") % 13
    idx = d.where(m != 1).select("doc_id", F.explode(F.when(m == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("row"), (m != 3).alias("active"),
                                 F.when(m == 4, "other").otherwise(F.col("revision")).alias("hash"), F.when(m == 5, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("doc"),
                                 F.when(m == 6, F.lit("stale")).otherwise(F.col("text")).alias("fts"))
    return proof(d.select("doc_id", "source", "revision"), idx, "doc_id")


@query("index_proof", f"WITH p AS (SELECT doc_id, source, {PROOF} AS code FROM documents) SELECT source, code, count(*) AS n, min(doc_id) AS first_doc FROM p GROUP BY ALL")
def index_proof(t):
    return _proved(t).groupBy("source", "code").agg(mt.count_rows().alias("n"), F.min("doc_id").alias("first_doc"))


@query("index_verdicts", f"""WITH p AS (SELECT source || '/' || doc_id % 97 AS scope, {PROOF} AS code FROM documents) SELECT scope, bool_and(code = 'ok') AS proved, min(CASE WHEN code <> 'ok' THEN code END) AS first_failure, count(*) AS tracked FROM p GROUP BY scope""")
def index_verdicts(t):
    """One verdict per scope: a single revision that is not proved fails all of it."""
    from memlake.operators.notes import verdicts
    return verdicts(_proved(t).withColumn("scope", F.concat_ws("/", "source", (F.col("doc_id") % 97).cast("string"))), "scope")
