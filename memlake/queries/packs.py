"""Packs, claims, derivations, sections, chunks and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import fixed, packs as pk, text as tx
from memlake.operators import passages as ps
from memlake.queries import demo
from memlake.queries.demo import NL, PAIRS, VAULT, clean_sql, lit, sql_list, terms_sql
from memlake.registry import query

OUTPUT = f"""CASE doc_id % 5 WHEN 0 THEN '```json' || {NL} || '{{"session_id": "s' || doc_id || '", "title": "' || lang || '"}}' || {NL} || '```'
 WHEN 1 THEN 'Here it is: {{"session_id": "s' || doc_id || '", "title": "' || source || '"}} as asked' WHEN 2 THEN '{{"session_id": "s' || doc_id
 WHEN 3 THEN 'no object at all' ELSE '{{"session_id": "s' || doc_id || '", "title": "t"}}' END"""


@query("model_output_json", rf"""WITH a AS (SELECT doc_id, trim({OUTPUT}) AS s FROM documents),
 b AS (SELECT doc_id, regexp_extract(CASE WHEN starts_with(s, '```') THEN trim(regexp_replace(regexp_replace(s, '\A```[^\n]*\n', ''), '```\z', ''), chr(10) || ' ') ELSE s END, '(\{{[\s\S]*\}})', 1) AS j, s FROM a)
 SELECT doc_id, CASE WHEN json_valid(j) THEN j->>'$.session_id' END AS session_id, CASE WHEN json_valid(j) THEN j->>'$.title' END AS title FROM b""")
def model_output_json(t):
    j = pk.valid_json(pk.outermost_json(F.expr(OUTPUT)))
    return (t.documents.select("doc_id", j.alias("j"))
            .select("doc_id", F.get_json_object("j", "$.session_id").alias("session_id"), F.get_json_object("j", "$.title").alias("title")))


PACK_COLS = """doc_id, CASE WHEN doc_id % 31 = 0 THEN '' ELSE 's' || doc_id END AS session_id,
 CASE doc_id % 7 WHEN 0 THEN '2024-13-01' WHEN 1 THEN '' ELSE '2024-01-02' END AS date,
 CASE WHEN doc_id % 29 = 0 THEN '' ELSE substr(text, 1, 30) END AS title,
 'about ' || lang AS c0_name, substr(text, 1, CASE WHEN doc_id % 3 = 0 THEN 600 ELSE 90 END) AS c0_summary,
 CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS c1_name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(text, 5, 50) END AS c1_summary,
 'create' AS o0_op, source || '/n' || doc_id || '.md' AS o0_path, text AS o0_body,
 CASE doc_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'gotcha' WHEN 2 THEN 'zzz' END AS o0_type, '' AS o0_block,
 CASE doc_id % 3 WHEN 0 THEN 'append' WHEN 1 THEN 'upsert_block' ELSE 'erase' END AS o1_op,
 CASE doc_id % 6 WHEN 0 THEN 'a/../x.md' WHEN 1 THEN '/abs.md' WHEN 2 THEN 'a.txt' WHEN 3 THEN '' ELSE 'b.md' END AS o1_path,
 substr(text, 1, 20) AS o1_body, 'meta' AS o1_type, CASE doc_id % 5 WHEN 0 THEN 'bad id' WHEN 1 THEN '' ELSE 'blk-1' END AS o1_block,
 's1' AS o0_span, CASE WHEN doc_id % 8 = 0 THEN 's9' WHEN doc_id % 8 = 1 THEN '' ELSE 's2' END AS o1_span"""
PACKS = f"""packs AS (SELECT {PACK_COLS} FROM documents),
 concepts AS (SELECT doc_id, 0 AS i, c0_name AS name, c0_summary AS summary FROM packs UNION ALL SELECT doc_id, 1, c1_name, c1_summary FROM packs),
 ops AS (SELECT doc_id, 0 AS i, o0_op AS op, o0_path AS path, o0_body AS body, o0_type AS type, o0_block AS block_id, o0_span AS span FROM packs
  UNION ALL SELECT doc_id, 1, o1_op, o1_path, o1_body, o1_type, o1_block, o1_span FROM packs)"""


def _packs(t):
    p = demo.project(t.documents, PACK_COLS)
    concept = lambda i: F.struct(F.col(f"c{i}_name").alias("name"), F.col(f"c{i}_summary").alias("summary"))
    op = lambda i: F.struct(*[F.col(f"o{i}_{a}").alias(b) for a, b in (("op", "op"), ("path", "path"), ("body", "body"),
                                                                       ("type", "type"), ("block", "block_id"))],
                            F.filter(F.array(f"o{i}_span"), lambda s: s != "").alias("spans"))
    return p.select("doc_id", "session_id", "date", "title", F.array(concept(0), concept(1)).alias("concepts"),
                    F.array(op(0), op(1)).alias("note_ops"), F.array(F.lit("s1"), F.lit("s2"), F.lit("s3")).alias("source_spans"))


@query("validate_pack", rf"""WITH {PACKS}, w AS (
 SELECT doc_id, 'Missing session_id' AS warning FROM packs WHERE session_id = '' UNION ALL SELECT doc_id, 'Missing date' FROM packs WHERE date = ''
 UNION ALL SELECT doc_id, 'Invalid date' FROM packs WHERE date <> '' AND try_cast(date AS DATE) IS NULL UNION ALL SELECT doc_id, 'Missing title' FROM packs WHERE title = ''
 UNION ALL SELECT doc_id, 'Concept ' || i || ': missing name' FROM concepts WHERE name = '' UNION ALL SELECT doc_id, 'Concept ' || i || ': missing summary' FROM concepts WHERE summary = ''
 UNION ALL SELECT doc_id, 'Concept ' || i || ': summary too long (>500 chars)' FROM concepts WHERE length(summary) > 500
 UNION ALL SELECT doc_id, 'NoteOp ' || i || ': invalid op ''' || op || '''' FROM ops WHERE op NOT IN ('create', 'upsert_block', 'append')
 UNION ALL SELECT doc_id, 'NoteOp ' || i || ': missing path' FROM ops WHERE path = ''
 UNION ALL SELECT doc_id, 'NoteOp ' || i || ': unsafe path' FROM ops WHERE path <> '' AND (NOT ends_with(path, '.md') OR regexp_matches(path, '^[/~]') OR list_contains(string_split(path, '/'), '..'))
 UNION ALL SELECT doc_id, 'NoteOp ' || i || ': invalid or oversized body' FROM ops WHERE length(body) > 100000
 UNION ALL SELECT doc_id, 'NoteOp ' || i || ': create op missing frontmatter' FROM ops WHERE op = 'create' AND type IS NULL
 UNION ALL SELECT doc_id, 'NoteOp ' || i || ': missing or invalid type ' || coalesce('''' || type || '''', 'None') || '; choose an explicit note type' FROM ops
   WHERE op = 'create' AND coalesce(type NOT IN {sql_list(fixed.NOTE_TYPES)}, true)
 UNION ALL SELECT doc_id, 'NoteOp ' || i || ': upsert_block op missing managed_block_id' FROM ops WHERE op = 'upsert_block' AND block_id = ''
 UNION ALL SELECT doc_id, 'NoteOp ' || i || ': invalid managed block ID' FROM ops WHERE block_id <> '' AND NOT regexp_matches(block_id, '{fixed.BLOCK_ID}')) SELECT * FROM w""")
def validate_pack(t):
    p = _packs(t)
    return p.select("doc_id", F.explode_outer(pk.warnings({c: F.col(c) for c in p.columns})).alias("warning")).where("warning IS NOT NULL")


@query("pack_explode", f"""WITH {PACKS} SELECT doc_id, 'concept' AS part, CAST(i AS BIGINT) AS i, name AS name, summary AS body FROM concepts
 UNION ALL SELECT doc_id, 'note_op', CAST(i AS BIGINT), op || ' ' || path, body FROM ops""")
def pack_explode(t):
    p = _packs(t)
    concepts = (tx.unnest(p, ["doc_id"], F.col("concepts"), "c", "i")
                .select("doc_id", F.lit("concept").alias("part"), (F.col("i") - 1).alias("i"), "c.name", F.col("c.summary").alias("body")))
    ops = (tx.unnest(p, ["doc_id"], F.col("note_ops"), "o", "i")
           .select("doc_id", F.lit("note_op").alias("part"), (F.col("i") - 1).alias("i"),
                   F.concat_ws(" ", "o.op", "o.path").alias("name"), "o.body"))
    return concepts.unionByName(ops)


@query("content_fingerprint", f"""WITH {PACKS} SELECT doc_id, sha256('{{"concepts":[{{"name":' || to_json(c0_name)::VARCHAR || ',"summary":' || to_json(c0_summary)::VARCHAR || '}},{{"name":' ||
 to_json(c1_name)::VARCHAR || ',"summary":' || to_json(c1_summary)::VARCHAR || '}}],"note_ops":[{{"body_markdown":' || to_json(o0_body)::VARCHAR || ',"op":"create"}},{{"body_markdown":' ||
 to_json(o1_body)::VARCHAR || ',"op":"' || o1_op || '"}}]}}') AS fingerprint FROM packs""")
def content_fingerprint(t):
    return _packs(t).select("doc_id", pk.fingerprint(F.col("concepts"), F.col("note_ops")).alias("fingerprint"))


@query("source_support_check", f"""WITH {PACKS} SELECT doc_id, CAST(i AS BIGINT) AS i, span IN ('s1', 's2', 's3') AS supported FROM ops""")
def source_support_check(t):
    p = _packs(t)
    return (tx.unnest(p, ["doc_id", "source_spans"], F.col("note_ops"), "o", "i")
            .select("doc_id", (F.col("i") - 1).alias("i"), pk.supported(F.col("o.spans"), F.col("source_spans")).alias("supported")))


INBOX = f"""'# Inbox' || {NL} || '## 2024-01-0' || (1 + doc_id % 9) || ' - first ' || lang || {NL} || {NL} || '**Highlights:**' || {NL} || '- a ' || doc_id || {NL} || '- b' || {NL} || {NL}
 || '## 2024-02-01 - second' || {NL} || replace(substr(text, 1, 50), {NL}, ' ') || {NL} || '## 2024-03-0' || (1 + doc_id % 3) || ' - third ' || source || {NL} || '**Highlights:**' || {NL} || '- ' || replace(substr(text, 1, 30), {NL}, ' ') || {NL}"""


@query("inbox_entries", f"""SELECT doc_id, 1::BIGINT AS pos, '2024-02-01' AS date, 'second' AS title, '' AS highlights FROM documents UNION ALL
 SELECT doc_id, 2, '2024-03-0' || (1 + doc_id % 3), 'third ' || source, replace(substr(text, 1, 30), chr(10), ' ') FROM documents""")
def inbox_entries(t):
    return (tx.unnest(t.documents.select("doc_id", F.expr(INBOX).alias("c")), ["doc_id"], pk.inbox_entries(F.col("c"), 2), "e", "pos")
            .select("doc_id", "pos", "e.date", "e.title", F.array_join("e.highlights", "|").alias("highlights")))


@query("extract_derivations", rf"""WITH {VAULT}, f AS (SELECT doc_id, note, regexp_extract(note, '(?s)\A---\s*\n(.*?)\n---', 1) AS fr FROM vault),
 k AS (SELECT *, regexp_extract(fr, '(?m)^derivation_sources:[ ]*(.*)$', 1) AS v, regexp_matches(fr, '(?m)^derivation_sources:') AS has,
   regexp_extract_all(regexp_extract(fr, '(?m)^derivation_sources:\n((?:  - .*(?:\n|\z))*)', 1), '  - "(.*)"', 1) AS items,
   regexp_extract_all(note, '(?m)^<!-- memlake:provenance (\{{[^\n]*\}}) -->\s*$', 1) || regexp_extract_all(note, '<!--\s*memlake:claim\b\s*(.*?)\s*-->', 1) AS recs FROM f),
 o AS (SELECT doc_id, has AND v <> '' AND NOT json_valid(v) OR len(list_filter(recs, lambda r: NOT json_valid(r))) > 0 AS denied,
   list_concat(CASE WHEN NOT has THEN [] WHEN v <> '' AND json_valid(v) THEN CAST(v::JSON AS VARCHAR[]) ELSE items END,
   flatten(list_transform(list_filter(recs, lambda r: json_valid(r)), lambda r: CAST((r::JSON)->'$.derivation_sources' AS VARCHAR[])))) AS os FROM k),
 u AS (SELECT doc_id, unnest(os) AS o, generate_subscripts(os, 1) AS i FROM o WHERE NOT denied), g AS (SELECT doc_id, o, min(i) AS i FROM u GROUP BY doc_id, o),
 s AS (SELECT doc_id, string_agg(o, '|' ORDER BY i) AS origins FROM g GROUP BY doc_id)
 SELECT doc_id, denied, CASE WHEN NOT denied THEN coalesce(origins, '') END AS origins FROM o LEFT JOIN s USING (doc_id)""")
def extract_derivations(t):
    origins, denied = pk.derivations(F.col("note"), "memlake")
    return demo.vault(t).select("doc_id", denied.alias("denied"), F.array_join(origins, "|").alias("origins"))


CLAIMS = rf"""WITH {VAULT}, r AS (SELECT doc_id, unnest(regexp_extract_all(note, '(?m)^<!-- memlake:claim (\{{[^\n]*\}}) -->\s*$', 1))::JSON AS c FROM vault),
 claims AS (SELECT doc_id, c->>'$.claim_id' AS claim_id, c->>'$.text' AS text, c->>'$.status' AS status, c->>'$.valid_from' AS valid_from, c->>'$.derivation_sources[0]' AS origin FROM r
 WHERE c->>'$.status' IN ('proposed', 'observed', 'verified', 'approved', 'superseded') AND try_cast(c->>'$.valid_from' AS TIMESTAMP) IS NOT NULL)"""


@query("extract_claims", CLAIMS + """ SELECT doc_id, claim_id, text, status, sha256('{"audiences":["host"],"claim_id":"' || claim_id || '","claim_type":"lesson","contradicts":[],"depends_on":[],"derivation_sources":["'
 || origin || '"],"observed_at":"","recorded_at":"","scope":{},"source_revision":"","source_spans":[],"status":"' || status || '","supersedes":[],"text":"' || text || '","valid_from":"' || valid_from ||
 '","valid_until":"","verification_evidence":[]}') AS digest FROM claims""")
def extract_claims(t):
    return pk.claims(demo.vault(t), ["doc_id"], F.col("note"), "memlake").select("doc_id", "claim_id", "text", "status", "digest")


SECTIONS = rf"""WITH RECURSIVE {VAULT}, pieces AS (SELECT doc_id, note, regexp_split_to_array(note, '\n') AS ls FROM vault),
 lines AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM pieces),
 pos AS (SELECT doc_id, l, lag(l) OVER (PARTITION BY doc_id ORDER BY i) AS before, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS p FROM lines),
 bounds AS (SELECT doc_id, p, CASE WHEN l = '' THEN 2 ELSE length(regexp_extract(l, '^(#{{1,6}} )', 1)) + 1 END AS n FROM pos
   WHERE p >= 0 AND (l = '' OR (before <> '' AND regexp_matches(l, '^#{{1,6}} ')))),
 cut AS (SELECT doc_id, 0::BIGINT AS idx, 0::BIGINT AS start, coalesce(CASE WHEN length(note) > 1000 THEN (SELECT max(p) FROM bounds b WHERE b.doc_id = v.doc_id AND p > 500 AND p + n <= 1000) END, least(1000, length(note)))::BIGINT AS "end" FROM vault v
  UNION ALL SELECT c.doc_id, idx + 1, c."end", coalesce(CASE WHEN length(note) > c."end" + 1000 THEN (SELECT max(p) FROM bounds b WHERE b.doc_id = c.doc_id AND p > c."end" + 500 AND p + n <= c."end" + 1000) END,
   least(c."end" + 1000, length(note)))::BIGINT FROM cut c JOIN vault v ON v.doc_id = c.doc_id WHERE c."end" < length(note))"""


def _sections(t):
    return pk.sections(demo.vault(t), "doc_id", "note", 1000)


@query("document_sections", SECTIONS + """ SELECT c.doc_id, idx, start, c."end", sha256(substr(note, start + 1, c."end" - start)) AS revision,
 'chars:' || start || '-' || c."end" || '@' || sha256(note) AS anchor FROM cut c JOIN vault v ON v.doc_id = c.doc_id""")
def document_sections(t):
    return _sections(t).select("doc_id", "idx", "start", "end", "revision", "anchor")


@query("section_rollup", SECTIONS + """ SELECT c.doc_id, count(*) AS sections, CAST(sum(c."end" - start) AS BIGINT) AS covered_characters, max(length(note)) = sum(c."end" - start) AS complete,
 string_agg(substr(note, start + 1, c."end" - start), '|' ORDER BY idx) AS summary FROM cut c JOIN vault v ON v.doc_id = c.doc_id GROUP BY c.doc_id""")
def section_rollup(t):
    parts = (_sections(t).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"), F.sum(F.col("end") - F.col("start")).alias("covered_characters"),
        F.max("end").alias("last"), F.array_sort(F.collect_list(F.struct("idx", F.col("body").alias("s")))).alias("s")))
    return parts.select("doc_id", "sections", "covered_characters", (F.col("last") == F.col("covered_characters")).alias("complete"),
                        F.array_join(F.transform("s", lambda x: x["s"]), "|").alias("summary"))


CHUNKS = r"""WITH RECURSIVE b AS (SELECT doc_id, text, regexp_split_to_array(text, '\n') AS ls FROM documents),
 l0 AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM b),
 l1 AS (SELECT doc_id, i, strlen(l) + CASE WHEN i < n THEN 1 ELSE 0 END AS sz FROM l0 WHERE i < n OR l <> ''),
 l2 AS (SELECT *, sum(sz) OVER (PARTITION BY doc_id ORDER BY i) AS cum, max(i) OVER (PARTITION BY doc_id) AS m FROM l1),
 ch AS (SELECT doc_id, 0::BIGINT AS idx, 0::BIGINT AS s, 0::BIGINT AS c0, (SELECT coalesce(min(i), max(m)) FROM l2 x WHERE x.doc_id = d.doc_id AND (cum >= 500 OR i = m))::BIGINT AS e FROM (SELECT DISTINCT doc_id FROM l2) d
  UNION ALL SELECT c.doc_id, idx + 1, e, (SELECT cum FROM l2 x WHERE x.doc_id = c.doc_id AND x.i = c.e)::BIGINT,
   (SELECT min(i) FROM l2 x WHERE x.doc_id = c.doc_id AND x.i > c.e AND (cum >= 500 + (SELECT cum FROM l2 y WHERE y.doc_id = c.doc_id AND y.i = c.e) OR i = m))::BIGINT
   FROM ch c WHERE e < (SELECT max(m) FROM l2 x WHERE x.doc_id = c.doc_id)),
 chunks AS (SELECT c.doc_id, idx, sum(sz)::BIGINT AS bytes, count(*) AS lines, min(i) AS first_line FROM ch c JOIN l2 x ON x.doc_id = c.doc_id AND x.i > c.s AND x.i <= c.e GROUP BY c.doc_id, idx)"""


@query("chunk_plan", CHUNKS + " SELECT doc_id, idx, bytes, lines FROM chunks")
def chunk_plan(t):
    return pk.chunks(t.documents, "doc_id", "text", 500).select("doc_id", "idx", "bytes", "lines")


RAW = rf"""WITH {PAIRS}, ln AS (SELECT doc_id, question, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM pairs),
 wi AS (SELECT doc_id, question, seq, unnest(generate_series(0, length(l) - 1, 512)) AS off, l FROM ln WHERE l <> ''),
 bo AS (SELECT doc_id, seq, off, substr(l, off + 1, 512) AS body, question FROM wi),
 windows AS (SELECT doc_id, seq, off, length(body) AS n_chars, len(list_intersect(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'), list_distinct(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+')))) AS score, body FROM bo)"""


@query("raw_windows", RAW + " SELECT doc_id, CAST(seq AS BIGINT) AS sequence, CAST(off AS BIGINT) AS start, CAST(n_chars AS BIGINT) AS n_chars, CAST(score AS BIGINT) AS score FROM windows")
def raw_windows(t):
    return ps.raw_windows(demo.pairs(t), ["doc_id"], "text", "question").select("doc_id", "sequence", "start", "n_chars", "score")


MEDIA = """'{"type":"image","source":{"type":"base64","media_type":"image/png","data":"' || sha1(html) || '"},"note":"data:image/ stays","url":"' || CASE WHEN page_id % 2 = 0 THEN 'data:image/png;base64,' || md5(html) ELSE 'https://x/' || page_id END || '"}'"""


@query("media_projection", f"""WITH a AS (SELECT page_id, sha1(html) AS d, CASE WHEN page_id % 2 = 0 THEN 'data:image/png;base64,' || md5(html) END AS u FROM pages)
 SELECT page_id, '{{"type":"image","source":{{"type":"base64","media_type":"image/png","data":"[binary media preserved in original record; sha256:' || sha256(d) || '; characters:40]"}},"note":"data:image/ stays","url":"' ||
 coalesce('[binary media preserved in original record; sha256:' || sha256(u) || '; characters:' || length(u) || ']', 'https://x/' || page_id) || '"}}' AS record FROM a""")
def media_projection(t):
    return t.pages.select("page_id", pk.media_projection(F.expr(MEDIA)).alias("record"))


PASSAGE = rf"""WITH {PAIRS}, {demo.passage_sql('pairs', 'doc_id')},
 best AS (SELECT p.doc_id, c AS passage, st AS start_char, en AS end_char, len(string_split(substr(d.text, 1, st), chr(10))) AS start_line,
   len(string_split(substr(d.text, 1, en), chr(10))) AS end_line, round(s, 6) AS score, sha256(d.text) AS revision, 'qmd://' || d.source || '/' || doc_id || '.md' AS uri FROM passage p JOIN documents d USING (doc_id) WHERE rn = 1)"""


@query("select_passage", PASSAGE + " SELECT doc_id, passage, start_char, end_char, start_line, end_line, score FROM best")
def select_passage(t):
    return ps.select_passage(demo.pairs(t), ["doc_id"], "text", "question", 260).select(
        "doc_id", "passage", "start_char", "end_char", "start_line", "end_line", "score")


@query("passage_identity", PASSAGE + """ SELECT doc_id, sha256('["' || uri || '", "' || revision || '", {"end_char": ' || end_char || ', "end_line": ' || end_line || ', "start_char": ' || start_char || ', "start_line": ' || start_line
 || '}, ' || to_json(passage)::VARCHAR || ']') AS passage_id FROM best""")
def passage_identity(t):
    best = ps.select_passage(demo.pairs(t), ["doc_id", "source"], "text", "question", 260)
    anchor = {c: F.col(c) for c in ("start_char", "end_char", "start_line", "end_line")}
    uri = F.concat(F.lit("qmd://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return best.select("doc_id", pk.passage_identity(uri, F.col("revision"), anchor, F.col("passage")).alias("passage_id"))
