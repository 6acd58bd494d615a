"""Text family: terms, ladders, snippets, frontmatter, secrets, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import fixed, text as tx
from memlake.queries import demo
from memlake.queries.demo import PAIRS, VAULT, clean_sql, lit, sql_list, terms_sql
from memlake.registry import query

CONV = "src AS (SELECT conv_id, turn, text AS txt FROM conversations)"


@query("content_terms", f"WITH {CONV}, {terms_sql('src', 'conv_id, turn', 10)} SELECT conv_id, turn, pos, term FROM terms")
def content_terms(t):
    return tx.unnest(tx.with_terms(t.conversations, "text"), ["conv_id", "turn"], F.col("terms"), "term", "pos")


LADDER = rf"""WITH {CONV}, {terms_sql('src', 'conv_id, turn', 10)},
 firsts AS (SELECT conv_id, turn, coalesce(regexp_extract_all(regexp_replace(txt, {lit(fixed.WRAPPER_TAG)}, ' ', 'g'), {lit(fixed.WORD)})[1], '') AS fw FROM src),
 ranked AS (SELECT t.*, count(*) OVER (PARTITION BY conv_id, turn) AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY
   (substr(term, 1, 1) <> lower(substr(term, 1, 1)) AND term <> fw)::INT DESC, regexp_matches(term, '\p{{Nd}}')::INT DESC, length(term) DESC, pos) AS rk
   FROM terms t JOIN firsts USING (conv_id, turn)),
 sizes AS (SELECT DISTINCT conv_id, turn, n AS k FROM ranked UNION SELECT DISTINCT conv_id, turn, s.k FROM ranked, (VALUES (5), (3), (2)) s(k) WHERE n > s.k),
 rungs AS (SELECT r.conv_id, r.turn, s.k, string_agg(term, ' ' ORDER BY pos) AS q FROM ranked r JOIN sizes s ON r.conv_id = s.conv_id AND r.turn = s.turn
   WHERE rk <= s.k GROUP BY r.conv_id, r.turn, s.k)"""


def _ladders(t):
    return (tx.with_terms(t.conversations, "text")
            .withColumn("ranked", tx.ranked_terms(F.col("terms"), tx.first_word(F.col("text"))))
            .select("conv_id", "turn", tx.ladder(F.col("terms"), F.col("ranked")).alias("rungs")))


@query("query_ladder", LADDER + " SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k DESC) AS rung, q AS query FROM rungs")
def query_ladder(t):
    return (tx.unnest(_ladders(t), ["conv_id", "turn"], F.col("rungs"), "r", "rung")
            .select("conv_id", "turn", "rung", F.array_join("r", " ").alias("query")))


@query("complementary_pairs", LADDER + """, triple AS (SELECT conv_id, turn, pos, term, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS j
   FROM ranked WHERE rk <= 3 AND n >= 3),
 pairs3 AS (SELECT a.conv_id, a.turn, o.j AS omitted, string_agg(a.term, ' ' ORDER BY a.j) AS pair FROM triple a JOIN triple o
   ON a.conv_id = o.conv_id AND a.turn = o.turn AND a.j <> o.j GROUP BY a.conv_id, a.turn, o.j)
 SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY omitted) AS pair_no, pair FROM pairs3 p
 WHERE NOT EXISTS (SELECT 1 FROM rungs r WHERE r.conv_id = p.conv_id AND r.turn = p.turn AND r.q = p.pair)""")
def complementary_pairs(t):
    return (tx.unnest(_ladders(t), ["conv_id", "turn"], tx.leave_one_out(F.col("rungs")), "r", "pair_no")
            .select("conv_id", "turn", "pair_no", F.array_join("r", " ").alias("pair")))


@query("semantic_intent", rf"""WITH a AS (SELECT doc_id, text, regexp_extract_all(text, {lit(fixed.IDENTIFIER_IN_INTENT)}) AS ids FROM documents),
 b AS (SELECT doc_id, unnest(ids) AS w, generate_subscripts(ids, 1) AS i FROM a),
 c AS (SELECT doc_id, w, min(i) AS i FROM b GROUP BY doc_id, w),
 d AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS names FROM c GROUP BY doc_id),
 e AS (SELECT a.doc_id, text, right(coalesce(names, ''), 300) AS middle FROM a LEFT JOIN d USING (doc_id)),
 f AS (SELECT *, greatest(0, (2000 - length(middle) - 48) // 2) AS head FROM e)
 SELECT doc_id, length(text) > 2000 AS sampled, CASE WHEN length(text) > 2000 THEN substr(substr(text, 1, head) || chr(10) ||
   '[omitted middle; identifiers: ' || middle || ']' || chr(10) || right(text, head), 1, 2000) ELSE text END AS intent FROM f""")
def semantic_intent(t):
    intent, sampled = tx.semantic_intent(F.col("text"))
    return t.documents.select("doc_id", intent.alias("intent"), sampled.alias("sampled"))


@query("keyword_query", rf"""WITH a AS (SELECT doc_id, regexp_extract_all(replace(lower(text), '-', ' '), '[\p{{L}}\p{{N}}_]{{3,}}') AS ws FROM documents),
 b AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
 c AS (SELECT doc_id, w, min(i) AS i FROM b WHERE w NOT IN {sql_list(fixed.KEYWORD_STOPWORDS)} GROUP BY doc_id, w),
 d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM c),
 e AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS q FROM d WHERE rn <= 4 GROUP BY doc_id)
 SELECT doc_id, coalesce(q, '') AS query FROM documents LEFT JOIN e USING (doc_id)""")
def keyword_query(t):
    return t.documents.select("doc_id", tx.keyword_query(F.col("text")).alias("query"))


FTS_TEXT = "CASE WHEN doc_id % 50 = 0 THEN '知识base库 ' || text ELSE text END"


@query("literal_fts_terms", rf"""WITH a AS (SELECT doc_id, regexp_extract_all({FTS_TEXT}, '[\p{{L}}\p{{N}}_]+')[1:32] AS ts FROM documents)
 SELECT doc_id, array_to_string(list_transform(ts, lambda t: CASE WHEN t = '知识base库' THEN '"知 识 base 库"' ELSE '"' || t || '"*' END), ' AND ') AS fts FROM a""")
def literal_fts_terms(t):
    return t.documents.select("doc_id", tx.fts_terms(F.expr(FTS_TEXT)).alias("fts"))


GATE = rf"""WITH p AS (SELECT {demo.PROMPT_COLS} FROM conversations),
 src AS (SELECT conv_id, turn, trim(regexp_replace(prompt, {lit(fixed.WRAPPER_TAG)}, ' ', 'g')) AS txt, prompt FROM p),
 {terms_sql('src', 'conv_id, turn', 10)},
 agg AS (SELECT conv_id, turn, count(*) AS n, bool_and(lw IN {sql_list(fixed.GENERIC_ACTIONS)}) AS generic FROM terms GROUP BY conv_id, turn),
 j AS (SELECT src.*, coalesce(n, 0) AS n, coalesce(generic, false) AS generic,
   len(list_filter(regexp_extract_all(txt, {lit(fixed.WORD)}), lambda w: lower(w) NOT IN {sql_list(fixed.STOPWORDS)} AND NOT regexp_matches(w, {lit(fixed.DATEISH)}))) AS m
   FROM src LEFT JOIN agg USING (conv_id, turn))
 SELECT conv_id, turn, CASE WHEN regexp_matches(prompt, {lit(fixed.AUTOMATED_EVENT)}) THEN 'automated event'
  WHEN txt = '' OR regexp_matches(txt, {lit(fixed.SLASH_COMMAND)}) THEN 'prompt too short or a slash command'
  WHEN regexp_matches(txt, {lit(fixed.UNRESOLVED_FOLLOWUP)}) OR regexp_matches(txt, {lit(fixed.ACKNOWLEDGEMENT)}) OR (n > 0 AND generic)
  THEN 'follow-up has no retrieval subject' WHEN n = 0 AND m = 0 THEN 'no lexical or semantic intent' END AS reason FROM j"""


@query("prompt_gate", GATE)
def prompt_gate(t):
    p = tx.with_terms(demo.project(t.conversations, demo.PROMPT_COLS), "prompt")
    return p.select("conv_id", "turn", tx.gate_reason(F.col("prompt"), F.col("terms")).alias("reason"))


@query("clean_snippet", f"WITH {VAULT} SELECT doc_id, {clean_sql('note', 260)} AS snippet FROM vault")
def clean_snippet(t):
    return demo.vault(t).select("doc_id", tx.clean(F.col("note"), 260).alias("snippet"))


@query("body_excerpt", rf"""WITH {VAULT}, a AS (SELECT doc_id, regexp_replace(regexp_replace(note, '(?s)\A---\n.*?\n---\n', ''), '(?s)<!--.*?-->', ' ', 'g') AS body FROM vault),
 b AS (SELECT doc_id, array_to_string(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '\S') AND NOT regexp_matches(l, '^\s*#')), chr(10)) AS prose FROM a)
 SELECT doc_id, {clean_sql('prose', 260)} AS excerpt FROM b""")
def body_excerpt(t):
    return demo.vault(t).select("doc_id", tx.body_excerpt(F.col("note"), 260).alias("excerpt"))


MARKS = rf"""WITH {VAULT},
 m0 AS (SELECT doc_id, regexp_extract_all(note, '<!--\s*memlake:[^:]+?:(?:start|end)\s*-->') AS ms,
   regexp_split_to_array(note, '<!--\s*memlake:[^:]+?:(?:start|end)\s*-->') AS parts FROM vault),
 m1 AS (SELECT doc_id, parts, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM m0),
 m2 AS (SELECT doc_id, i, parts[i + 1] AS body, regexp_extract(m, 'memlake:([^:]+?):(start|end)', 1) AS id, regexp_extract(m, 'memlake:([^:]+?):(start|end)', 2) AS kind FROM m1),
 m3 AS (SELECT *, lead(id) OVER w AS nid, lead(kind) OVER w AS nkind, lag(id) OVER w AS pid, count(*) OVER (PARTITION BY doc_id, id ORDER BY i) AS seen FROM m2
   WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 blocks AS (SELECT doc_id, i, id, body FROM m3 WHERE kind = 'start' AND nkind = 'end' AND nid = id)"""


def _marks(t):
    return demo.vault(t).select("doc_id", tx.block_markers(F.col("note"), "memlake").alias("marks"))


@query("freshest_block", MARKS + rf""", d0 AS (SELECT doc_id, i, body, CASE WHEN len(regexp_extract_all(id, '{fixed.ISO_DATE}')) > 0
   THEN list_max(regexp_extract_all(id, '{fixed.ISO_DATE}')) ELSE list_max(regexp_extract_all(substr(body, 1, 240), '{fixed.ISO_DATE}')) END AS d FROM blocks),
 d1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, i DESC) AS rn, count(*) OVER (PARTITION BY doc_id) AS n, min(d) OVER (PARTITION BY doc_id) AS d_min
   FROM d0 WHERE d IS NOT NULL),
 d2 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(body, chr(10) || ' '), '(?s)<!--.*?-->', ' ', 'g'), '\A\s*#+\s*[^\n]*\n', ''),
   '\A\s*\*\*(Session|Source|Context)\*\*:[^\n]*\n', '') AS b FROM d1 WHERE rn = 1 AND n >= 2)
 SELECT doc_id, '[newest of ' || n || ' updates, ' || d || '; history from ' || d_min || ' in the file]' AS label, {clean_sql('b', 260)} AS body FROM d2""")
def freshest_block(t):
    label, body = tx.freshest_block(F.col("marks"), 260)
    return _marks(t).select("doc_id", label.alias("label"), body.alias("body")).where("label IS NOT NULL")


@query("managed_blocks", MARKS + rf""", bad AS (SELECT doc_id, i, CASE WHEN NOT regexp_matches(id, '{fixed.BLOCK_ID}') THEN 'invalid id'
   WHEN kind = 'start' AND (i % 2 = 0 OR seen > 1) THEN 'nested or duplicate' WHEN kind = 'end' AND (i % 2 = 1 OR pid <> id) THEN 'mismatched' END AS p FROM m3),
 first AS (SELECT doc_id, arg_min(p, i) AS p FROM bad WHERE p IS NOT NULL GROUP BY doc_id),
 cnt AS (SELECT doc_id, count(*) AS n FROM m3 GROUP BY doc_id), nb AS (SELECT doc_id, count(*) AS nb FROM blocks GROUP BY doc_id)
 SELECT v.doc_id, coalesce(nb, 0) AS closed_blocks, coalesce(p, CASE WHEN n % 2 = 1 THEN 'unclosed' END, 'ok') AS verdict
 FROM vault v LEFT JOIN first USING (doc_id) LEFT JOIN cnt USING (doc_id) LEFT JOIN nb USING (doc_id)""")
def managed_blocks(t):
    return _marks(t).select("doc_id", F.size(tx.closed_blocks(F.col("marks"))).cast("bigint").alias("closed_blocks"),
                            tx.layout_verdict(F.col("marks")).alias("verdict"))


@query("section_content", rf"""WITH {VAULT}, l0 AS (SELECT doc_id, string_split(note, chr(10)) AS ls FROM vault),
 l1 AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM l0),
 s AS (SELECT doc_id, min(i) AS s FROM l1 WHERE trim(l) = '## Summary' GROUP BY doc_id),
 e AS (SELECT doc_id, min(i) AS e FROM l1 JOIN s USING (doc_id) WHERE i > s AND starts_with(l, '#') AND length(regexp_extract(l, '^(#+)', 1)) <= 2 GROUP BY doc_id)
 SELECT doc_id, regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY i), ''), '\A\s+|\s+\z', '', 'g') AS section FROM l1 JOIN s USING (doc_id) LEFT JOIN e USING (doc_id)
 WHERE i > s AND (e IS NULL OR i < e) GROUP BY doc_id""")
def section_content(t):
    return demo.vault(t).select("doc_id", tx.section_content(F.col("note"), "## Summary").alias("section"))


FRONT = rf"""WITH {VAULT}, f0 AS (SELECT doc_id, string_split(regexp_extract(note, '(?s)\A---\s*\n(.*?)\n---\s*\n', 1), chr(10)) AS ls FROM vault
   WHERE regexp_matches(note, '(?s)\A---\s*\n(.*?)\n---\s*\n')),
 f1 AS (SELECT doc_id, rtrim(unnest(ls)) AS l, generate_subscripts(ls, 1) AS i FROM f0),
 f2 AS (SELECT *, CASE WHEN NOT starts_with(l, '  - ') AND contains(l, ':') THEN 1 ELSE 0 END AS is_key FROM f1),
 f3 AS (SELECT *, sum(is_key) OVER (PARTITION BY doc_id ORDER BY i) AS kn FROM f2),
 f4 AS (SELECT doc_id, kn, max(CASE WHEN is_key = 1 THEN trim(split_part(l, ':', 1)) END) AS key,
   max(CASE WHEN is_key = 1 THEN trim(trim(substr(l, instr(l, ':') + 1)), '"''') END) AS value,
   list(trim(trim(substr(l, 5)), '"''') ORDER BY i) FILTER (WHERE starts_with(l, '  - ')) AS items FROM f3 WHERE kn > 0 GROUP BY doc_id, kn),
 front AS (SELECT doc_id, kn, key, items IS NOT NULL OR (starts_with(value, '[') AND ends_with(value, ']')) AS is_list,
   CASE WHEN items IS NOT NULL THEN items WHEN starts_with(value, '[') AND ends_with(value, ']') THEN
   list_transform(list_filter(string_split(substr(value, 2, length(value) - 2), ','), lambda v: trim(v) <> ''), lambda v: trim(trim(v), '"'''))
   WHEN value <> '' THEN [value] END AS vals FROM f4),
 fr AS (SELECT * FROM front WHERE vals IS NOT NULL),
 fv AS (SELECT doc_id, key, arg_max(vals, kn) AS vals, arg_max(is_list, kn) AS is_list FROM fr GROUP BY doc_id, key)"""


def _fronts(t):
    return demo.vault(t).withColumn("entries", tx.front_entries(tx.note_front(F.col("note"))))


@query("parse_frontmatter", FRONT + " SELECT doc_id, key, is_list, array_to_string(vals, '|') AS vals FROM fv")
def parse_frontmatter(t):
    later = lambda e, i: F.exists(F.slice(F.col("entries"), i + 2, F.size("entries")), lambda o: o["key"] == e["key"])
    last = F.filter(F.col("entries"), lambda e, i: ~later(e, i))
    return (tx.unnest(_fronts(t), ["doc_id"], last, "e")
            .select("doc_id", "e.key", "e.is_list", F.array_join("e.values", "|").alias("vals")))


INDEX = FRONT + rf""", ix AS (SELECT v.doc_id, path, stem, note, regexp_replace(note, '(?s)\A---\s*\n(.*?)\n---\s*\n', '') AS body,
   coalesce(tg.vals, []) AS ft, coalesce(al.vals, []) AS aliases FROM vault v
   LEFT JOIN (SELECT * FROM fv WHERE key = 'tags') tg USING (doc_id) LEFT JOIN (SELECT * FROM fv WHERE key = 'aliases') al USING (doc_id)),
 tags0 AS (SELECT doc_id, unnest(ts) AS tag, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, list_concat(ft, regexp_extract_all(body, '(?:^|\s)#([\p{{L}}\p{{N}}_/-]+)', 1)) AS ts FROM ix)),
 note_tags AS (SELECT doc_id, tag, min(i) AS i FROM tags0 GROUP BY doc_id, tag),
 links0 AS (SELECT doc_id, trim(unnest(ls)) AS link, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_extract_all(note, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1) AS ls FROM ix)),
 note_links AS (SELECT doc_id, link, min(i) AS i FROM links0 WHERE link <> '' GROUP BY doc_id, link),
 pv AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda l: trim(l)),
   lambda l: l <> '' AND NOT starts_with(l, '#') AND NOT (starts_with(l, '**') AND ends_with(l, '**'))), ' ') AS j FROM ix),
 note_index AS (SELECT ix.doc_id, path, stem, CASE WHEN regexp_extract(body, '(?m)^#\s+(.+)$', 1) <> '' THEN trim(regexp_extract(body, '(?m)^#\s+(.+)$', 1)) ELSE stem END AS title,
   coalesce((SELECT string_agg(tag, '|' ORDER BY i) FROM note_tags n WHERE n.doc_id = ix.doc_id), '') AS tags, array_to_string(aliases, '|') AS aliases,
   coalesce((SELECT string_agg(link, '|' ORDER BY i) FROM note_links n WHERE n.doc_id = ix.doc_id), '') AS links,
   CASE WHEN length(j) > 200 THEN substr(j, 1, 200) || '...' ELSE j END AS preview FROM ix JOIN pv USING (doc_id))"""


def note_index_frame(t):
    """One index row per note, lists kept as arrays."""
    e, body = F.col("entries"), F.col("body")
    return (_fronts(t).withColumn("body", tx.note_body(F.col("note")))
            .select("doc_id", "path", "stem", "lang", "source", tx.note_title(body, F.col("stem")).alias("title"),
                    F.array_distinct(F.concat(F.coalesce(tx.front_values(e, "tags"), F.array().cast("array<string>")),
                                              tx.inline_tags(body))).alias("tags"),
                    tx.front_values(e, "aliases").alias("aliases"), tx.wiki_links(F.col("note")).alias("links"),
                    tx.preview(body).alias("preview")))


@query("note_index", INDEX + " SELECT * FROM note_index")
def note_index(t):
    return note_index_frame(t).select("doc_id", "path", "stem", "title", *[F.array_join(c, "|").alias(c) for c in ("tags", "aliases", "links")], "preview")


@query("note_type_infer", FRONT + f""", ty AS (SELECT v.doc_id, lower(trim(coalesce(a.vals[1], ''))) AS g,
   list_filter(list_transform(coalesce(b.vals, []), lambda x: lower(trim(x))), lambda x: x IN {sql_list(fixed.NOTE_TYPES)}) AS ts FROM vault v
   LEFT JOIN (SELECT * FROM fv WHERE key = 'type') a USING (doc_id) LEFT JOIN (SELECT * FROM fv WHERE key = 'tags') b USING (doc_id))
 SELECT doc_id, CASE WHEN g IN {sql_list(fixed.NOTE_TYPES)} THEN g WHEN len(ts) > 0 THEN ts[1] ELSE 'reference' END AS note_type FROM ty""")
def note_type_infer(t):
    e = F.col("entries")
    return _fronts(t).select("doc_id", tx.infer_note_type(F.get(tx.front_values(e, "type"), F.lit(0)), tx.front_values(e, "tags")).alias("note_type"))


_HEX = "md5(CAST(doc_id AS VARCHAR(20)))"
SECRET_TEXT = f"""text || ' ' || CASE doc_id % 17 WHEN 0 THEN '-----BEGIN RSA PRIVATE KEY-----' || {_HEX} || '-----END RSA PRIVATE KEY-----'
 WHEN 1 THEN 'AKIA' || upper(substr({_HEX}, 1, 16)) WHEN 2 THEN 'sk-ant-' || {_HEX} WHEN 3 THEN 'sk-proj-' || {_HEX} WHEN 4 THEN 'sk_live_' || {_HEX}
 WHEN 5 THEN 'ghp_' || {_HEX} WHEN 6 THEN 'xoxb-' || {_HEX} WHEN 7 THEN 'https://hooks.slack.com/services/' || {_HEX}
 WHEN 8 THEN 'AIza' || {_HEX} || 'abc' WHEN 9 THEN 'sb_secret_' || {_HEX} WHEN 10 THEN '12345678:AA' || {_HEX} || 'x'
 WHEN 11 THEN 'eyJ' || {_HEX} || '.eyJ' || {_HEX} || '.' || {_HEX} WHEN 12 THEN 'postgres://user:' || {_HEX} || '@db.example.com/x and postgres://user@host'
 WHEN 13 THEN 'Bearer ' || {_HEX} WHEN 14 THEN 'API_KEY = "' || {_HEX} || '", password: <your-password> token=' || {_HEX}
 WHEN 15 THEN 'my_secret: $HOME/secret token = os.environ access-key: "settings.KEY_NAME"' ELSE 'nothing hidden' END"""


def _redact_sql() -> str:
    steps, prev = [f"r0 AS (SELECT doc_id, {SECRET_TEXT} AS t0 FROM documents)"], "t0"
    for i, (kind, p) in enumerate(fixed.SECRETS, 1):
        by = rf"\1://[REDACTED: {kind}]@\2" if kind == "connection string" else f"[REDACTED: {kind}]"
        steps.append(f"r{i} AS (SELECT *, len(regexp_extract_all({prev}, {lit(p)})) AS n{i}, regexp_replace({prev}, {lit(p)}, {lit(by)}, 'g') AS t{i} FROM r{i - 1})")
        prev = f"t{i}"
    n = len(fixed.SECRETS)
    look = rf"(?i)\b({fixed.SECRET_NAME}\s*)"
    # Protect look-alikes: their separator becomes chr(1) or chr(2) and is put back at the end.
    protect = prev
    for sep, mark in ((":", "chr(1)"), ("=", "chr(2)")):
        protect = f"regexp_replace({protect}, {lit(look + sep + r'(\s*' + fixed.SECRET_LOOKALIKE + ')')}, '\\1' || {mark} || '\\2', 'g')"
    real = rf"(?i)\b({fixed.SECRET_NAME})(\s*[:=]\s*[\"']?)({fixed.SECRET_VALUE})"
    steps.append(f"rp AS (SELECT *, {protect} AS tp FROM r{n})")
    steps.append(f"""rz AS (SELECT *, len(regexp_extract_all(tp, {lit(real)})) AS ns,
      replace(replace(regexp_replace(tp, {lit(real)}, '\\1\\2[REDACTED: secret]', 'g'), chr(1), ':'), chr(2), '=') AS redacted FROM rp)""")
    kinds = [(k, f"n{i}") for i, (k, _) in enumerate(fixed.SECRETS, 1)] + [("secret", "ns")]
    label = " || ".join(f"CASE WHEN {c} > 0 THEN '{k}=' || {c} || ';' ELSE '' END" for k, c in sorted(kinds))
    total = " + ".join(c for _, c in kinds)
    return f"WITH {', '.join(steps)} SELECT doc_id, redacted, CAST({total} AS BIGINT) AS total, {label} AS kinds FROM rz"


@query("redact_secrets", _redact_sql())
def redact_secrets(t):
    out = tx.redact(t.documents.select("doc_id", F.expr(SECRET_TEXT).alias("t")), "t")
    parts = F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"), F.lit(";")))
    total = F.aggregate(F.map_values("kinds"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("doc_id", "redacted", total.alias("total"), F.array_join(parts, "").alias("kinds"))


def _controls_sql(name: str, word: str) -> str:
    return rf"""list_transform(list_filter(ls, lambda l: regexp_matches(l, '(?i)^\s*(?:{name}|"{name}"|''{name}'')\s*:')),
   lambda l: regexp_matches(regexp_extract(l, '(?i)^\s*(?:{name}|"{name}"|''{name}'')\s*:(.*)$', 1), '(?i)^\s*(?:{word}|"{word}"|''{word}'')(?:[ \t]+#.*)?[ \t]*$'))"""


@query("privacy_controls", rf"""WITH {VAULT}, c0 AS (SELECT doc_id, note, regexp_matches(note, '\A---[ \t]*\n') AS opens, regexp_matches(note, '(?sm)\A---[ \t]*\n(.*?)^---[ \t]*(?:\n|\z)') AS has,
   string_split(regexp_extract(note, '(?sm)\A---[ \t]*\n(.*?)^---[ \t]*(?:\n|\z)', 1), chr(10)) AS ls FROM vault),
 c1 AS (SELECT *, {_controls_sql('share', 'true')} AS sh, {_controls_sql('private', 'false')} AS pr,
   list_filter(ls, lambda l: regexp_matches(l, '\S') AND NOT regexp_matches(l, '^\s*#') AND NOT regexp_matches(l, '^[ \t]')) AS top FROM c0),
 c2 AS (SELECT *, list_transform(top, lambda l: lower(trim(split_part(l, ':', 1)))) AS keys, len(list_filter(top, lambda l: NOT regexp_matches(l, '^[A-Za-z_][\w-]*\s*:'))) AS odd FROM c1)
 SELECT doc_id, CASE WHEN has THEN len(sh) = 0 OR (len(sh) = 1 AND sh[1]) ELSE NOT opens END AS share_allowed,
  CASE WHEN NOT opens THEN true WHEN NOT has THEN false ELSE odd = 0 AND len(list_distinct(keys)) = len(keys) AND (len(pr) = 0 OR (len(pr) = 1 AND pr[1])) END AS external_allowed FROM c2""")
def privacy_controls(t):
    n = F.col("note")
    return demo.vault(t).select("doc_id", tx.share_allowed(n).alias("share_allowed"), tx.external_allowed(n).alias("external_allowed"))


@query("is_stub", rf"""WITH {VAULT}, b0 AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 10 = 0 THEN note || 'TBD' ELSE note END, '(?sm)\A---[ \t]*\n(.*?)^---[ \t]*(?:\n|\z)', '') AS body FROM vault),
 b1 AS (SELECT *, array_to_string(list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '\S') AND NOT regexp_matches(l, '^\s*#')), chr(10)) AS prose FROM b0)
 SELECT doc_id, length(regexp_replace(body, '\A\s+|\s+\z', '', 'g')) < 200 OR trim(prose) = '' OR (regexp_matches(body, {lit(fixed.STUB_WORDS)}) AND length(prose) < 600) AS is_stub FROM b1""")
def is_stub(t):
    note = F.when(F.col("doc_id") % 10 == 0, F.concat("note", F.lit("TBD"))).otherwise(F.col("note"))
    return demo.vault(t).select("doc_id", tx.is_stub(note).alias("is_stub"))


def once(ctes: str) -> str:
    """Each of these CTEs computed once, however often it is named."""
    return ctes.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query("title_overlap", f"""WITH k AS MATERIALIZED (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents), q AS MATERIALIZED (SELECT item_id, text AS txt FROM benchmark),
 d AS MATERIALIZED (SELECT doc_id, text AS txt FROM documents), {once(terms_sql('q', 'item_id', 30, 'qt'))}, {once(terms_sql('d', 'doc_id', 30, 'dt'))},
 n AS MATERIALIZED (SELECT item_id, count(*) AS n FROM qt GROUP BY item_id), m AS MATERIALIZED (SELECT doc_id, count(*) AS m FROM dt JOIN k USING (doc_id) JOIN qt USING (item_id, lw) GROUP BY doc_id)
 SELECT k.doc_id, q.item_id, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE round(coalesce(m, 0) / n, 6) END AS overlap FROM k JOIN q USING (item_id) LEFT JOIN n USING (item_id) LEFT JOIN m USING (doc_id)""")
def title_overlap(t):
    p = (demo.pairs(t).withColumn("q", tx.term_set(F.col("question"), 30))
         .withColumn("d", tx.term_set(F.col("text"), 30)))
    share = F.size(F.array_intersect("q", "d")) / F.size("q")
    return p.select("doc_id", "item_id", F.when(F.size("q") > 0, F.round(share, 6)).otherwise(F.lit(0.0)).alias("overlap"))


@query("stable_split", """SELECT doc_id, CASE WHEN right(sha1('qmd://' || source || '/' || doc_id || '.md'), 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f')
 THEN 'test' ELSE 'dev' END AS split FROM documents""")
def stable_split(t):
    return demo.notes(t).select("doc_id", tx.split_of(F.col("uri")).alias("split"))


REF = r"""CASE page_id % 5 WHEN 0 THEN ' qmd://' || replace(url, 'http://', 'h%20') WHEN 1 THEN regexp_replace(url, '^https?://[^/]+', '') || '/./x//y/../z'
 WHEN 2 THEN './' || url WHEN 3 THEN regexp_replace(url, '^https?://', '') ELSE 'plain-stem' END"""


@query("normalize_ref", rf"""WITH a AS (SELECT page_id, trim({REF}) AS v FROM pages), b AS (SELECT *, substr(v, 7) AS r FROM a),
 c AS (SELECT *, regexp_extract(r, '^([^/?#]*)', 1) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS p FROM b)
 SELECT page_id, CASE WHEN starts_with(v, 'qmd://') THEN 'qmd://' || host || '/' || ltrim(url_decode(p), '/')
 WHEN starts_with(v, '/') THEN 'file://' || regexp_replace(regexp_replace(regexp_replace(v, '/\./', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\.\.', '', 'g')
 WHEN contains(v, '/') AND NOT starts_with(v, './') AND NOT starts_with(v, '../') THEN 'qmd://' || v ELSE '' END AS ref FROM c""")
def normalize_ref(t):
    return t.pages.select("page_id", tx.normalize_ref(F.expr(REF.replace("\\", "\\\\"))).alias("ref"))


PRODUCERS = {"src0": "desk", "src1": "phone", "src2": "web"}
PRODUCER_MARKS = [("/.desk/", "desk"), ("/imports/", ""), ("/.term/", "term")]
PATH = """CASE doc_id % 6 WHEN 0 THEN '/home/u/.desk/s/' || doc_id WHEN 1 THEN '/home/u/imports/src1/' || doc_id WHEN 2 THEN '/home/u/.term/p/' || doc_id
 WHEN 3 THEN '' WHEN 4 THEN '/home/u/imports/other/.term/' || doc_id ELSE '/tmp/x' END"""


@query("assistant_for", f"""WITH a AS (SELECT doc_id, source, {PATH} AS p FROM documents)
 SELECT doc_id, CASE source WHEN 'src0' THEN 'desk' WHEN 'src1' THEN 'phone' WHEN 'src2' THEN 'web' ELSE
 CASE WHEN contains(p, '/.desk/') THEN 'desk' WHEN contains(p, '/imports/src1/') THEN 'phone' WHEN contains(p, '/.term/') THEN 'term' WHEN p = '' THEN 'term' ELSE '' END END AS producer FROM a""")
def assistant_for(t):
    return t.documents.select("doc_id", tx.producer(F.expr(PATH), F.col("source"), PRODUCERS, PRODUCER_MARKS, "/imports/", "term").alias("producer"))


@query("event_summary", f"""WITH {demo.HOOKS}, a AS (SELECT event_id, event, data, data->>'$.tool_name' AS tn, data->>'$.prompt' AS pr,
  data->>'$.tool_input.command' AS cm, regexp_extract(data->>'$.tool_input.file_path', '([^/]*)$', 1) AS base, data->>'$.tool_input.pattern' AS pat,
  data->>'$.tool_input.description' AS de FROM hooks),
 b AS (SELECT *, CASE WHEN tn IN ('Read', 'Write', 'Edit') THEN '**' || tn || '** `' || base || '`' WHEN tn = 'Bash' THEN '**Bash** `' || CASE WHEN length(cm) > 60 THEN substr(cm, 1, 57) || '...' ELSE cm END || '`'
  WHEN tn IN ('Grep', 'Glob') THEN '**' || tn || '** `' || pat || '`' WHEN tn = 'Task' THEN '**Task** ' || de ELSE '**' || tn || '**' END AS used FROM a)
 SELECT event_id, CASE event WHEN 'UserPromptSubmit' THEN 'User prompt: "' || CASE WHEN length(pr) > 80 THEN substr(pr, 1, 77) || '...' ELSE pr END || '"'
  WHEN 'PostToolUse' THEN used WHEN 'PostToolUseFailure' THEN used || ' (failed)' WHEN 'Stop' THEN 'Session stopped' WHEN 'SessionStart' THEN 'Session started' END AS description FROM b""")
def event_summary(t):
    return demo.hooks(t).select("event_id", tx.event_summary(F.col("event"), F.col("data")).alias("description"))


@query("recursion_filter", f"WITH {demo.HOOKS} SELECT event_id, session_id, event FROM hooks WHERE NOT contains(cwd, '.memlake') AND NOT contains(data, 'm13/')")
def recursion_filter(t):
    own = tx.self_generated(F.col("cwd"), F.col("data"), [".memlake", "m13/"])
    return demo.hooks(t).where(~own).select("event_id", "session_id", "event")


ASK = """CASE turn % 3 WHEN 0 THEN text || '?' WHEN 1 THEN 'TODO ' || text ELSE text END"""
ASKED = rf"""asked AS (SELECT conv_id, turn, CASE WHEN length(p) > 200 THEN substr(p, 1, 197) || '...' ELSE p END AS question
 FROM (SELECT conv_id, turn, regexp_replace({ASK}, '\A\s+|\s+\z', '', 'g') AS p FROM conversations WHERE role = 'user')
 WHERE regexp_matches(lower(p), '\?|unclear|todo|investigate|open question|need to understand|not sure|figure out'))"""


def _asked(t):
    return (t.conversations.where("role = 'user'").select("conv_id", "turn", tx.question_of(F.expr(ASK)).alias("question"))
            .where("question IS NOT NULL"))


@query("extract_questions", f"WITH {ASKED} SELECT * FROM asked WHERE length(question) >= 15 AND NOT ends_with(question, '...')")
def extract_questions(t):
    return _asked(t).where((F.length("question") >= 15) & ~F.col("question").endswith("..."))


@query("dedupe_questions", f"WITH {ASKED} SELECT question, min(conv_id) AS conv_id FROM asked WHERE question NOT IN (SELECT question FROM asked WHERE turn >= 4) GROUP BY question")
def dedupe_questions(t):
    asked = _asked(t)
    listed = asked.where("turn >= 4").select("question")
    return asked.join(listed, "question", "left_anti").groupBy("question").agg(F.min("conv_id").alias("conv_id"))
