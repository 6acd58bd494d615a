"""Demo tables: how the given parquet tables play notes, prompts, events, packs and claims.

Each expression is plain SQL that Spark and DuckDB read alike, so both sides start from the same
rows. They only shape inputs; the operators under test are written separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NL = "chr(10)"
HALF = "CAST(floor(doc_id / 2) AS BIGINT)"

# -- vault: documents as Markdown notes with frontmatter, links, tags and managed blocks -----

_TYPE = f"""CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'type: decision' || {NL} WHEN 2 THEN 'type: "gotcha"' || {NL}
 WHEN 3 THEN 'type: Project' || {NL} WHEN 4 THEN 'type: memo' || {NL} ELSE 'type: reference' || {NL} END"""
_TAGS = f"""CASE doc_id % 4 WHEN 0 THEN 'tags: [' || lang || ', ' || source || ']' || {NL}
 WHEN 1 THEN 'tags:' || {NL} || '  - ' || lang || {NL} || '  - "decision"' || {NL}
 WHEN 2 THEN 'tags: ' || lang || {NL} ELSE '' END"""
_ALIASES = f"""CASE WHEN doc_id % 5 = 0 THEN 'aliases: [' || source || '-' || doc_id || ', "alt ' || lang || '"]' || {NL} ELSE '' END"""
_WRITER = f"""CASE WHEN doc_id % 3 = 0 THEN 'assistant: helper' || {NL} ELSE '' END"""
_SHARE = f"""CASE doc_id % 7 WHEN 0 THEN 'share: true' || {NL} WHEN 1 THEN 'share: false' || {NL}
 WHEN 2 THEN 'share: "true" # checked' || {NL} WHEN 3 THEN 'share: true' || {NL} || 'share: true' || {NL} ELSE '' END"""
_PRIVATE = f"""CASE doc_id % 11 WHEN 0 THEN 'private: false' || {NL} WHEN 1 THEN 'private: true' || {NL}
 WHEN 2 THEN 'private: false' || {NL} || 'private: false' || {NL} WHEN 3 THEN 'private: perhaps' || {NL} ELSE '' END"""
_ORIGIN = f"""CASE doc_id % 8 WHEN 0 THEN 'derivation_sources: ["n' || {HALF} || '", "log/' || source || '"]' || {NL}
 WHEN 1 THEN 'derivation_sources:' || {NL} || '  - "n' || {HALF} || '"' || {NL} WHEN 2 THEN 'derivation_sources: n0' || {NL} ELSE '' END"""
_FRONT = f"""CASE WHEN doc_id % 13 = 0 THEN '' ELSE '---' || {NL} || {_TYPE} || {_TAGS} || {_ALIASES} || {_WRITER} || {_SHARE}
 || {_PRIVATE} || {_ORIGIN} || CASE WHEN doc_id % 17 = 0 THEN '' ELSE '---' || {NL} END END"""
_BLOCK_A = f"""'<!-- memlake:synth-2024-01-' || CAST(10 + doc_id % 9 AS VARCHAR(9)) || ':start -->' || {NL} || '### Update' || {NL} ||
 'First ' || substr(text, 1, 60) || {NL} || CASE WHEN doc_id % 29 = 0 THEN '<!-- memlake:other:end -->' WHEN doc_id % 19 = 0 THEN '' ELSE
 '<!-- memlake:synth-2024-01-' || CAST(10 + doc_id % 9 AS VARCHAR(9)) || ':end -->' END || {NL}"""
_BLOCK_B = f"""CASE WHEN doc_id % 2 = 0 THEN '<!-- memlake:' || CASE WHEN doc_id % 23 = 0 THEN 'bad id!' ELSE 'extra' END || ':start -->' || {NL} ||
 '**Source**: 2024-01-' || CAST(11 + doc_id % 11 AS VARCHAR(9)) || {NL} || 'Second ' || substr(text, 20, 50) || {NL} ||
 '<!-- memlake:' || CASE WHEN doc_id % 23 = 0 THEN 'bad id!' ELSE 'extra' END || ':end -->' || {NL} ELSE '' END"""
_PROVENANCE = f"""CASE WHEN doc_id % 9 = 0 THEN '<!-- memlake:provenance {{"derivation_sources": ["n' || {HALF} || '", "s' || (doc_id % 3) || '"]}} -->' || {NL}
 WHEN doc_id % 9 = 1 THEN '<!-- memlake:provenance {{broken}} -->' || {NL} ELSE '' END"""
_CLAIMS = f"""CASE WHEN doc_id % 4 < 2 THEN '<!-- memlake:claim {{"claim_id": "c' || doc_id || '", "text": "claim about ' || lang || '", "status": "' ||
 CASE doc_id % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'approved' WHEN 2 THEN 'guess' ELSE 'proposed' END ||
 '", "valid_from": "' || CASE WHEN doc_id % 7 = 0 THEN 'soon' ELSE '2024-01-01' END || '", "derivation_sources": ["n' || {HALF} || '"]}} -->' || {NL} ELSE '' END"""
VAULT_TEXT = f"""{_FRONT} || '# ' || replace(substr(text, 1, 40), {NL}, ' ') || {NL} || {NL} || '## Summary' || {NL} || text || {NL} || {NL}
 || '### Detail' || {NL} || 'see [[n' || {HALF} || '|older]] and [[n' || (doc_id * 7 + 3) % 1000 || ']] #' || lang || ' #topic/' || source || {NL}
 || '## Log' || {NL} || {_BLOCK_A} || {_BLOCK_B} || {_PROVENANCE} || {_CLAIMS}"""
VAULT_COLS = f"doc_id, lang, source, 'n' || doc_id AS stem, source || '/n' || doc_id || '.md' AS path, {VAULT_TEXT} AS note"
VAULT = f"vault AS (SELECT {VAULT_COLS} FROM documents)"


def vault(t) -> DataFrame:
    return t.documents.selectExpr(*_columns(VAULT_COLS))


def _columns(cols: str) -> list[str]:
    """Split a SQL select list at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(cols):
        if ch == "'":
            quoted = not quoted
        elif not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                out.append(cols[start:i])
                start = i + 1
    return [c.strip() for c in [*out, cols[start:]]]


def project(df: DataFrame, cols: str) -> DataFrame:
    return df.selectExpr(*_columns(cols))


# -- notes -----------------------------------------------------------------------------------

NOTES_COLS = "doc_id, source AS collection, 'qmd://' || source || '/' || doc_id || '.md' AS uri, text, lang"
NOTES = f"notes AS (SELECT {NOTES_COLS}, sha256(text) AS revision FROM documents)"


def notes(t) -> DataFrame:
    return project(t.documents, NOTES_COLS).withColumn("revision", F.sha2("text", 256))


# -- prompts: conversation turns, some rewritten to commands, follow-ups and acknowledgements ---

PROMPT_COLS = """conv_id, turn, CASE (conv_id + turn) % 9 WHEN 0 THEN '<task-notification> ' || text
 WHEN 1 THEN '/review ' || text WHEN 2 THEN 'please fix it and check that' WHEN 3 THEN 'Yes, please!' WHEN 4 THEN 'retry install'
 WHEN 5 THEN '2024-01-02 of the' ELSE text END AS prompt"""

# -- failure log: event rows as shell output, with parts of document text ------------------------

FAIL_LINE = """CASE event_id % 12 WHEN 0 THEN 'fatal: token has expired (401 unauthorized)' WHEN 1 THEN 'write error: No space left on device'
 WHEN 2 THEN 'HTTP/1.1 429 rate limit, Retry-After: ' || (event_id % 60) WHEN 3 THEN 'PermissionError: insufficient_scope for https://api.example.com/v1'
 WHEN 4 THEN '"failed": 0,' WHEN 5 THEN 'ValueError: validation error in fooBar_baz ' || event_id
 WHEN 6 THEN 'Exit code 2' WHEN 7 THEN 'billing_hard_limit reached: credit balance too low'
 WHEN 8 THEN 'connection timed out after ' || event_id || ' ms' WHEN 9 THEN 'no matches here' WHEN 10 THEN 'zsh:1: command not found: qux_tool'
 ELSE 'warning: not an invalid_grant, all fine' END"""
FAILURE_COLS = f"""event_id, user_id, ts, CASE WHEN event_type = 'view' THEN 'Read' ELSE 'Bash' END AS tool_name,
 CASE event_id % 5 WHEN 0 THEN 'grep -n foo bar.txt' WHEN 1 THEN 'make | tee log' ELSE 'python run.py' END AS command,
 CASE WHEN event_type = 'error' THEN 1 ELSE CAST(event_id % 3 AS INTEGER) END AS exit_code,
 CASE WHEN event_id % 6 = 1 THEN '' ELSE {FAIL_LINE} || {NL} || 'step ' || event_id || ' done' END AS stderr,
 'started job ' || user_id || {NL} || {FAIL_LINE} || {NL} || 'count: ' || event_id AS stdout,
 CASE event_id % 23 WHEN 3 THEN 'Insufficient_Quota' WHEN 4 THEN 'invalid_api_key' END AS code,
 CASE event_id % 19 WHEN 2 THEN 503 WHEN 5 THEN 403 WHEN 7 THEN 422 END AS status_code, CASE event_id % 17 WHEN 6 THEN 30 END AS retry_header"""
FAILURES = f"failures AS (SELECT {FAILURE_COLS} FROM events)"


def failures(t) -> DataFrame:
    return project(t.events, FAILURE_COLS)


# -- hook events -----------------------------------------------------------------------------

HOOK_COLS = """event_id, CAST(user_id AS BIGINT) AS session_id, ts, value,
 CASE event_type WHEN 'click' THEN 'UserPromptSubmit' WHEN 'view' THEN 'PostToolUse' WHEN 'error' THEN 'PostToolUseFailure'
 WHEN 'purchase' THEN 'Stop' ELSE 'SessionStart' END AS event,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
 CASE event_id % 6 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Grep' WHEN 3 THEN 'Task' WHEN 4 THEN 'Write' ELSE 'Probe' END AS tool,
 CASE WHEN event_id % 97 = 0 THEN '/home/u/.memlake/run' ELSE '/work/p' || (user_id % 5) END AS cwd"""
HOOK_DATA = """CASE event WHEN 'UserPromptSubmit' THEN '{"prompt": "question ' || event_id || ' about topic ' || k || ' and everything around it, in more words than fit a line of text"}'
 WHEN 'PostToolUse' THEN '{"tool_name": "' || tool || '", "tool_input": {"file_path": "src/m' || k || '/file' || event_id % 7 || '.py", "command": "python run.py --item ' || event_id || ' --mode long-mode-name --more options and text", "pattern": "p' || k || '", "description": "task ' || k || '"}}'
 WHEN 'PostToolUseFailure' THEN '{"tool_name": "' || tool || '", "tool_input": {"file_path": "/abs/' || k || '.md", "command": "false", "pattern": "x", "description": "y"}}'
 ELSE '{}' END"""
HOOKS = f"hooks0 AS (SELECT {HOOK_COLS} FROM events), hooks AS (SELECT *, {HOOK_DATA} AS data FROM hooks0)"


def hooks(t) -> DataFrame:
    return project(t.events, HOOK_COLS).withColumn("data", F.expr(HOOK_DATA))


# -- pairs: every document with one benchmark passage as its question ------------------------------

PAIRS = """pairs AS (SELECT d.doc_id, d.text, d.lang, d.source, b.item_id, b.text AS question
 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""


def pairs(t) -> DataFrame:
    n = t.benchmark.count()
    b = t.benchmark.select("item_id", F.col("text").alias("question"))
    return (t.documents.select("doc_id", "text", "lang", "source", (F.col("doc_id") % n).alias("item_id"))
            .join(b, "item_id"))


# -- SQL pieces of oracles -----------------------------------------------------------------------

def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def terms_sql(src: str, ids: str, limit: int | None, out: str = "terms") -> str:
    """CTEs that end in ``out``(ids, pos, term, lw): content terms of column ``txt`` of ``src``."""
    from memlake.functions import fixed

    p = out + "_"
    keep = "true" if limit is None else f"rn <= {limit // 2} OR rn > n - {limit - limit // 2} OR n <= {limit}"
    return rf"""{p}w0 AS (SELECT {ids}, regexp_extract_all(regexp_replace(txt, {lit(fixed.WRAPPER_TAG)}, ' ', 'g'), {lit(fixed.WORD)}) AS ws FROM {src}),
 {p}w1 AS (SELECT {ids}, trim(unnest(ws), '._') AS w, generate_subscripts(ws, 1) AS i FROM {p}w0),
 {p}w2 AS (SELECT {ids}, i, CASE WHEN NOT (regexp_matches(w, {lit(fixed.PATHISH)}) OR regexp_matches(w, {lit(fixed.DATEISH)}))
   AND (regexp_matches(w, {lit(fixed.HYPHENATED)}) OR regexp_matches(w, {lit(fixed.COMPOUND)}))
   THEN list_filter(regexp_split_to_array(w, '[-_.]'), lambda x: x <> '') ELSE [w] END AS ps FROM {p}w1 WHERE w <> ''),
 {p}w3 AS (SELECT {ids}, i, unnest(ps) AS w, generate_subscripts(ps, 1) AS j FROM {p}w2),
 {p}w4 AS (SELECT {ids}, lower(w) AS lw, min(i * 100000 + j) AS fst, arg_min(w, i * 100000 + j) AS term FROM {p}w3
   WHERE length(w) >= 3 AND lower(w) NOT IN {sql_list(fixed.STOPWORDS)} AND NOT regexp_matches(w, {lit(fixed.DATEISH)})
   AND NOT regexp_matches(w, {lit(fixed.PATHISH)}) GROUP BY {ids}, lower(w)),
 {p}w5 AS (SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY fst) AS rn, count(*) OVER (PARTITION BY {ids}) AS n FROM {p}w4),
 {out} AS (SELECT {ids}, row_number() OVER (PARTITION BY {ids} ORDER BY fst) AS pos, term, lw FROM {p}w5 WHERE {keep})"""


def clean_sql(c: str, limit: int) -> str:
    """SQL twin of ``text.clean``."""
    return rf"""trim(substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
 '@@[^@]*@@\s*(\([^)]*\))?', '', 'g'), '(?m)^---\s*$', ' ', 'g'),
 '(?mi)^\s*(title|type|created|updated|assistant|author|tags|aliases|date|status|name|description|session_id|share|metadata|source)\s*:.*$', ' ', 'g'),
 '(?m)^\s*#{{1,6}}\s+', '', 'g'), '\s+', ' ', 'g')), 1, {limit}))"""


def passage_sql(src: str, ids: str) -> str:
    """CTEs that end in ``passage``(ids, st, en, c, s, rn): windows of column ``text`` of ``src``, the best for ``question`` first."""
    from memlake.functions import fixed

    return rf"""q AS (SELECT {ids}, question AS txt FROM {src}), {terms_sql('q', ids, 64, 'qt')},
 pl AS (SELECT {ids}, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM {src}),
 pp AS (SELECT *, coalesce(sum(length(l) + 1) OVER (PARTITION BY {ids} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg,
   NOT regexp_matches(l, '\S') OR starts_with(ltrim(l), '<!--') AS gap FROM pl),
 pg AS (SELECT *, sum(gap::INT) OVER (PARTITION BY {ids} ORDER BY i) AS grp FROM pp),
 para AS (SELECT {ids}, grp, min(beg)::BIGINT AS b, max(beg + length(l) + CASE WHEN i < n THEN 1 ELSE 0 END)::BIGINT AS e, string_agg(l || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) AS p FROM pg WHERE NOT gap GROUP BY {ids}, grp),
 win AS (SELECT {ids}, b, e, p, unnest(generate_series(0, greatest(length(p), 1) - 1, 195)) AS o FROM para),
 raw AS (SELECT {ids}, b + o AS st, least(e, b + o + 260) AS en, substr(p, o + 1, 260) AS txt FROM win),
 cl AS (SELECT *, {clean_sql('txt', 260)} AS c FROM raw), ok AS (SELECT * FROM cl WHERE length(c) >= 40 AND NOT regexp_matches(c, {lit(fixed.FIELD_ONLY)})),
 {terms_sql('ok', ids + ', st', 128, 'wt')},
 sc AS (SELECT {ids}, st, sum(1 + least(length(lw), 20) / 20) AS s FROM wt JOIN qt USING ({ids}, lw) GROUP BY {ids}, st),
 passage AS (SELECT {ids}, st, en, c, coalesce(s, 0) AS s, row_number() OVER (PARTITION BY {ids} ORDER BY round(coalesce(s, 0), 6) DESC, st DESC) AS rn FROM ok LEFT JOIN sc USING ({ids}, st))"""
