"""Failure analytics family."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import failures as fl, fixed
from memlake.queries import demo
from memlake.queries.demo import FAILURES, lit, sql_list
from memlake.registry import query

E = lambda p: lit(p)
TEXT = rf"""WITH {FAILURES}, ft AS (SELECT *, CASE WHEN tool_name NOT IN ('', 'Bash') THEN '' WHEN exit_code <> 0 THEN stderr || chr(10) || right(stdout, 4000)
  WHEN regexp_matches(stderr, {E(fixed.ERROR_LINE)}) THEN stderr ELSE '' END AS failure FROM failures),
 bad AS (SELECT * FROM ft WHERE failure <> ''),
 ls0 AS (SELECT event_id, list_filter(list_transform(string_split(failure, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM bad),
 ls AS (SELECT event_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM ls0),
 sc AS (SELECT event_id, l, i, least(len(regexp_extract_all(l, '[A-Za-z]{{3,}}')), 12) * 2 + CASE WHEN regexp_matches(l, {E(fixed.DIAGNOSTIC)}) THEN 100 ELSE 0 END AS s
   FROM ls WHERE i > n - 60 AND regexp_matches(l, {E(fixed.ERROR_LINE)}) AND NOT regexp_matches(l, {E(fixed.DATA_LINE)})),
 el AS (SELECT event_id, substr(arg_max(l, s * 1000 + i), 1, 300) AS el FROM sc GROUP BY event_id),
 fb AS (SELECT event_id, substr(CASE WHEN regexp_matches(ls[1], {E(fixed.EXIT_HEADER)}) THEN ls[1] ELSE ls[-1] END, 1, 300) AS fb FROM ls0),
 an0 AS (SELECT bad.*, coalesce(el, '') AS error_line, coalesce(fb, '') AS fallback, CASE WHEN coalesce(el, '') <> '' THEN el ELSE coalesce(fb, '') END AS line,
   right(array_to_string(list_filter(string_split(failure, chr(10)), lambda l: NOT regexp_matches(l, {E(fixed.DATA_LINE)})), chr(10)), 6000) AS evidence
   FROM bad LEFT JOIN el USING (event_id) LEFT JOIN fb USING (event_id)),
 an1 AS (SELECT *, lower(regexp_replace(evidence, {E(fixed.NEGATED_CREDENTIAL)}, '', 'g')) AS act, lower(coalesce(code, '')) || chr(10) || lower(regexp_replace(evidence, {E(fixed.NEGATED_CREDENTIAL)}, '', 'g')) AS said, coalesce(status_code::VARCHAR, regexp_extract(evidence, {E(fixed.HTTP_STATUS)}, 1)) AS st,
   exit_code = 1 AND stderr = '' AND split_part(command, ' ', 1) IN {sql_list(fixed.QUIET_TOOLS)} AND NOT regexp_matches(command, '[;|]|&&') AS quiet FROM an0),
 an AS (SELECT *, CASE WHEN quiet THEN 'expected_nonzero' WHEN regexp_matches(said, {E(fixed.BUDGET)}) THEN 'budget' WHEN regexp_matches(said, {E(fixed.RESOURCE)}) THEN 'resource'
   WHEN regexp_matches(said, {E(fixed.AUTHENTICATION)}) OR st = '401' OR regexp_matches(act, {E(fixed.AUTHENTICATION_401)}) THEN 'authentication'
   WHEN st = '403' OR regexp_matches(said, {E(fixed.AUTHORIZATION)}) THEN 'authorization' WHEN st IN ('429', '502', '503', '504') OR regexp_matches(said, {E(fixed.TRANSIENT)}) THEN 'transient'
   WHEN st IN ('400', '422') OR regexp_matches(said, {E(fixed.INVALID_INPUT)}) THEN 'invalid_input' ELSE 'unknown' END AS kind,
   CASE WHEN NOT quiet AND retry_header IS NOT NULL THEN retry_header::BIGINT WHEN NOT quiet AND regexp_extract(act, {E(fixed.RETRY_AFTER)}, 1) <> '' THEN CAST(regexp_extract(act, {E(fixed.RETRY_AFTER)}, 1) AS BIGINT) END AS retry_after FROM an1)"""


def _failure(c: str):
    return fl.failure_text(F.col("tool_name"), F.col("exit_code"), F.col("stderr"), F.col("stdout")).alias(c)


@query("failure_text", TEXT + " SELECT event_id, failure FROM bad")
def failure_text(t):
    return demo.failures(t).select("event_id", _failure("failure")).where("failure <> ''")


@query("error_line", TEXT + " SELECT event_id, error_line FROM an0")
def error_line(t):
    bad = demo.failures(t).select("event_id", _failure("failure")).where("failure <> ''")
    return bad.select("event_id", fl.error_line(F.col("failure")).alias("error_line"))


@query("fallback_line", TEXT + " SELECT event_id, fallback FROM an0")
def fallback_line(t):
    bad = demo.failures(t).select("event_id", _failure("failure")).where("failure <> ''")
    return bad.select("event_id", fl.fallback_line(F.col("failure")).alias("fallback"))


@query("classify_failure", TEXT + " SELECT event_id, kind, retry_after FROM an")
def classify_failure(t):
    return fl.analysed(demo.failures(t)).select("event_id", "kind", "retry_after")


@query("rule_advice", TEXT + ", hits AS (" + " UNION ALL ".join(
    f"SELECT event_id, '{n}' AS advice FROM an WHERE regexp_matches(evidence, {lit('(?i)' + p)})" for n, p in fixed.RULE_PATTERNS)
    + ") SELECT DISTINCT event_id, advice FROM hits")
def rule_advice(t):
    rows = fl.analysed(demo.failures(t))
    table = t.spark.createDataFrame([(i, *r) for i, r in enumerate(fixed.RULE_PATTERNS)], "position int, name string, pattern string")
    return rows.select("event_id", F.explode_outer(fl.advice(F.col("evidence"), fl.rule_table(table))).alias("advice")).where("advice IS NOT NULL")


@query("error_identifiers", TEXT + rf""", b AS (SELECT event_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(line, {E(fixed.URL)}, ' ', 'g'), {E(fixed.DOTTED)}, ' ', 'g'),
   {E(fixed.ERROR_NOISE)}, ' ', 'g'), {E(fixed.FAILURE_IDENTIFIER)}) AS ts FROM an),
 c AS (SELECT event_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i FROM b),
 d AS (SELECT event_id, lower(tok) AS lt, min(i) AS i, arg_min(tok, i) AS tok FROM c WHERE upper(tok) NOT IN {sql_list(fixed.COMMON_IDENTIFIERS)} GROUP BY event_id, lower(tok)),
 e AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY i) AS rn FROM d)
 SELECT event_id, string_agg(tok, ' ' ORDER BY i) AS identifiers FROM e WHERE rn <= 3 GROUP BY event_id""")
def error_identifiers(t):
    return (fl.analysed(demo.failures(t)).select("event_id", F.array_join(fl.identifiers(F.col("line")), " ").alias("identifiers"))
            .where("identifiers <> ''"))


@query("error_signature", TEXT + r""" SELECT kind, substr(sha1(kind || chr(10) || regexp_replace(line, '\d+', '#', 'g')), 1, 12) AS signature, count(*) AS n, min(event_id) AS first_event
 FROM an WHERE kind <> 'expected_nonzero' GROUP BY ALL""")
def error_signature(t):
    return (fl.analysed(demo.failures(t)).where("kind <> 'expected_nonzero'").groupBy("kind", "signature")
            .agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")))
