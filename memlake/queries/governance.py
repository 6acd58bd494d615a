"""Lineage, claims and sharing."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import packs as pk, text as tx
from memlake.operators import graph as gr, metrics as mt, policy as po
from memlake.queries import demo
from memlake.queries.demo import HALF, VAULT
from memlake.queries.packs import CLAIMS
from memlake.registry import query

# -- lineage ---------------------------------------------------------------------------------

OWN_DENY = "doc_id % 37 = 5"


@query("lineage_closure", f"""WITH RECURSIVE e AS (SELECT doc_id AS child, {HALF} AS parent FROM documents WHERE doc_id > 0 UNION SELECT doc_id, doc_id + 100000000 FROM documents WHERE doc_id % 211 = 7),
 own AS (SELECT doc_id AS node FROM documents WHERE {OWN_DENY} UNION SELECT child FROM e WHERE parent NOT IN (SELECT doc_id FROM documents)),
 r AS (SELECT node FROM own UNION SELECT child FROM e JOIN r ON parent = node)
 SELECT doc_id, CASE WHEN {OWN_DENY} THEN 'own' WHEN doc_id % 211 = 7 THEN 'missing' WHEN doc_id IN (SELECT node FROM r) THEN 'ancestor' ELSE 'allowed' END AS verdict FROM documents""")
def lineage_closure(t):
    docs = t.documents.select("doc_id")
    edges = (docs.where("doc_id > 0").selectExpr("doc_id AS child", f"{HALF} AS parent")
             .unionByName(docs.where("doc_id % 211 = 7").selectExpr("doc_id AS child", "doc_id + 100000000 AS parent")))
    missing = edges.join(docs.withColumnRenamed("doc_id", "parent"), "parent", "left_anti").select(F.col("child").alias("node")).distinct()
    own = docs.where(OWN_DENY).select(F.col("doc_id").alias("node"))
    denied = gr.reachable(own.unionByName(missing), edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    flag = lambda df, name: df.select(F.col("node").alias("doc_id"), F.lit(True).alias(name))
    return (docs.join(flag(own, "o"), "doc_id", "left").join(flag(missing, "m"), "doc_id", "left").join(flag(denied, "d"), "doc_id", "left")
            .select("doc_id", F.when(F.col("o"), "own").when(F.col("m"), "missing").when(F.col("d"), "ancestor").otherwise("allowed").alias("verdict")))


ANCESTRY = f"""SELECT doc_id AS node, {HALF} AS need FROM documents WHERE doc_id > 0 UNION SELECT doc_id, CAST(floor(doc_id / 3) AS BIGINT) FROM documents WHERE doc_id > 0
 UNION SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 11 = 0 UNION SELECT doc_id, doc_id - 1 FROM documents WHERE doc_id % 11 = 1"""


@query("project_ancestry", f"""WITH RECURSIVE e AS ({ANCESTRY}), proj AS (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') OR doc_id < 3),
 ne AS (SELECT * FROM e WHERE node NOT IN (SELECT doc_id FROM proj)), r AS (SELECT node AS a, need AS b FROM ne UNION SELECT r.a, ne.need FROM r JOIN ne ON ne.node = r.b),
 bad AS (SELECT a FROM r WHERE a = b UNION SELECT r.a FROM r JOIN (SELECT a FROM r WHERE a = b) c ON c.a = r.b UNION SELECT a FROM r WHERE b NOT IN (SELECT node FROM e) AND b NOT IN (SELECT doc_id FROM proj))
 SELECT doc_id, doc_id NOT IN (SELECT a FROM bad) AS allowed FROM documents""")
def project_ancestry(t):
    d = t.documents.select("doc_id", "source")
    pair = lambda df, need: df.selectExpr("doc_id AS node", f"{need} AS need")
    edges = (pair(d.where("doc_id > 0"), HALF).union(pair(d.where("doc_id > 0"), "CAST(floor(doc_id / 3) AS BIGINT)"))
             .union(pair(d.where("doc_id % 11 = 0"), "doc_id + 1")).union(pair(d.where("doc_id % 11 = 1"), "doc_id - 1")).distinct())
    project = d.where("source IN ('src1', 'src2') OR doc_id < 3").select(F.col("doc_id").alias("node"))
    ok = gr.settled(d, edges, project).select(F.col("node").alias("doc_id"), F.lit(True).alias("ok"))
    return d.join(ok, "doc_id", "left").select("doc_id", F.coalesce("ok", F.lit(False)).alias("allowed"))


# -- claim relations: dependency trees, rings of five, self-loops, replacements, contradictions --------

DEPENDS = f"""SELECT doc_id AS node, {HALF} AS need FROM documents WHERE doc_id % 3 = 0 AND doc_id > 0 UNION SELECT doc_id, doc_id - 1 FROM documents WHERE doc_id % 40 BETWEEN 1 AND 4
 UNION SELECT doc_id, doc_id + 4 FROM documents WHERE doc_id % 40 = 0 UNION SELECT doc_id, doc_id FROM documents WHERE doc_id % 97 = 9"""
SUPERSEDES = "SELECT doc_id AS node, doc_id - 3 AS target FROM documents WHERE doc_id % 7 = 0 AND doc_id >= 3"
CONTRADICTS = "SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 9 = 0"


def claim_tables(t):
    d = t.documents.select("doc_id")
    pair = lambda cond, other, a="node", b="need": d.where(cond).selectExpr(f"doc_id AS {a}", f"{other} AS {b}")
    depends = (pair("doc_id % 3 = 0 AND doc_id > 0", HALF).union(pair("doc_id % 40 BETWEEN 1 AND 4", "doc_id - 1"))
               .union(pair("doc_id % 40 = 0", "doc_id + 4")).union(pair("doc_id % 97 = 9", "doc_id")).distinct())
    supersedes = pair("doc_id % 7 = 0 AND doc_id >= 3", "doc_id - 3", "node", "target")
    contradicts = pair("doc_id % 9 = 0", "doc_id + 1", "a", "b")
    return d.select(F.col("doc_id").alias("node")), depends, supersedes, contradicts


@query("claim_cycles", f"""WITH RECURSIVE e AS (SELECT need AS src, node AS dst FROM ({DEPENDS}) UNION SELECT node, target FROM ({SUPERSEDES})),
 r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT DISTINCT a AS node FROM r WHERE a = b""")
def claim_cycles(t):
    _, depends, supersedes, _ = claim_tables(t)
    return gr.cyclic_members(depends.select(F.col("need").alias("src"), F.col("node").alias("dst"))
                             .unionByName(supersedes.select(F.col("node").alias("src"), F.col("target").alias("dst"))))


CYCLIC_SQL = f"""dep AS ({DEPENDS}), sup AS ({SUPERSEDES}), allinf AS (SELECT need AS src, node AS dst FROM dep UNION SELECT node, target FROM sup),
 clos AS (SELECT src AS a, dst AS b FROM allinf UNION SELECT clos.a, allinf.dst FROM clos JOIN allinf ON allinf.src = clos.b), cyc AS (SELECT DISTINCT a AS node FROM clos WHERE a = b)"""


def _governance_sql(out: str, part: str) -> str:
    """CTEs ending in ``out``(node, state): claims are decided once all that influences them is; key -1 starts the recursion."""
    return f"""{out}_p AS ({part}), {out}_i AS (SELECT src, dst FROM allinf WHERE src IN (SELECT node FROM {out}_p) AND dst IN (SELECT node FROM {out}_p)),
 {out}(node, state) USING KEY (node) AS (SELECT -1::BIGINT, 'start' UNION
  SELECT p.node, CASE WHEN bad.node IS NOT NULL THEN 'invalidated' WHEN rep.node IS NOT NULL THEN 'superseded' ELSE 'governing' END FROM {out}_p p
  LEFT JOIN (SELECT DISTINCT d.node FROM dep d LEFT JOIN (SELECT node FROM recurring.{out} WHERE state = 'governing') g ON g.node = d.need WHERE g.node IS NULL) bad ON bad.node = p.node
  LEFT JOIN (SELECT DISTINCT s.target AS node FROM sup s JOIN (SELECT node FROM recurring.{out} WHERE state IN ('governing', 'superseded')) g ON g.node = s.node) rep ON rep.node = p.node
  WHERE p.node NOT IN (SELECT node FROM recurring.{out}) AND p.node NOT IN (SELECT i.dst FROM {out}_i i LEFT JOIN (SELECT node FROM recurring.{out}) g ON g.node = i.src WHERE g.node IS NULL))"""


@query("claim_governance", f"""WITH RECURSIVE {CYCLIC_SQL}, {_governance_sql('gov', 'SELECT doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT node FROM cyc)')},
 rep AS (SELECT DISTINCT target AS node FROM sup JOIN gov ON gov.node = sup.node AND state IN ('governing', 'superseded'))
 SELECT node, state, node IN (SELECT node FROM rep) AS superseded FROM gov WHERE node >= 0 UNION ALL SELECT node, 'cyclic', false FROM cyc WHERE node IN (SELECT doc_id FROM documents)""")
def claim_governance(t):
    nodes, depends, supersedes, _ = claim_tables(t)
    edges = (depends.select(F.col("need").alias("src"), F.col("node").alias("dst"))
             .unionByName(supersedes.select(F.col("node").alias("src"), F.col("target").alias("dst"))))
    cyclic = gr.cyclic_members(edges)
    gov = gr.governance(nodes, depends, supersedes, cyclic)
    return gov.unionByName(cyclic.join(nodes, "node", "left_semi").select("node", F.lit("cyclic").alias("state"), F.lit(False).alias("superseded")))


def _conflicts_sql(stages: int) -> str:
    """CTEs ending in ``out<stages>``(node) and ``gov<stages>``: each stage leaves out the parties that the one before found in conflict.

    The demo needs two stages; a stage without open conflicts changes nothing.
    """
    parts = [f"""con AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ({CONTRADICTS}) WHERE a <> b), pre AS (SELECT node, need FROM dep UNION SELECT pre.node, dep.need FROM pre JOIN dep ON dep.node = pre.need),
 out0 AS (SELECT 0::BIGINT AS node WHERE false)"""]
    for i in range(1, stages + 1):
        parts.append(f"""{_governance_sql(f'gov{i}', f'SELECT doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT node FROM cyc) AND doc_id NOT IN (SELECT node FROM out{i - 1})')},
 iss{i} AS (SELECT node FROM gov{i} WHERE state IN ('governing', 'superseded')), both{i} AS (SELECT a, b FROM con WHERE a IN (SELECT node FROM iss{i}) AND b IN (SELECT node FROM iss{i})),
 help{i} AS (SELECT a, b, sup.node AS issuer FROM both{i} JOIN sup ON sup.target IN (a, b) WHERE sup.node IN (SELECT node FROM iss{i})),
 bad{i} AS (SELECT DISTINCT h.a, h.b, h.issuer FROM help{i} h JOIN pre ON pre.node = h.issuer AND pre.need IN (h.a, h.b)),
 solved{i} AS (SELECT DISTINCT h.a, h.b FROM help{i} h LEFT JOIN bad{i} x ON x.a = h.a AND x.b = h.b AND x.issuer = h.issuer WHERE x.issuer IS NULL),
 open{i} AS (SELECT a, b FROM both{i} EXCEPT SELECT a, b FROM solved{i}), out{i} AS (SELECT node FROM out{i - 1} UNION SELECT a FROM open{i} UNION SELECT b FROM open{i})""")
    return ", ".join(parts)


@query("claim_conflicts", f"""WITH RECURSIVE {CYCLIC_SQL}, {_conflicts_sql(4)} SELECT node, state FROM gov4 WHERE node >= 0
 UNION ALL SELECT node, 'contradicted' FROM out3 UNION ALL SELECT node, 'cyclic' FROM cyc WHERE node IN (SELECT doc_id FROM documents)""")
def claim_conflicts(t):
    nodes, depends, supersedes, contradicts = claim_tables(t)
    gov, conflicted, cyclic = gr.conflicts(nodes, depends, supersedes, contradicts)
    label = lambda df, s: df.join(nodes, "node", "left_semi").select("node", F.lit(s).alias("state"))
    return gov.select("node", "state").unionByName(label(conflicted, "contradicted")).unionByName(label(cyclic, "cyclic"))


# -- audiences -------------------------------------------------------------------------------------

RULES = [("src1*", ["host", "model", "staging"], False), ("src1/1*", ["host", "staging"], False), ("src2/*", ["model", "staging"], False),
         ("src?/[2-4]*", ["host", "local", "model"], False), ("*7.md", ["host", "model"], True), ("*77.md", ["host"], True)]
DEFAULT = ["host", "local"]
_RX = [(po.glob_regex(g), a, r) for g, a, r in RULES]


def _rules_sql(path: str) -> str:
    grants = ", ".join(f"CASE WHEN regexp_matches({path}, '{g}') THEN {a} END" for g, a, r in _RX if not r)
    limits = ", ".join(f"CASE WHEN regexp_matches({path}, '{g}') THEN {a} END" for g, a, r in _RX if r)
    return f"list_filter([{grants}], lambda x: x IS NOT NULL) AS gs, list_filter([{limits}], lambda x: x IS NOT NULL) AS ls"


AUD_SQL = f"""au0 AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, {_rules_sql("source || '/' || doc_id || '.md'")} FROM documents),
 au1 AS (SELECT doc_id, path, unnest(['host', 'local', 'model', 'staging']) AS a, gs, ls FROM au0),
 au AS (SELECT doc_id, path, a FROM au1 WHERE CASE WHEN len(gs) > 0 THEN len(list_filter(gs, lambda g: NOT list_contains(g, a))) = 0 ELSE a IN ('host', 'local') END AND len(list_filter(ls, lambda l: NOT list_contains(l, a))) = 0)"""


@query("policy_audiences", f"WITH {AUD_SQL} SELECT doc_id, coalesce(string_agg(a, ',' ORDER BY a), '') AS audiences FROM documents LEFT JOIN au USING (doc_id) GROUP BY doc_id")
def policy_audiences(t):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    rules = po.rule_table(t.spark.createDataFrame(RULES, "source string, audiences array<string>, restrict boolean"))
    return t.documents.select("doc_id", F.array_join(po.audiences(path, DEFAULT, rules), ",").alias("audiences"))


CLAIM_AUD = "CASE doc_id % 3 WHEN 0 THEN 'host,model' WHEN 1 THEN 'host,local,model' ELSE 'model' END"


@query("artifact_audiences", f"""WITH {VAULT}, x AS (SELECT doc_id, doc_id % 5 <> 0 AS ext, {CLAIM_AUD} AS ca, regexp_matches(note, '<!-- memlake:claim') AS has FROM vault),
 y AS (SELECT doc_id, ext, has, unnest(['host', 'local', 'model', 'staging']) AS a, ca FROM x)
 SELECT doc_id, CASE WHEN bool_and(ext AND NOT has) THEN '*' ELSE coalesce(string_agg(a, ',' ORDER BY a) FILTER (WHERE (ext OR a IN ('host', 'local')) AND (NOT has OR list_contains(string_split(ca, ','), a))), '') END AS audiences FROM y GROUP BY doc_id""")
def artifact_audiences(t):
    sets = F.transform(pk.claim_records(F.col("note"), "memlake"), lambda r: F.split(F.expr(CLAIM_AUD), ","))
    aud = po.artifact_audiences(F.col("doc_id") % 5 != 0, sets)
    return demo.vault(t).select("doc_id", F.coalesce(F.array_join(aud, ","), F.lit("*")).alias("audiences"))


# Records with controls at several depths: flags, lists of origins, notes and claims inside strings, and two kinds of damage.
_BS = "chr(92)"
RECORD = f"""CASE doc_id % 12 WHEN 0 THEN '{{"a": {{"b": [{{"Private": ' || CASE doc_id % 5 WHEN 0 THEN 'false' WHEN 1 THEN '"false"' WHEN 2 THEN '"no"' ELSE 'true' END || '}}]}}}}'
 WHEN 1 THEN '{{"m": [[{{"Derivation_Sources": ["n' || {HALF} || '", "log/' || source || '"]}}], 7, null]}}'
 WHEN 2 THEN '{{"message": {{"content": [{{"text": "---' || {_BS} || 'nprivate: ' || CASE WHEN doc_id % 7 = 0 THEN 'false' ELSE 'true' END || {_BS} || 'n---' || {_BS} || 'nbody"}}]}}}}'
 WHEN 3 THEN '{{"deep": {{"er": [{{"note": "text' || {_BS} || 'n<!-- memlake:claim {{' || {_BS} || '"audiences' || {_BS} || '": [' || {_BS} || '"host' || {_BS} || '", ' || {_BS} || '"model' || {_BS} || '"]}} -->"}}]}}}}'
 WHEN 4 THEN '{{"x": [{{"y": {{"derivation_sources": ' || CASE WHEN doc_id % 49 = 4 THEN '"n1"' WHEN doc_id % 49 = 8 THEN '["n1", 5]' ELSE '[]' END || '}}}}]}}'
 WHEN 5 THEN CASE WHEN doc_id % 31 = 5 THEN '{{"cut": [1, 2' WHEN doc_id % 31 = 6 THEN '[{{"private": true}}]' WHEN doc_id % 31 = 7 THEN '{{"cut": [1, 2]}}}}' ELSE '{{"cut": [1, 2]}}' END
 WHEN 6 THEN '{{"a": {{"b": {{"c": {{"d": [{{"s": "<!-- memlake:provenance {{' || {_BS} || '"derivation_sources' || {_BS} || '": [' || {_BS} || '"p' || doc_id % 9 || {_BS} || '"' || CASE WHEN doc_id % 43 = 6 THEN '' ELSE ']' END || '}} -->"}}]}}}}}}}}'
 ELSE '{{"text": "nothing to see", "n": ' || doc_id || ', "private_note": true}}' END"""
RECORD_FILE = "'f' || doc_id % 97"


@query("restriction_scan", rf"""WITH r AS (SELECT doc_id, {RECORD_FILE} AS file, {RECORD} AS raw FROM documents), ok AS (SELECT doc_id, file, raw FROM r WHERE json_valid(raw) AND substr(raw, 1, 1) = '{{'),
 tree AS (SELECT doc_id, file, lower(key) AS k, e.type AS ty, e.value AS v, CASE WHEN e.type = 'VARCHAR' THEN e.atom->>'$' END AS s FROM ok, json_tree(raw) e),
 aud AS (SELECT doc_id, file, ['host', 'local'] AS au FROM tree WHERE k = 'private' AND NOT coalesce(v = 'false' OR s = 'false', false)
   UNION ALL SELECT doc_id, file, ['host', 'local'] FROM tree WHERE regexp_matches(s, '\A---\n(.*\n)*private: true\n')
   UNION ALL SELECT doc_id, file, CAST((unnest(regexp_extract_all(s, '(?m)^<!-- memlake:claim (\{{[^\n]*\}}) -->\s*$', 1))::JSON)->'$.audiences' AS VARCHAR[]) FROM tree WHERE s IS NOT NULL),
 n AS (SELECT file, count(*) AS n FROM aud GROUP BY file), c AS (SELECT file, a, count(*) AS c FROM (SELECT file, unnest(au) AS a FROM aud) GROUP BY ALL),
 prov AS (SELECT file, unnest(regexp_extract_all(s, '(?m)^<!-- memlake:provenance (\{{[^\n]*\}}) -->\s*$', 1)) AS p FROM tree WHERE s IS NOT NULL),
 lists AS (SELECT file, v AS l, ty FROM tree WHERE k = 'derivation_sources' UNION ALL SELECT file, (p::JSON)->'$.derivation_sources', 'ARRAY' FROM prov WHERE json_valid(p)),
 items AS (SELECT file, e.type AS ty, e.atom->>'$' AS o FROM lists, json_each(l) e WHERE lists.ty = 'ARRAY'),
 unresolved AS (SELECT file FROM r WHERE doc_id NOT IN (SELECT doc_id FROM ok) UNION SELECT file FROM lists WHERE ty <> 'ARRAY' UNION SELECT file FROM items WHERE ty <> 'VARCHAR' UNION SELECT file FROM prov WHERE NOT json_valid(p))
 SELECT file, 'audience' AS kind, a AS value FROM c JOIN n USING (file) WHERE c = n UNION ALL SELECT DISTINCT file, 'origin', o FROM items WHERE ty = 'VARCHAR' UNION ALL SELECT file, 'unresolved', 'true' FROM unresolved""")
def restriction_scan(t):
    """What the records of each file restrict, wherever in a record it stands."""
    records = t.documents.select(F.expr(RECORD_FILE).alias("file"), F.expr(RECORD).alias("raw"))
    return po.restrictions(records, "file", "raw", "memlake")


@query("audience_intersection", f"""WITH {AUD_SQL}, p AS (SELECT doc_id, doc_id AS of_doc FROM documents UNION SELECT doc_id, {HALF} FROM documents UNION SELECT doc_id, CAST(floor(doc_id / 4) AS BIGINT) FROM documents),
 n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id), c AS (SELECT p.doc_id, a, count(*) AS c FROM p JOIN au ON au.doc_id = p.of_doc GROUP BY ALL) SELECT doc_id, a AS audience FROM c JOIN n USING (doc_id) WHERE c = n""")
def audience_intersection(t):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    aud = t.documents.select(F.col("doc_id").alias("of_doc"), po.audiences(path, DEFAULT, RULES).alias("a"))
    of = F.array_distinct(F.array(F.col("doc_id"), F.expr(HALF), F.expr("CAST(floor(doc_id / 4) AS BIGINT)")))
    chain = t.documents.select("doc_id", F.explode(of).alias("of_doc"))
    return po.shared_values(chain.join(aud, "of_doc"), "doc_id", "a").select("doc_id", F.col("value").alias("audience"))


@query("inherit_restrictions", f"""WITH s AS (SELECT doc_id, ['n' || {HALF}, source] AS so, CASE WHEN doc_id % 3 = 0 THEN ['host', 'model'] ELSE ['host', 'local', 'model'] END AS sa, doc_id % 19 = 0 AS su FROM documents),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
 SELECT doc_id, i::BIGINT AS part, array_to_string(list_sort(list_distinct(list_concat(['part-' || i, source_], so))), ',') AS origins, array_to_string(list_sort(list_intersect(CASE WHEN i % 2 = 0 THEN ['host', 'local'] ELSE ['host', 'model'] END, sa)), ',') AS audiences,
 su OR l = '' AS unknown FROM l JOIN s USING (doc_id) JOIN (SELECT doc_id, source AS source_ FROM documents) USING (doc_id)""")
def inherit_restrictions(t):
    src = t.documents.select("doc_id", F.array(F.expr(f"'n' || {HALF}"), F.col("source")).alias("so"),
                             F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("host"), F.lit("model"))).otherwise(F.array(F.lit("host"), F.lit("local"), F.lit("model"))).alias("sa"),
                             (F.col("doc_id") % 19 == 0).alias("su"))
    parts = tx.unnest(t.documents, ["doc_id", "source"], F.split("text", "\n"), "l", "part")
    own_a = F.when(F.col("part") % 2 == 0, F.array(F.lit("host"), F.lit("local"))).otherwise(F.array(F.lit("host"), F.lit("model")))
    own_o = F.array(F.concat(F.lit("part-"), F.col("part").cast("string")), F.col("source"))
    return parts.join(src, "doc_id").select(
        "doc_id", "part", F.array_join(F.array_sort(F.array_union(own_o, F.col("so"))), ",").alias("origins"),
        F.array_join(F.array_sort(F.array_intersect(own_a, F.col("sa"))), ",").alias("audiences"), (F.col("su") | (F.col("l") == "")).alias("unknown"))


# -- claims ------------------------------------------------------------------------------------------

@query("claim_applicability", """WITH o AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderpriority <> '1-URGENT' THEN 'scope-repository' END, CASE WHEN o_orderstatus <> '' THEN 'unknown-environment' END,
  CASE WHEN TIMESTAMP '1996-06-01' < o_orderdate THEN 'not-yet-valid' END, CASE WHEN TIMESTAMP '1996-06-01' >= o_orderdate + INTERVAL 700 DAY THEN 'expired' END, CASE WHEN o_custkey % 3 = 0 THEN 'audience-denied' END], lambda x: x IS NOT NULL)) AS reason FROM orders) SELECT * FROM o""")
def claim_applicability(t):
    allowed = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("local"))).otherwise(F.array(F.lit("host"), F.lit("local")))
    reasons = po.claim_reasons({"repository": (F.col("o_orderpriority"), "1-URGENT"), "environment": (F.col("o_orderstatus"), "")},
                               F.col("o_orderdate"), F.expr("o_orderdate + INTERVAL 700 DAY"), allowed, ["host"], F.lit("1996-06-01").cast("timestamp_ntz"))
    return t.orders.select("o_orderkey", F.explode(reasons).alias("reason"))


@query("claim_authority", f"""WITH d AS (SELECT doc_id, sha256(text) AS rev, sha256('c' || doc_id || lang) AS digest FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE digest END AS claim_digest, doc_id % 14 = 0 AS revoked,
  CASE doc_id % 6 WHEN 0 THEN 'verified' WHEN 2 THEN 'approved' ELSE 'bogus' END AS authority FROM d WHERE doc_id % 2 = 0),
 ev AS (SELECT doc_id, of_doc, CASE WHEN of_doc % 15 = 0 THEN 'changed' ELSE rev END AS seen, rev FROM (SELECT doc_id, doc_id AS of_doc FROM r UNION SELECT doc_id, {HALF} FROM r) JOIN (SELECT doc_id AS of_doc, rev FROM d) USING (of_doc)),
 ok AS (SELECT doc_id, bool_and(seen = rev) AS ok FROM ev GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN NOT revoked AND claim_digest = digest AND ok AND authority IN ('verified', 'approved') THEN authority ELSE 'unverified' END AS authority FROM d LEFT JOIN r USING (doc_id) LEFT JOIN ok USING (doc_id)""")
def claim_authority(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("rev"), F.sha2(F.concat(F.lit("c"), F.col("doc_id").cast("string"), "lang"), 256).alias("digest"))
    r = d.where("doc_id % 2 = 0").select(
        "doc_id", F.expr("CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE digest END AS claim_digest"), F.expr("doc_id % 14 = 0 AS revoked"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN 'verified' WHEN 2 THEN 'approved' ELSE 'bogus' END AS authority"))
    cited = r.select("doc_id", F.explode(F.array_distinct(F.array(F.col("doc_id"), F.expr(HALF)))).alias("of_doc"))
    current = d.select(F.col("doc_id").alias("of_doc"), F.col("rev"), F.expr("CASE WHEN doc_id % 15 = 0 THEN 'changed' ELSE rev END").alias("seen"))
    holds = cited.join(current, "of_doc", "left").groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("seen") == F.col("rev"), F.lit(False))).alias("ok"))
    good = ~F.col("revoked") & (F.col("claim_digest") == F.col("digest")) & F.col("ok") & F.col("authority").isin("verified", "approved")
    return (d.join(r, "doc_id", "left").join(holds, "doc_id", "left")
            .select("doc_id", F.when(good, F.col("authority")).otherwise("unverified").alias("authority")))


@query("claim_passages", CLAIMS + r""", f AS (SELECT v.doc_id, regexp_replace(note, '(?m)^<!-- memlake:claim (\{[^\n]*\}) -->[^\S\n]*$', '', 'g') AS n FROM vault v)
 SELECT v.doc_id, coalesce(c.claim_id, '') AS claim_id, coalesce(CASE WHEN c.status IN ('verified', 'proposed') THEN c.text END, '') AS passage, sha256(CASE WHEN c.status = 'approved' THEN replace(n, c.text, '') ELSE n END) AS filtered
 FROM f v LEFT JOIN claims c USING (doc_id)""")
def claim_passages(t):
    """Prose without claim markers and without denied claim texts, plus the applicable claims as passages."""
    v = demo.vault(t)
    prose = v.select("doc_id", tx.sub(F.col("note"), r"(?dm)^<!-- memlake:claim (\{[^\n]*\}) -->[^\S\n]*$", "").alias("n"))
    c = pk.claims(v, ["doc_id"], F.col("note"), "memlake").select("doc_id", "claim_id", "text", "status")
    denied = F.col("status") == "approved"
    return prose.join(c, "doc_id", "left").select(
        "doc_id", F.coalesce("claim_id", F.lit("")).alias("claim_id"), F.coalesce(F.when(F.col("status").isin("verified", "proposed"), F.col("text")), F.lit("")).alias("passage"),
        F.sha2(F.when(denied, F.replace("n", "text", F.lit(""))).otherwise(F.col("n")), 256).alias("filtered"))


# -- sharing --------------------------------------------------------------------------------------------

NOTE = """doc_id, source || '/' || doc_id || '.md' AS path, n_chars, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 13 < 8 THEN 'decision' ELSE 'memo' END AS kind, doc_id % 9 = 4 AS claims_deny, doc_id % 12 = 5 AS generated, doc_id % 24 = 5 AS has_origin"""
RECEIPT = "CASE WHEN doc_id % 4 = 0 THEN rev WHEN doc_id % 4 = 1 THEN 'older' END"
PLAN_SQL = f"""{AUD_SQL}, nt AS (SELECT {NOTE}, sha256(text) AS rev FROM documents), st AS (SELECT doc_id FROM au WHERE a = 'staging'),
 plan AS (SELECT nt.*, {RECEIPT} AS receipt, CASE WHEN kind NOT IN ('decision', 'gotcha') THEN 'not_eligible' WHEN n_chars < 200 THEN 'stub' WHEN st.doc_id IS NULL THEN 'local_only' WHEN claims_deny OR (generated AND NOT has_origin) THEN 'denied'
  WHEN {RECEIPT} = rev THEN 'unchanged' WHEN doc_id % 4 = 2 AND doc_id % 8 = 2 THEN 'legacy_deferred' WHEN doc_id % 16 = 3 THEN 'unknown_outcome' ELSE 'push' END AS decision FROM nt LEFT JOIN st USING (doc_id))"""


def push_decisions(t):
    d = demo.project(t.documents, NOTE).join(t.documents.select("doc_id", F.sha2("text", 256).alias("rev")), "doc_id")
    receipts = d.select("doc_id", F.expr(RECEIPT).alias("receipt")).where("receipt IS NOT NULL")
    legacy = d.where("doc_id % 8 = 2").select("doc_id", F.col("rev").alias("legacy"))
    intents = d.where("doc_id % 16 = 3").select("doc_id", F.lit("unknown").alias("intent"))
    rows = d.join(receipts, "doc_id", "left").join(legacy, "doc_id", "left").join(intents, "doc_id", "left")
    staging = F.array_contains(po.audiences(F.col("path"), DEFAULT, RULES), "staging")
    decision = (F.when(~F.col("kind").isin("decision", "gotcha"), "not_eligible").when(F.col("n_chars") < 200, "stub").when(~staging, "local_only")
                .when(F.col("claims_deny") | (F.col("generated") & ~F.col("has_origin")), "denied").when(F.col("receipt") == F.col("rev"), "unchanged")
                .when((F.col("legacy") == F.col("rev")) & F.col("receipt").isNull(), "legacy_deferred").when(F.col("intent").isin("unknown", "conflict"), "unknown_outcome").otherwise("push"))
    return rows.withColumn("decision", decision)


@query("push_plan", f"WITH {PLAN_SQL} SELECT doc_id, path, decision FROM plan")
def push_plan(t):
    return push_decisions(t).select("doc_id", "path", "decision")


@query("revocation_queue", f"""WITH {PLAN_SQL}, q AS (SELECT doc_id, CASE decision WHEN 'not_eligible' THEN 'eligibility-revoked' ELSE 'audience-revoked' END AS reason, receipt AS revision FROM plan WHERE receipt IS NOT NULL AND decision IN ('not_eligible', 'local_only', 'denied')),
 old AS (SELECT doc_id, 'eligibility-revoked' AS reason FROM plan WHERE doc_id % 20 = 0), clr AS (SELECT doc_id FROM plan WHERE doc_id % 20 = 0 AND decision = 'unchanged')
 SELECT doc_id, reason, 'queued' AS action FROM q WHERE (doc_id, reason) NOT IN (SELECT doc_id, reason FROM old) UNION ALL SELECT doc_id, 'eligibility-revoked', 'cleared' FROM clr""")
def revocation_queue(t):
    p = push_decisions(t).select("doc_id", "decision", "receipt")
    lost = p.where("receipt IS NOT NULL AND decision IN ('not_eligible', 'local_only', 'denied')").select(
        "doc_id", F.when(F.col("decision") == "not_eligible", "eligibility-revoked").otherwise("audience-revoked").alias("reason"))
    old = p.where("doc_id % 20 = 0").select("doc_id", F.lit("eligibility-revoked").alias("reason"))
    queued = lost.join(old, ["doc_id", "reason"], "left_anti").withColumn("action", F.lit("queued"))
    restored = p.where("decision = 'unchanged'").select("doc_id")
    return queued.unionByName(old.join(restored, "doc_id", "left_semi").withColumn("action", F.lit("cleared")))


@query("intent_reconcile", """WITH i AS (SELECT doc_id, sha256(text) AS rev FROM documents WHERE doc_id % 2 = 1), r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS remote FROM documents WHERE doc_id % 3 <> 0)
 SELECT doc_id, CASE WHEN remote IS NULL THEN 'absent' WHEN remote = rev THEN 'confirmed' ELSE 'conflict' END AS status FROM i LEFT JOIN r USING (doc_id)""")
def intent_reconcile(t):
    i = t.documents.where("doc_id % 2 = 1").select("doc_id", F.sha2("text", 256).alias("rev"))
    r = t.documents.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("remote"))
    return i.join(r, "doc_id", "left").select("doc_id", F.when(F.col("remote").isNull(), "absent").when(F.col("remote") == F.col("rev"), "confirmed").otherwise("conflict").alias("status"))
