"""One query per operator, on the whole of its table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.tables import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op9_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", words=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.vectors import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", cosine=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


# Hosts under which nothing is taken, whatever their subdomain: the list of the cascade.
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x") for top in ("com", "net", "org")]
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op1_url_filter", f"""
WITH split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fit AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN {" OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in BLOCKED_HOSTS)} THEN 'block' ELSE 'allow' END AS verdict
FROM fit""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.urls import Rule, judge

    listed = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "key string")
    found = judge(read(spark, sf_dir, "pages"), "page_id", "url", listed, [Rule(*r) for r in URL_RULES])
    return found.withColumnRenamed("id", "page_id")


@query("op2_token_output")
def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from memlake.llm.tokens import round_trip

    found = round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text", end_id=1)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# Rows that score lower are rejected.
QUALITY = 0.7


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.quality import held_out, scored, train

    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY).cast("int").alias("predicted"))


@query("op4_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.decontaminate import matches

    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "distance", "end_char")


@query("op3_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.mixing import placed

    rows, _ = placed(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "source", F.col("__chars").alias("n_chars"), F.col("__start").alias("start_char"),
                       F.col("__block").alias("block"), F.col("__slot").alias("slot"))


@query("op7_lm_scores", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words),
n AS (SELECT count(*) AS tokens FROM tok),
uni AS (SELECT w, count(*) AS c FROM tok GROUP BY w UNION ALL SELECT ' start', count(*) FROM words WHERE len(w) > 0),
gram AS (SELECT doc_id, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), ' start') AS v, w FROM tok),
bi AS (SELECT v, w, count(*) AS c FROM gram GROUP BY v, w),
val AS (SELECT bi.v, bi.w, CASE WHEN bi.c >= 2 THEN ln(bi.c) - ln(a.c) ELSE ln(0.4) + ln(b.c) - ln((SELECT tokens FROM n)) END AS s
        FROM bi JOIN uni a ON a.w = bi.v JOIN uni b ON b.w = bi.w)
SELECT d.doc_id, count(g.w) AS n_tokens, round(coalesce(sum(s), 0.0) / greatest(count(g.w), 1), 4) AS mean_log_score
FROM documents d LEFT JOIN gram g ON g.doc_id = d.doc_id LEFT JOIN val ON val.v = g.v AND val.w = g.w GROUP BY d.doc_id""")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.lm import scores

    found = scores(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.round(F.col("log_score") / F.greatest("n_tokens", F.lit(1)), 4).alias("mean_log_score"))


@query("op8_warc_transactions", """
WITH r AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM r GROUP BY h),
d AS (SELECT page_id, octet_length(encode(r.h)) AS bytes, first, sha1(r.h) AS s FROM r JOIN f USING (h))
SELECT page_id, bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""")
def warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm import warc
    from memlake.llm.tables import place

    path = place(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read(spark, path))
    facts = F.from_json(F.col("metadata.payload").cast("string"), "page_id bigint, url string, payload_bytes bigint")
    return captures.select(facts.alias("m"), "response.*").select(
        F.col("m.page_id").alias("page_id"),
        F.when(F.col("kind") == "response", F.col("payload_bytes")).otherwise(F.col("m.payload_bytes")).alias("payload_bytes"),
        F.when(F.col("kind") == "response", F.col("payload_digest")).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.regexp_extract("refers_to", r"<urn:page:(-?\d+)>", 1).try_cast("bigint").alias("refers_to"))


@query("op10_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm import html

    pages = read(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(html.sample(pages, "html"))).withColumnRenamed("id", "page_id")


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, made periodic from some place on in about a tenth of the documents, as the query's contract says."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * -(-(n - a) // p))[:n - a]


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.runs import find

    found = find(read(spark, sf_dir, "documents"), "doc_id", "text", rewrite=planted_period)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # The longest run, the first of those: structs compare field by field.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines"), "collapsed").select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), (-F.col("b.less")).alias("length"), F.col("b.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("b.less") / F.col("b.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlake.llm.whiten import whitened

    return whitened(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", count=16).withColumnRenamed("id", "vec_id")


# A user and an assistant who both say what the template itself says.
ODD_TEXT = r"\### Assistant: </turn> ok"


def _added(c: str) -> str:
    """SQL: the backslashes that escaping adds; one for each backslash, each # after a # and each mark of an end."""
    return (rf"(len(regexp_extract_all({c}, '\\')) + length(regexp_replace({c}, '[^#]+', '', 'g')) - len(regexp_extract_all({c}, '#+'))"
            f" + len(regexp_extract_all({c}, '</turn>')))")


@query("op13_chat_formatting", f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{ODD_TEXT}'),
sized AS (
  SELECT *, 4 + length(role) + 2 + length(text) + 8 + {_added("role")} + {_added("text")} + length(role) - length(replace(role, ': ', ':')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from memlake.llm import chat
    from memlake.llm.tables import place

    tokenizer, path = public_tokenizers.path("byte_bpe_50k.json"), place(spark, "chat")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    chat.save(chat.formatted(rows.unionByName(odd), tokenizer), path)
    return chat.digests(chat.load(spark, path), tokenizer).withColumnRenamed("id", "conv_id")
