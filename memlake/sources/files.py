"""Readers: journals, transcripts, exports, archives, notes, labels and logs."""

from __future__ import annotations

import io
import re
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators.ordered import null_safe, number_rows
from memlake.session import shared_dir

EVENT = "event_id string, ts string, event string, session_id string, cwd string, transcript_path string, data string"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- event journals ------------------------------------------------------------------------------

def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """Daily JSONL journals with their file name; blank and malformed lines are left out."""
    raw = (spark.read.schema(f"{EVENT}, _bad string").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path))
    return raw.select("*", F.col("_metadata.file_path").alias("journal")).where("_bad IS NULL AND event_id IS NOT NULL").drop("_bad")


def event_fault(df: DataFrame) -> Column:
    """Why an event row is rejected; null when it is valid."""
    missing = F.lit(False)
    for c in ("event_id", "ts", "event", "session_id", "cwd", "transcript_path"):
        missing = missing | F.col(c).isNull()
    return (F.when(missing, "field must be text")
            .when(~F.col("session_id").rlike(r"^[A-Za-z0-9_-]{1,200}$"), "invalid session identity")
            .when((F.col("event_id") == "") | F.coalesce(~F.trim("data").startswith("{"), F.lit(True)), "invalid identity or payload")
            .when(F.try_to_timestamp(F.rtrim("ts", F.lit("Z"))).isNull(), "invalid timestamp"))


# -- transcripts -----------------------------------------------------------------------------------

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files. Lines are numbered per file block, then across blocks."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("at"))
    return number_rows(raw, ["file"], ["block", "at"], F.col("block"), "line").select("file", "line", "value")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of JSONL bundles, which hold the lines of many transcripts each.

    Small transcripts shipped as one file each would be millions of files; a bundle keeps the name and the
    line number with every line, so its files can be cut anywhere.
    """
    return spark.read.schema("file string, line bigint, value string").json(path)


_PAYLOAD = "struct<type:string,role:string,content:string,name:string,call_id:string,arguments:string,input:string,output:string,summary:string>"
_RECORD = f"type string, message struct<content:string>, payload {_PAYLOAD}, tool_use_id string, content string, is_error boolean, _bad string"
_BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
_CALLS, _OUTPUTS = ("function_call", "custom_tool_call"), ("function_call_output", "custom_tool_call_output")


def transcript_records(lines: DataFrame) -> DataFrame:
    """Both dialects as (file, line, ok, dialect_b, role, text, thinking, calls, results), one row per non-blank line.

    Each line is parsed once. ``calls`` are (id, name, input) and ``results`` (id, output, is_error), whatever record
    they come in. A malformed or cut-off line has ``ok`` false. A file is dialect B when its first object has a payload.
    """
    rows = tx.hold(lines.where("trim(value) <> ''"), F.from_json("value", _RECORD, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    rows = rows.withColumn("ok", F.col("r").isNotNull() & F.col("r._bad").isNull())
    first = rows.where("ok").groupBy("file").agg(F.min_by(F.col("r.payload").isNotNull(), "line").alias("b"))
    rows = null_safe(rows, first, ["file"], "left").withColumn("b", F.coalesce("b", F.lit(False)))
    content = F.when(F.col("b"), F.col("r.payload.content")).otherwise(F.col("r.message.content"))
    rows = tx.hold(rows.withColumn("said", content), F.when(F.col("said").startswith("["), F.from_json("said", _BLOCKS)).alias("blocks"))
    of = lambda *kinds: F.coalesce(F.filter("blocks", lambda x: x["type"].isin(*kinds)), F.array().cast(_BLOCKS))
    text = F.when(F.col("blocks").isNotNull(), F.array_join(F.transform(of("text", "input_text", "output_text"), lambda x: x["text"]), "\n\n")).otherwise(F.col("said"))
    p = F.col("r.payload")
    call = lambda i, name, given: F.struct(i.alias("id"), name.alias("name"), given.alias("input"))
    result = lambda i, output, bad: F.struct(i.alias("id"), output.alias("output"), F.coalesce(bad, F.lit(False)).alias("is_error"))
    calls = F.when(F.col("b"), F.when(p["type"].isin(*_CALLS), F.array(call(p["call_id"], p["name"], F.coalesce(p["arguments"], p["input"]))))).otherwise(
        F.transform(of("tool_use"), lambda x: call(x["id"], x["name"], x["input"])))
    own = F.when(F.col("r.type") == "tool_result", F.array(result(F.col("r.tool_use_id"), F.col("r.content"), F.col("r.is_error"))))
    failed = F.get_json_object(p["output"], "$.is_error") == "true"
    results = F.when(F.col("b"), F.when(p["type"].isin(*_OUTPUTS), F.array(result(p["call_id"], p["output"], failed)))).otherwise(
        F.coalesce(own, F.transform(of("tool_result"), lambda x: result(x["tool_use_id"], x["content"], x["is_error"]))))
    summary = F.from_json(p["summary"], "array<struct<text:string>>")
    thinking = F.when(F.col("b"), F.transform(summary, lambda x: x["text"])).otherwise(F.transform(of("thinking"), lambda x: x["thinking"]))
    role = F.when(F.col("b"), p["role"]).otherwise(F.col("r.type"))
    listed = lambda c: F.when(F.col("ok"), c)
    return rows.select("file", "line", "ok", F.col("b").alias("dialect_b"), listed(role).alias("role"), listed(text).alias("text"),
                       listed(F.array_join(thinking, "\n")).alias("thinking"), listed(calls).alias("calls"), listed(results).alias("results"))


def transcript_coverage(lines: DataFrame, records: DataFrame) -> DataFrame:
    """(file, records, malformed, trailing_bytes): how much of each file could be read.

    Trailing bytes are those of a last line that is no whole record: the writer may still be at it.
    """
    counts = records.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.count(F.when(~F.col("ok"), 1)).alias("malformed"), F.max_by("ok", "line").alias("whole"))
    last = lines.where("trim(value) <> ''").groupBy("file").agg(F.max_by(F.octet_length("value"), "line").cast("bigint").alias("bytes"))
    return null_safe(counts, last, ["file"]).select("file", "records", "malformed", F.when(F.col("whole"), 0).otherwise(F.col("bytes")).alias("trailing_bytes"))


def session_meta(lines: DataFrame, first: int = 51) -> DataFrame:
    """First non-null id, cwd and entrypoint among the first records of each file."""
    early = lines.where(F.col("line") <= first)
    pick = lambda p, a: F.min_by(F.get_json_object("value", p), F.when(F.get_json_object("value", p).isNotNull(), F.col("line"))).alias(a)
    return early.groupBy("file").agg(pick("$.sessionId", "session_id"), pick("$.cwd", "cwd"), pick("$.entrypoint", "entrypoint"))


# -- exports ----------------------------------------------------------------------------------------

_BLOCK = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
EXPORT_A = f"uuid string, chat_messages array<struct<uuid:string,sender:string,text:string,parent_uuid:string,created_at:string,content:{_BLOCK}>>"
EXPORT_B = ("conversation_id string, current_node string, mapping map<string,struct<parent:string,message:struct<id:string,"
            "author:struct<role:string>,content:struct<content_type:string,parts:array<string>>>>>")


def messages_a(export: DataFrame, column: str) -> DataFrame:
    """Messages of exports that list them: text blocks joined by a blank line, else the message text.

    ``thinking`` are the thinking texts, ``calls`` (id, name, input) and ``results`` (id, output, is_error) the tool blocks.
    """
    c = export.select(F.from_json(column, EXPORT_A).alias("c"))
    m = tx.unnest(c.select("c.uuid", "c.chat_messages"), ["uuid"], F.col("chat_messages"), "m", "pos")
    of = lambda kind: F.filter("m.content", lambda b: b["type"] == kind)
    texts = F.array_join(F.filter(F.transform(of("text"), lambda b: b["text"]), lambda t: t != ""), "\n\n")
    return m.select("uuid", "pos", F.when(F.col("m.sender") == "human", "user").otherwise("assistant").alias("role"),
                    F.coalesce(F.nullif(texts, F.lit("")), F.col("m.text"), F.lit("")).alias("text"),
                    F.transform(of("thinking"), lambda b: b["thinking"]).alias("thinking"),
                    F.transform(of("tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("input"))).alias("calls"),
                    F.transform(of("tool_result"), lambda b: F.struct(b["tool_use_id"].alias("id"), b["content"].alias("output"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error"))).alias("results"),
                    F.coalesce("m.created_at", F.lit("")).alias("created_at"), F.coalesce("m.parent_uuid", F.lit("")).alias("parent"))


def messages_b(export: DataFrame, column: str) -> DataFrame:
    """Messages of exports that hold a node map: the branch from ``current_node`` up to the root, reversed.

    The walk is one pass along the branch in a batch function over (node, parent) pairs alone; it gives each
    node its depth, and the messages join by exploding the map once. Chains that end at a missing
    node or run in a circle reject the conversation.
    """
    def walk(current: pd.Series, nodes: pd.Series, parents: pd.Series) -> pd.Series:
        out = []
        for at, names, above in zip(current, nodes, parents):
            up, path = dict(zip(names, above)), {}
            while at in up and at not in path:
                path[at] = len(path)
                at = up[at]
            out.append({n: len(path) - d for n, d in path.items()} if path and at is None else {})
        return pd.Series(out)

    depths = F.pandas_udf(walk, "map<string,int>")
    c = export.select(F.from_json(column, EXPORT_B).alias("c")).select("c.*").where("mapping IS NOT NULL")
    walked = tx.hold(c, depths("current_node", F.map_keys("mapping"), F.transform(F.map_values("mapping"), lambda v: v["parent"])).alias("depths"))
    entries = F.transform(F.filter(F.map_entries("mapping"), lambda e: F.map_contains_key(F.col("depths"), e["key"])),
                          lambda e: F.struct(e["key"].alias("node"), F.try_element_at(F.col("depths"), e["key"]).cast("bigint").alias("depth"), e["value"]["message"].alias("m")))
    rows = walked.select("conversation_id", F.inline(entries))
    text = F.trim(F.array_join("m.content.parts", "\n"))
    return (rows.select("conversation_id", "depth", "node", F.col("m.author.role").alias("role"), F.col("m.content.content_type").alias("kind"), text.alias("text"))
            .where("role IN ('user', 'assistant') AND kind IN ('text', 'multimodal_text') AND text <> ''").drop("kind"))


def kv_conversations(kv: DataFrame) -> DataFrame:
    """Conversations in a key-value table: headers give the order; one missing bubble rejects all of it."""
    heads = (kv.where(F.col("key").startswith("composerData:") & F.col("value").isNotNull())
             .select(F.substring_index("key", ":", -1).alias("conv"), F.from_json("value", "fullConversationHeadersOnly array<struct<bubbleId:string>>").alias("h")))
    want = (tx.unnest(heads, ["conv"], F.col("h.fullConversationHeadersOnly"), "b", "pos")
            .select("conv", "pos", F.concat(F.lit("bubbleId:"), "conv", F.lit(":"), F.col("b.bubbleId")).alias("key")))
    rows = want.join(kv.where(F.col("key").startswith("bubbleId:")), "key", "left")
    whole = rows.groupBy("conv").agg(F.bool_and(F.col("value").isNotNull()).alias("whole")).where("whole").select("conv")
    m = F.from_json("value", "type int, text string")
    return (rows.join(whole, "conv", "left_semi")
            .select("conv", "pos", F.when(m["type"] == 1, "user").otherwise("assistant").alias("role"), m["text"].alias("text")))


MEMBER = re.compile(r"(?:[^/]+/)?conversations(?:-\d+)?\.json")  # fixed value


def archive_members(archives: DataFrame) -> DataFrame:
    """(path, member, body or null, error) of export members in zip archives; each member fails alone."""
    def scan(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if not MEMBER.fullmatch(name):
                                continue
                            try:
                                out.append((path, name, z.read(name).decode(), ""))
                            except Exception as e:  # one damaged member must not hide the others
                                out.append((path, name, None, type(e).__name__))
                except zipfile.BadZipFile:
                    out.append((path, "", None, "BadZipFile"))
            yield pd.DataFrame(out, columns=["path", "member", "body", "error"])
    return archives.select("path", "content").mapInPandas(scan, "path string, member string, body string, error string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)


def interactive(messages: DataFrame, key: str) -> DataFrame:
    """Keys with a user text and an assistant answer."""
    said = lambda role: F.bool_or((F.col("role") == role) & (F.trim("text") != ""))
    return messages.groupBy(key).agg(said("user").alias("u"), said("assistant").alias("a")).where("u AND a").select(key)


# -- notes, documents, labels, logs -------------------------------------------------------------------

def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), F.lit("^.*?" + re.escape(root.rstrip("/")) + "/"), F.lit(""))
    return markdown_notes(raw.select(rel.alias("path"), F.col("modificationTime").alias("mtime"), "content"))


def markdown_notes(files: DataFrame) -> DataFrame:
    """Notes with size and digest; hidden folders and ``templates/`` are left out."""
    keep = F.col("path").endswith(".md") & ~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").rlike(r"^templates/")
    return files.where(keep).withColumn("size", F.octet_length("content").cast("bigint")).withColumn("sha256", F.sha2("content", 256))


def plain_documents(df: DataFrame, text: str) -> DataFrame:
    """One text per document without NUL characters; empty ones are rejected."""
    clean = F.replace(text, F.lit("\0"), F.lit(""))
    return df.withColumn(text, clean).where(F.trim(text) != "")


CASE = "id string, question string, expect array<string>, split string, source string, overlap double"


def eval_cases(lines: DataFrame, value: str) -> DataFrame:
    """Labelled questions from JSONL; blank and comment lines are skipped, defaults filled in."""
    rows = lines.where((F.trim(value) != "") & ~F.trim(value).startswith("#")).select(F.from_json(value, CASE).alias("c")).select("c.*")
    group = F.coalesce(F.get("expect", F.lit(0)), F.col("question"))
    return rows.select(F.coalesce("id", F.substring(F.sha1("question"), 1, 8)).alias("id"), "question", F.coalesce("expect", F.array().cast("array<string>")).alias("expect"),
                       F.coalesce("split", tx.split_of(group)).alias("split"), F.coalesce("source", F.lit("fixture")).alias("source"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def recall_log(lines: DataFrame, value: str, now: str, days: int) -> DataFrame:
    """Log rows of the last days with status hit or miss; both time spellings are read."""
    rows = lines.select(F.from_json(value, "ts string, t string, kind string, status string, q string, ms bigint").alias("r")).select("r.*")
    at = F.coalesce(F.try_to_timestamp("ts"), F.try_to_timestamp(F.concat("t", F.lit("Z"))))
    end = F.to_timestamp(F.lit(now))
    return rows.withColumn("at", at).where((F.col("at") >= end - F.expr(f"INTERVAL {days} DAYS")) & F.col("status").isin("hit", "miss"))
