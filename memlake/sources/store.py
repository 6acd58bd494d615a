"""Sinks and stored artefacts: chunk store, manifests, receipts, run history, idempotent upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from memlake.functions.text import json_string
from memlake.operators.ordered import null_safe, running

def count_rows():
    return F.count(F.lit(1))


def missing_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks to write: each (scope, revision) once, and only when it is not stored yet."""
    return chunks.join(stored, ["scope", "revision"], "left_anti").dropDuplicates(["scope", "revision"])


def write_chunks(chunks: DataFrame, stored: DataFrame, manifest: DataFrame, root: str) -> None:
    """Append the missing chunks, then the manifest, so that a manifest never names an absent chunk."""
    missing_chunks(chunks, stored).write.mode("append").partitionBy("scope").parquet(f"{root}/chunks")
    manifest.write.mode("append").parquet(f"{root}/manifests")


def verify(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every manifest entry against the bytes at hand, with the reason of a mismatch."""
    have = chunks.select("scope", "idx", F.sha2("body", 256).alias("h"), F.octet_length("body").cast("bigint").alias("b"),
                         (F.length(F.regexp_replace("body", "[^\n]", "")) + F.when(F.col("body").endswith("\n"), 0).otherwise(1)).cast("bigint").alias("l"))
    j = manifest.join(have, ["scope", "idx"], "full_outer")
    reason = (F.when(F.col("revision").isNull(), "unlisted chunk").when(F.col("h").isNull(), "missing chunk").when(F.col("h") != F.col("revision"), "hash mismatch")
              .when(F.col("b") != F.col("bytes"), "size mismatch").when(F.col("l") != F.col("lines"), "line mismatch").otherwise("ok"))
    return j.select("scope", "idx", reason.alias("reason"))


def offsets(manifest: DataFrame, key: str) -> DataFrame:
    """1-based first line of every chunk."""
    r = running(manifest, [key], ["idx"], F.floor(F.col("idx") / 10_000), {"__before": ("sum", F.col("lines"), False)})
    return r.withColumn("start_line", F.col("__before") + 1).drop("__before")


def locate(lines: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Chunk and local line of global lines. Lines and chunk starts are merged in one ordered pass."""
    starts = segments.select(key, F.col("start_line").alias("line"), F.lit(0).alias("kind"), F.struct("idx", "start_line").alias("seg"))
    asked = lines.select(key, "line", F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["seg"].dataType).alias("seg"))
    r = running(starts.unionByName(asked), [key], ["line", "kind"], F.floor(F.col("line") / 10_000), {"at": ("last", F.col("seg"), True)})
    return r.where("kind = 1").select(key, "line", F.col("at.idx").alias("idx"), (F.col("line") - F.col("at.start_line") + 1).alias("local_line"))


def identity(*parts: Column) -> Column:
    """sha256 of the compact canonical JSON list of texts."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[json_string(p) for p in parts]), F.lit("]")), 256)


def receipt_fault(r: dict[str, Column]) -> Column:
    """Why a publication receipt does not hold; null when it does."""
    pub = identity(r["source"], r["session_id"], r["logical_id"], r["logical_revision"])
    return (F.when(~F.coalesce(r["session_id"].rlike(r"^[A-Za-z0-9_-]{1,200}$"), F.lit(False)), "session")
            .when(~r["logical_revision"].rlike("^[0-9a-f]{64}$"), "revision").when(pub != r["publication_id"], "publication id")
            .when(identity(r["source"], r["session_id"]) != r["stream"], "stream").when((r["ordinal"] < 1) | (r["ordinal"] > 2 ** 53), "ordinal")
            .when((identity(r["publication_id"], F.lit("UserPromptSubmit")) != r["first_id"]) | (identity(r["publication_id"], F.lit("Stop")) != r["last_id"]), "event pair")
            .when(r["first_ts"] >= r["last_ts"], "event order"))


def append_run(rows: DataFrame, root: str, detail: list[str]) -> None:
    """Append the run summary without row detail; keep the last run whole."""
    rows.drop(*detail).write.mode("append").parquet(f"{root}/history")
    rows.write.mode("overwrite").parquet(f"{root}/last")


UPSERT_BUCKETS = 256


def upsert(batch: DataFrame, root: str, key: str) -> None:
    """Apply a delivered batch once: operations already in the table change nothing.

    The table is kept in buckets of the operation's hash (column ``__bucket``); only the buckets that the batch touches
    are read. Rows without an operation id are one operation.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key]).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(UPSERT_BUCKETS)).cast("int"))
    rows.limit(0).write.mode("append").partitionBy("__bucket").parquet(root)  # adds no rows; the folder is there from now on
    touched = [r[0] for r in rows.select("__bucket").distinct().collect()]  # at most the number of buckets
    known = spark.read.schema(rows.schema).parquet(root).where(F.col("__bucket").isin(touched)).select(key, "__bucket")
    fresh = null_safe(rows, known, [key, "__bucket"], "left_anti")
    fresh.write.mode("append").partitionBy("__bucket").parquet(root)


def equivalent(first: DataFrame, second: DataFrame, key: str, line: str, text: str) -> DataFrame:
    """Per key: do both versions hold the same lines apart from their origins? Compared as digests per line."""
    h = lambda df, n: df.groupBy(key, line).agg(F.max(F.sha2(text, 256)).alias(n))
    j = h(first, "a").join(h(second, "b"), [key, line], "full_outer")
    return j.groupBy(key).agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("equivalent"))


def append_only_delta(old: DataFrame, new: DataFrame, key: str, line: str, text: str) -> DataFrame:
    """New lines when the old version is an unchanged prefix; all lines otherwise."""
    o = old.select(key, line, F.sha2(text, 256).alias("o"))
    n = new.select(key, line, F.sha2(text, 256).alias("n"))
    j = o.join(n, [key, line], "left")
    kept = j.groupBy(key).agg(F.bool_and(F.coalesce(F.col("o") == F.col("n"), F.lit(False))).alias("prefix"), F.max(line).alias("upto"))
    r = new.join(kept, key, "left")
    prefix = F.coalesce("prefix", F.lit(False))
    return r.where(~prefix | (F.col(line) > F.col("upto"))).select(key, line, F.when(prefix, "append-only-delta").otherwise("full-replay").alias("mode"))
