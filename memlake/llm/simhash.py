"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes of all word shingles. To find every
pair within ``radius`` bits, each bit position gets a non-zero vector of ``radius + 1`` bits. For each
of the ``2^(radius+1) - 1`` non-zero vectors v there is one table whose mask keeps the positions with
odd inner product with v. The vectors of up to ``radius`` differing positions do not span the space, so
some v is orthogonal to all of them: that table's mask hides all differences and the pair collides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from memlake.llm.blocking import cells, linked
from memlake.llm.components import components
from memlake.llm.tables import stored

BITS, SEED = 64, 42
CELL = 4096


def fingerprint(text: bytes | None, words: int) -> int:
    """Bitwise majority over the hashes of the word shingles; zero if there is no word."""
    tokens = (text or b"").lower().split()  # bytes: A-Z, and white space of ASCII only
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    found = np.fromiter([digest(line[s:e], SEED) for s, e in zip(starts[:last].tolist(), ends[words - 1:].tolist())], np.uint64, last)
    total = np.zeros(BITS, np.int64)
    for at in range(0, last, 1 << 16):
        bits = np.unpackbits(found[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > last, bitorder="little").view(np.uint64)[0])


def masks(radius: int) -> list[int]:
    """One mask per non-zero vector of ``radius + 1`` bits, as signed 64-bit numbers."""
    out = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i in range(BITS) if (v & (1 + i % (2 ** (radius + 1) - 1))).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text_hash, fp): one row per row of ``docs``; fp is the fingerprint as bigint."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(fps.view(np.int64))],
                                             names=["id", "text_hash", "fp"])

    return rows.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, "id bigint, text_hash bigint, fp bigint")


def close_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning forest of the links between different fingerprints (column fp)."""
    distinct = prints.select("fp").distinct()
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks(radius))])
    keys = (distinct.select("fp", F.explode(tables).alias("k"))
            .select(F.col("k.t").alias("t"), F.col("fp").bitwiseAND(F.col("k.m")).alias("key"), "fp"))

    def check(table: pa.Table):
        fp = table.column("fp").to_numpy().view(np.uint64)

        def judge(a, b):
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            return near, np.zeros(len(a), bool)

        return judge

    found = linked(cells(keys, ["t", "key"], "fp", CELL), ["t", "key"], "fp", None, check)
    return found.select(F.col("member").alias("a"), F.col("root").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, text_hash, fp, class_fp, component_id): groups of rows whose fingerprints are linked.

    Rows with equal fingerprints form one class; classes link at ``radius`` or fewer differing bits.
    ``class_fp`` names the group (its smallest fingerprint), ``component_id`` is the smallest id in
    it. Null and blank texts have fingerprint zero. A null id is kept, and is the smallest of a
    group only where the group has no other. Repeated rows stay. Other columns are not touched.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    groups = components(close_pairs(prints, radius))
    classes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    named = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("class_fp"))
    # Stored on both sides, so that a group with a third of all fingerprints is a join that Spark can split.
    named = stored(named, "simhash-named")
    lows = stored(named.groupBy("class_fp").agg(F.min("low").alias("component_id")), "simhash-lows")
    labels = stored(named.join(lows, "class_fp").select("fp", "class_fp", "component_id"), "simhash-classes")
    return prints.join(labels, "fp").select("id", "text_hash", "fp", "class_fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id (null last).

    Rows with equal id and equal text in one group are told apart by nothing, so one of them stays.
    """
    found = near_duplicates(docs, id_col, text_col, words, radius)
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    kept = found.groupBy("class_fp").agg(F.min(rank).alias("k")).select(F.col("k.id").alias("__kid"), F.col("k.text_hash").alias("__khash"))
    wide = (docs.withColumn("__id", F.col(f"`{id_col}`").cast("bigint"))
            .withColumn("__hash", F.xxhash64(F.col(f"`{text_col}`").cast("binary"))))
    first = W.partitionBy("__id", "__hash").orderBy(F.lit(1))
    return (wide.join(kept.distinct(), F.col("__id").eqNullSafe(F.col("__kid")) & F.col("__hash").eqNullSafe(F.col("__khash")), "left_semi")
            .withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns]))
