"""URL filters: a Bloom filter cascade over the corpus's hosts, and host/path rules above it.

Level 0 holds the listed keys. Every other key of the universe that passes it by chance goes into
level 1, every listed key that passes level 1 by chance into level 2, and so on until a level lets
nothing wrong through. A key of the universe is then listed exactly if the first level that rejects it
has an odd number. The universe is every host of the corpus with all its parent domains, so
membership is exact for every row without a join.

A level has a fixed share of set bits, so the filters grow with the listed keys only: about
``BITS_PER_KEY`` bits each plus a shrinking tail. Their size is checked against ``max_bytes`` before
they are broadcast; a longer list must be split by the caller into several filters, one pass each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import ascii_lower, stored

HASHES = 4
BITS_PER_KEY = 12
MAX_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path written together; it fits the host, its subdomains and longer paths."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host_col: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    parts = F.split(host_col, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    return F.when(host_col != "", every).otherwise(F.array().cast("array<string>"))


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes.astype(np.int64).view(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _spots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit positions in a level, by double hashing of the two hashes of each key: (keys, HASHES)."""
    with np.errstate(over="ignore"):
        start, step = _mixed(keys[:, 0], level), _mixed(keys[:, 1], level) | np.uint64(1)
        return (start[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _passes(held: np.ndarray, bits: int, level: int, keys: np.ndarray) -> np.ndarray:
    spots = _spots(keys, level, bits)
    return ((held[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class Cascade:
    """The levels, as (bits, bytes) pairs, which is what is sent to the executors."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels

    @property
    def size(self) -> int:
        return sum(len(b) for _, b in self.levels)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys (rows of two hashes) are listed; exact for keys of the universe."""
        listed = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for level, (bits, held) in enumerate(self.levels):
            open_ = open_[_passes(held, bits, level, keys[open_])]
            listed[open_] = level % 2 == 0
        return listed


def _hashes(key: Column) -> list[Column]:
    """Two independent hashes: keys that share one still differ in the other, so levels come to an end."""
    return [F.xxhash64(key), F.xxhash64(F.lit(1), key)]


def _pair(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column("h").to_numpy(), b.column("g").to_numpy()], axis=1)


def _level(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """The bytes of a filter of ``bits`` bits over ``keys`` (h, g): set bits per task, merged by word."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = np.zeros(0, np.uint64)
        for b in batches:
            spots = np.unique(np.concatenate([spots, _spots(_pair(b), level, bits).ravel()]))
        yield pa.RecordBatch.from_arrays([pa.array((spots >> np.uint64(6)).astype(np.int64)), pa.array((spots & np.uint64(63)).astype(np.int32))], names=["word", "bit"])

    words = (keys.mapInArrow(work, "word bigint, bit int").groupBy("word")
             .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("w")))
    out = np.zeros(-(-bits // 64), np.int64)
    for batch in words.toArrow().to_batches():  # at most one row per 64 bits of the checked size
        out[batch.column("word").to_numpy()] = batch.column("w").to_numpy()
    return out.view(np.uint8)


def build(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade:
    """Cascade that tells, for every key of ``universe``, whether it is in ``listed`` (both: key string).

    Null keys are no keys. Listed keys outside the universe are left out: nothing will ask for them.
    Each level is one pass over the keys that the level before let through wrongly.
    """
    marked = (universe.select("key", F.lit(0).alias("on"), F.lit(1).alias("seen"))
              .unionByName(listed.select("key", F.lit(1).alias("on"), F.lit(0).alias("seen"))).where("key IS NOT NULL")
              .groupBy("key").agg(F.max("on").alias("on"), F.max("seen").alias("seen")).where("seen = 1")
              .select(_hashes(F.col("key"))[0].alias("h"), _hashes(F.col("key"))[1].alias("g"), "on"))
    keys = stored(marked, "url-keys")
    inside, outside = keys.where("on = 1").select("h", "g"), keys.where("on = 0").select("h", "g")
    levels: list[tuple[int, np.ndarray]] = []
    while True:
        n = inside.count()
        if not n:
            return Cascade(levels)
        level = len(levels)
        bits = max(64, n * BITS_PER_KEY)
        if sum(len(b) for _, b in levels) + bits // 8 > max_bytes:
            raise ValueError(f"filters of {n} keys pass max_bytes={max_bytes}; split the list")
        held = _level(inside, level, bits)
        levels.append((bits, held))
        sent = keys.sparkSession.sparkContext.broadcast((bits, held))

        def wrong(batches: Iterator[pa.RecordBatch], level=level, sent=sent) -> Iterator[pa.RecordBatch]:
            bits, held = sent.value
            for b in batches:
                yield b.filter(pa.array(_passes(held, bits, level, _pair(b))))

        through = stored(outside.mapInArrow(wrong, "h bigint, g bigint"), "url-keys")
        inside, outside = through, inside


def in_list(hosts: Column, cascade: Cascade, spark) -> Column:
    """Whether any of the keys in the array column is listed."""
    sent = spark.sparkContext.broadcast(cascade.levels)

    @F.arrow_udf("boolean")
    def has(arrays: pa.Array) -> pa.Array:
        sizes = np.diff(arrays.offsets.to_numpy()) // 2
        found = Cascade(sent.value).has(arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return pa.array(np.bincount(rows[found], minlength=len(sizes)) > 0)

    return has(F.flatten(F.transform(hosts, lambda k: F.array(*_hashes(k)))))


def judge(pages: DataFrame, id_col: str, url_col: str, listed: DataFrame, rules: list[Rule], max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict): one row per row of ``pages``.

    The longest fitting rule decides (of equally long ones, the first by text); else a listed host or
    parent domain (``listed``: key) means block, anything else allow. Null urls and urls without
    ``://`` have empty host and path, fit nothing and are allowed. Repeated rows are judged alike.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    split = base.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    universe = split.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))
    cascade = build(universe, listed.select(F.col("key").cast("string").alias("key")), max_bytes)
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path)) for r in ordered]
    first = lambda pick: F.coalesce(*[F.when(f, F.lit(pick(r))) for f, r in zip(fits, ordered)], F.lit(None).cast("string"))
    bad = in_list(suffixes(F.col("host")), cascade, pages.sparkSession)
    return (split.withColumn("rule", first(lambda r: r.text)).withColumn("__by_rule", first(lambda r: r.verdict)).withColumn("__bad", bad)
            .select("id", "host", "path", "rule", F.coalesce("__by_rule", F.when(F.col("__bad"), "block").otherwise("allow")).alias("verdict")))
