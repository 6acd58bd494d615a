"""Token ids in binary shards: one zstandard dictionary for all, one frame per document.

A shard is a folder with three Parquet tables, so it lies on any file system that Spark writes to:

* ``blocks``: up to ``BLOCK_DOCS`` documents or ``BLOCK_BYTES`` bytes a row: the frames one after the other
  (``payload``), each document's id, number of ids and end of its frame (the offset index), the ids
  before the block inside its part, and the SHA-256 of the dictionary that the frames need;
* ``parts``: the ids before each part (parts follow the order of the documents);
* ``dictionary``: the dictionary under its SHA-256, and the width of an id in bytes.

A frame is the little-endian ids of one document, compressed by itself with the shared dictionary, so a
short document is read without touching its neighbours.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.tables import place, strings, width

BLOCK_DOCS, BLOCK_BYTES = 4096, 1 << 20
# The dictionary is trained on a bounded sample: so many documents of at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 2000, 20_000, 64 << 10
CACHED_WORDS, CACHED_PARTS = 800_000, 150_000
LEVEL = 3


# Words that the tokenizer's model can take by themselves: Latin letters, then closing marks.
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([,.!?;:]*)")
PROBES = ["word", "Word,", "Été.", "straße!?", "NIÑO;", "x", "Antidisestablishment:", "öäüß..."]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: itself if it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Numbers(dict):
    """Numbers words in the order in which they are first asked for; ``new`` holds those not yet encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of whole texts. Pieces between blanks or line ends are encoded once and remembered.

    The tokenizer never joins characters across white space, so the ids of a text are those of its
    pieces in order. Simple words go to the tokenizer's model directly, which spares most of the time of a call, if
    the probes come out the same both ways. The memory is emptied when it holds ``CACHED_WORDS`` pieces, and
    lives as long as the Python worker, see ``encoder``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.letters = _byte_letters()
        self.clear()
        self.simple = all(self._short(*SIMPLE.fullmatch(p).groups()) == ids for p, ids in zip(PROBES, self._full(PROBES)))

    def clear(self) -> None:
        self.known = Numbers()
        self.parts: dict[str, list[int]] = {}
        self.used, self.starts, self.counts, self.flat = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _full(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _short(self, word: str, marks: str) -> list[int]:
        word = word.lower()
        ids = self.parts.get(word)
        if ids is None:
            seen = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = self.parts[word] = [t.id for t in self.tokenizer.model.tokenize(seen)]
        if not marks:
            return ids
        end = self.parts.get(marks)
        if end is None:
            end = self.parts[marks] = [t.id for t in self.tokenizer.model.tokenize(marks)]
        return ids + end

    def _learn(self) -> None:
        words, self.known.new = self.known.new, []
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        ids: list[list[int]] = []
        rest = []
        for w in words:
            m = SIMPLE.fullmatch(w) if self.simple else None
            ids.append(self._short(m[1], m[2]) if m else [])
            if not m:
                rest.append(len(ids) - 1)
        for k, found in zip(rest, self._full([words[k] for k in rest])):
            ids[k] = found
        first, n = len(self.known) - len(words), len(words)
        counts = np.fromiter(map(len, ids), np.int64, n)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
        grown = lambda old, used, new: old if used + new <= len(old) else np.concatenate([old[:used], np.zeros(used + 2 * new, old.dtype)])
        self.starts, self.counts, self.flat = grown(self.starts, first, n), grown(self.counts, first, n), grown(self.flat, self.used, len(flat))
        self.starts[first:first + n] = self.used + np.cumsum(counts) - counts
        self.counts[first:first + n] = counts
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 256):
            if len(self.known) > CACHED_WORDS:
                self.clear()
            split = [(t or "").replace("\n", " ").split(" ") for t in texts[at:at + 256]]
            every = list(chain.from_iterable(split))
            rows = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
            if self.known.new:
                self._learn()
            counts = self.counts[rows]
            ends = np.cumsum(counts)
            ids = self.flat[np.repeat(self.starts[rows] - ends + counts, counts) + np.arange(ends[-1])]
            last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
            yield from np.split(ids, ends[last[:-1] - 1])


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file: workers are used again by later tasks, and so is what they know."""
    held = vars(sys.modules.setdefault("_memlake_worker", types.ModuleType("_memlake_worker")))
    return held.get(path) or held.setdefault(path, Encoder(path))


def _ids(known: Encoder, texts: list[str | None], end_id: int, kind: np.dtype) -> Iterator[bytes]:
    for ids in known.encode(texts):
        yield np.append(ids, end_id).astype(kind).tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> bytes:
    """Dictionary over the serialized ids of the sample: the documents first by a hash of their key.

    The hash is cut off first, over the keys alone, so that only the sample's texts are moved.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_ids(known, strings(b.column("text")), end_id, np.dtype(kind))), pa.binary())], names=["ids"])

    hashed = docs.withColumn("h", F.xxhash64(F.lit("sample"), "key"))
    last = hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    sample = hashed.where((F.col("h") <= F.lit(last)) & (F.length("text") <= SAMPLE_CHARS)).limit(SAMPLE_DOCS)
    samples = sorted(r.ids for r in sample.select("text").mapInArrow(work, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the sample itself is the dictionary
        return b"".join(samples)[:DICT_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _bounds(docs: DataFrame, parts: int) -> np.ndarray:
    cuts = F.percentile_approx("key", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(max(10_000, 20 * parts)))
    found = docs.agg(cuts.alias("c")).first().c if parts > 1 else None
    return np.array(sorted(set(found or [])), np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
          order: Column | None = None) -> None:
    """Encode every text of ``docs`` and write the shard folder ``path``, in ascending ``order``.

    ``order`` is a bigint column, by default the id. Null keys come first. Rows with equal keys
    follow their number of ids, then their frames. A null or empty text is the end id alone. Other
    columns are not read. No documents give an empty shard.
    """
    spark = docs.sparkSession
    key = F.col(f"`{id_col}`") if order is None else order
    rows = docs.select(key.cast("bigint").alias("key"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = "<u2" if Encoder(tokenizer).size <= 1 << 16 and end_id < 1 << 16 else "<u4"
    data = train_dictionary(rows, tokenizer, end_id, kind)
    sha = hashlib.sha256(data).digest()
    parts = width(spark)
    bounds = _bounds(rows, parts)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data))
        for b in batches:
            keys = b.column("key").to_pylist()
            part = np.searchsorted(bounds, [np.iinfo(np.int64).min if k is None else k for k in keys], "left")
            counts, packed = [], []
            for ids in _ids(known, strings(b.column("text")), end_id, np.dtype(kind)):
                counts.append(len(ids) // np.dtype(kind).itemsize)
                packed.append(packer.compress(ids))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column("key"), b.column("id"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                                             names=["part", "key", "id", "n", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part, docs_, counts, ends, payload = 0, None, [], [], [], bytearray()
        names = ["part", "before", "n_tokens", "first_id", "last_id", "ids", "counts", "ends", "payload", "dictionary"]

        def block() -> pa.RecordBatch:
            nonlocal before, docs_, counts, ends, payload
            known = [d for d in docs_ if d is not None]
            row = [[part], [before], [sum(counts)], [min(known, default=None)], [max(known, default=None)], [docs_], [counts], [ends], [bytes(payload)], [sha]]
            before += sum(counts)
            docs_, counts, ends, payload = [], [], [], bytearray()
            long = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int32(), *[pa.int64()] * 4, long, long, long, pa.binary(), pa.binary()])], names=names)

        for b in batches:
            for p, i, n, frame in zip(b.column("part").to_pylist(), b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("frame").to_pylist()):
                if docs_ and (p != part or len(docs_) >= BLOCK_DOCS or len(payload) + len(frame) > BLOCK_BYTES):
                    yield block()
                if p != part:
                    part, before = p, 0
                payload += frame
                docs_.append(i)
                counts.append(n)
                ends.append(len(payload))
        if docs_:
            yield block()

    schema = ("part int, before bigint, n_tokens bigint, first_id bigint, last_id bigint, ids array<bigint>, counts array<bigint>, "
              "ends array<bigint>, payload binary, dictionary binary")
    (rows.mapInArrow(frames, "part int, key bigint, id bigint, n bigint, frame binary")
     .repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("key").asc_nulls_first(), "n", "frame")
     .select("part", "id", "n", "frame").mapInArrow(pack, schema)
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    spark.createDataFrame([(bytearray(sha), bytearray(data), kind)], "dictionary binary, data binary, kind string").coalesce(1).write.parquet(f"{path}/dictionary")
    # One row per part, of which there are as many as shuffle partitions.
    totals = sorted(map(tuple, spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens")).collect()))
    starts, before = [], 0
    for part, n in totals:
        starts.append((part, before))
        before += n
    spark.createDataFrame(starts, "part int, part_start bigint").coalesce(1).write.parquet(f"{path}/parts")


def _decoded(spark: SparkSession, path: str, blocks: DataFrame, wanted: list[int] | None) -> DataFrame:
    held = spark.read.parquet(f"{path}/dictionary").first()
    sha, data, kind = bytes(held.dictionary), bytes(held.data), held.kind
    if hashlib.sha256(data).digest() != sha:
        raise ValueError("the dictionary does not match its hash")
    only = None if wanted is None else set(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for b in batches:
            for row in range(b.num_rows):
                if b.column("dictionary")[row].as_py() != sha:
                    raise ValueError("a block was written with another dictionary")
                payload = memoryview(b.column("payload")[row].as_buffer())
                ids, counts, ends = (b.column(c)[row].as_py() for c in ("ids", "counts", "ends"))
                starts = b.column("start")[row].as_py() + np.cumsum([0, *counts])[:-1]
                pick = [k for k in range(len(ids)) if only is None or ids[k] in only]
                texts = [np.frombuffer(unpacker.decompress(payload[ends[k - 1] if k else 0:ends[k]]), kind).astype("<u4").tobytes() for k in pick]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in pick], pa.int64()), pa.array(starts[pick], pa.int64()), pa.array([counts[k] for k in pick], pa.int64()), pa.array(texts, pa.binary())],
                    names=["id", "start", "n_tokens", "ids"])

    parts = spark.read.parquet(f"{path}/parts")  # at most one row per shuffle partition of the writer
    return (blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("before"))
            .select("start", "ids", "counts", "ends", "payload", "dictionary")
            .mapInArrow(work, "id bigint, start bigint, n_tokens bigint, ids binary"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids): every document of a shard folder; ids as little-endian 32-bit numbers."""
    return _decoded(spark, path, spark.read.parquet(f"{path}/blocks"), None)


def fetch(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The documents with these ids. Blocks are chosen by their id range, frames by the offset index."""
    if not ids:
        return read(spark, path).where(F.lit(False))
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("last_id") >= min(ids)) & (F.col("first_id") <= max(ids)))
    return _decoded(spark, path, blocks, ids)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, order: Column | None = None) -> DataFrame:
    """Write a shard in the shared folder and read it back."""
    path = place(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, id_col, text_col, end_id, order)
    return read(docs.sparkSession, path)
