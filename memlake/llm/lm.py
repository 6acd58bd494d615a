"""Stupid-backoff language-model scores of documents against the corpus's own n-gram counts.

Words are A-Z lower-cased runs of anything but ASCII white space, and every word counts as itself.
Bigrams (the first word of a document follows a start mark) are exploded from every document, dealt to
partitions, counted there and summed per document:

    S(w | v) = c(v w) / c(v)                 if c(v w) >= MIN_COUNT
             = BACKOFF * c(w) / tokens       else

The head of the vocabulary, words that make up at least ``1 / HEAD_WORDS`` of all tokens, is numbered and
broadcast with its counts. All other words are known by 62 bits of their hash; words that share these bits with
another word go to the head, so a key is one word.

Documents are worked on in pieces. A piece asks for the count of each of its bigrams once, however many of its
documents hold it: bigrams of two head words are dealt to partitions by a one-to-one mix of their numbers, all others by
their rare word (the first one if both are rare), with the number of times that the piece holds the word. A rare word has less
than ``tokens / HEAD_WORDS`` occurrences, so no partition is large by it. The partitions send the counts back in the order of
the request, and the piece, kept as word numbers, sums its documents. So what is shuffled does not grow with the number of
partitions that a document's bigrams are dealt to.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import stored, width

MAX_WORDS = 1 << 20
HEAD_WORDS = 1 << 20  # bounds what is broadcast; scores do not depend on it
MIN_COUNT, BACKOFF = 2, 0.4
PART_TOKENS = 4_000_000  # exploded n-grams that one partition counts
SHIFT = 21  # bits of a word number
RARE = 1 << 62  # keys of rare words are not smaller
KEY_BITS, SEED = 62, 42
DOCS, HEAD, ODD = range(3)  # a piece's documents as word numbers; its bigrams of the head; its rare words with their bigrams
BEFORE = 1 << SHIFT + 1  # marks the other word of a rare word's bigram if it stands before it
COUNT_ROWS = 4000  # texts whose words are added up at once
PIECE_BYTES = 8 << 20  # bytes of text in a piece; a longer text is one of its own


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


class Keys(dict):
    """Numbers of the head's words; any other word gets its hash, or zero where rare words are folded."""

    def __init__(self, words: list[bytes], folded: bool, bits: int):
        super().__init__(zip(words, range(1, len(words) + 1)))
        self.folded, self.mask = folded, (1 << bits) - 1

    def __missing__(self, word: bytes) -> int:
        return 0 if self.folded else xxhash.xxh64_intdigest(word, SEED) & self.mask | RARE


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each place in that order) of equal rows; the last key counts most."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def _times(times: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Sum of ``times`` over the rows with equal keys, for each row."""
    order, group = _groups(*keys)
    out = np.zeros(len(times))
    out[order] = np.bincount(group, weights=times[order])[group] if len(times) else 0
    return out


def _packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers, or the steps of rising ones, byte plane by byte plane under zstandard."""
    steps = np.diff(values, prepend=0) if rising else values
    planes = np.ascontiguousarray(steps, np.int64).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).view(np.int64).reshape(n)
    return np.cumsum(values) if rising else values


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _mixed(grams: np.ndarray) -> np.ndarray:
    """Numbers of 2 * SHIFT bits, spread over that range one to one."""
    low, half = np.uint64((1 << 2 * SHIFT) - 1), np.uint64(SHIFT)
    x = grams.astype(np.uint64)
    with np.errstate(over="ignore"):
        for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
            x = (x ^ x >> half) * np.uint64(odd) & low
    return (x ^ x >> half).astype(np.int64)


def _cells(keys: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, slice]]:
    """(partition, place) of rising keys of ``bits`` bits, cut into equal ranges."""
    part = (keys >> max(bits - 31, 0)) * parts >> min(bits, 31)
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(part))):
        yield int(part[lo]), slice(int(lo), int(hi))


class Bigrams:
    """The distinct bigrams of a piece, in an order that depends on its word numbers only.

    ``words`` holds the numbers of head words and RARE + i for the piece's i-th rare word, by key. ``head`` rises; ``word``
    and ``code`` (the other word) rise together. ``head_at`` and ``odd_at`` tell which of them each bigram is.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, start: int):
        self.first, self.second = np.empty_like(words), words
        self.first[1:] = words[:-1]
        self.first[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
        begins, ends = self.first >= RARE, words >= RARE
        self.odd = begins | ends
        first, second, begins = self.first[self.odd], words[self.odd], begins[self.odd]
        self.head, self.head_at, self.head_n = np.unique(_mixed(self.first[~self.odd] << SHIFT | words[~self.odd]), return_inverse=True, return_counts=True)
        word, code = np.where(begins, first, second) - RARE, np.where(begins, second, first | BEFORE)
        order, group = _groups(code, word)
        self.odd_at = np.empty_like(group)
        self.odd_at[order] = group
        at = order[np.flatnonzero(np.diff(group, prepend=-1))]
        self.word, self.code, self.odd_n = word[at], code[at], np.bincount(group)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word: binary, n): counts over all texts, added up per task batch before they are shuffled."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, COUNT_ROWS):
                seen: Counter = Counter()
                for t in b.column(0).slice(at, COUNT_ROWS):
                    seen.update(_words(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return (docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(work, "word binary, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int | None = None, head_words: int | None = None) -> DataFrame:
    """(id, n_tokens, log_score): one row per row of ``docs``; ``log_score`` sums the natural logs.

    Null and blank texts have no tokens and score zero. Null ids and repeated rows are kept (copies count
    as often as they occur). Other columns are not read. ``head_words`` bounds the broadcast and changes no
    score. Only where ``max_words`` is given, words below ``1 / max_words`` of all tokens share one unknown word.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    counts = stored(word_counts(base, "text"), "words")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    folded, bits = max_words is not None, KEY_BITS
    least = max(1, math.ceil(tokens / (max_words if folded else head_words or HEAD_WORDS)))
    head = counts.where(F.col("n") >= least)
    if not folded:
        # Words with one key: N^2 / 2^63 of N words are expected, none below a billion. Spark's hash of bytes is XXH64 too.
        rare = counts.where(F.col("n") < least).withColumn("key", F.xxhash64("word").bitwiseAND(F.lit((1 << bits) - 1)))
        shared = rare.groupBy("key").agg(F.count(F.lit(1)).alias("words")).where("words > 1")
        head = head.unionByName(rare.join(F.broadcast(shared), "key", "left_semi").drop("key"))
    vocabulary = head.orderBy(F.desc("n"), "word").toArrow()  # head_words rows, and the few that share a key
    words, known = vocabulary.column("word").to_pylist(), vocabulary.column("n").to_numpy()
    starts = base.where(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]")).count()
    # 0: unknown word, 1..: the vocabulary, last: start of a document.
    uni = np.concatenate([[tokens - known.sum()], known, [starts]]).astype(np.int64)
    sent = spark.sparkContext.broadcast((words, uni))
    parts = max(width(spark), math.ceil(tokens / PART_TOKENS))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uni = sent.value
        key = Keys(words, folded, bits).__getitem__
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy().astype(np.int64))
            at = 0
            while at < b.num_rows:
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + PIECE_BYTES, "right")))
                yield ask(b.slice(at, end - at), key, len(uni) - 1, task << 32 | number)
                at, number = end, number + 1

    def ask(docs: pa.RecordBatch, key: Callable[[bytes], int], start: int, piece: int) -> pa.RecordBatch:
        lines = [np.fromiter(map(key, ws), np.int64, len(ws)) for ws in (_words(t.as_py()) for t in docs.column("text"))]
        sizes, flat = np.fromiter(map(len, lines), np.int64, len(lines)), _joined(lines)
        odd = flat >= RARE
        rare, at, n = np.unique(flat[odd] ^ RARE, return_inverse=True, return_counts=True)
        flat[odd] = at + RARE
        found = Bigrams(flat, sizes, start)
        ids = docs.column("id")
        out = [(piece % parts, piece, DOCS, _packed(flat), _packed(sizes), _packed(ids.fill_null(0).to_numpy()), _packed(ids.is_null().to_numpy(False).astype(np.int64)), b"")]
        for part, cut in _cells(found.head, 2 * SHIFT, parts):
            out.append((part, piece, HEAD, _packed(found.head[cut], True), _packed(found.head_n[cut]), b"", b"", b""))
        grams = np.bincount(found.word, minlength=len(rare))
        ends = np.concatenate([[0], np.cumsum(grams)])
        code = found.code
        code[code >= RARE] = rare[code[code >= RARE] - RARE] | RARE
        for part, cut in _cells(rare, bits, parts):
            own = slice(int(ends[cut.start]), int(ends[cut.stop]))
            out.append((part, piece, ODD, _packed(rare[cut], True), _packed(n[cut]), _packed(grams[cut]), _packed(code[own]), _packed(found.odd_n[own])))
        return batch(out)

    columns = ("keys", "times", "grams", "codes", "gram_times")
    schema = "part int, piece bigint, kind tinyint, " + ", ".join(f"{c} binary" for c in columns)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int8(), *[pa.binary()] * len(columns)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "piece", "kind", *columns])

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(c.to_pylist() for c in b.columns))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {HEAD: [], ODD: []}
        for b in batches:
            for row in rows(b):
                if row[2] == DOCS:
                    yield batch([row])
                else:
                    held[row[2]].append(row)
        for kind, asked in held.items():
            keys, times = [_unpacked(r[3], True) for r in asked], _joined([_unpacked(r[4]) for r in asked])
            _, at = np.unique(_joined(keys), return_inverse=True)
            seen = np.bincount(at, weights=times).astype(np.int64)[at] if len(at) else at
            if kind == ODD:
                grams = [_unpacked(r[5]) for r in asked]
                codes, own = _joined([_unpacked(r[6]) for r in asked]), np.repeat(at, _joined(grams))
                gram_seen = _times(_joined([_unpacked(r[7]) for r in asked]), codes, own).astype(np.int64)
            end = gram_end = 0
            for i, (part, piece, *_) in enumerate(asked):
                answer, end = seen[end:end + len(keys[i])], end + len(keys[i])
                more = b""
                if kind == ODD:
                    size = int(grams[i].sum())
                    more, gram_end = _packed(gram_seen[gram_end:gram_end + size]), gram_end + size
                yield batch([(part, piece, kind, _packed(answer), more, b"", b"", b"")])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = sent.value[1]
        held: dict[int, tuple[list, list, list]] = {}
        for b in batches:
            for part, piece, kind, *data in rows(b):
                held.setdefault(piece, ([], [], []))[kind].append((part, *data))
        for piece in list(held):
            (docs,), *answers = held.pop(piece)
            flat, sizes, ids, nulls = map(_unpacked, docs[1:5])
            head, odd = (sorted(a) for a in answers)
            found = Bigrams(flat, sizes, len(uni) - 1)
            rare_n = _joined([_unpacked(a[1]) for a in odd])

            def total(words: np.ndarray) -> np.ndarray:
                rare = words >= RARE
                n = np.empty(len(words), np.int64)
                n[~rare], n[rare] = uni[words[~rare]], rare_n[words[rare] - RARE]
                return np.maximum(n, 1)

            seen = np.empty(len(flat), np.int64)
            seen[~found.odd] = _joined([_unpacked(a[1]) for a in head])[found.head_at]
            seen[found.odd] = _joined([_unpacked(a[2]) for a in odd])[found.odd_at]
            value = np.where(seen >= MIN_COUNT, np.log(seen) - np.log(total(found.first)), math.log(BACKOFF) + np.log(total(flat)) - math.log(max(tokens, 1)))
            sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=value, minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(sizes), pa.array(sums, pa.float64())], names=["id", "n_tokens", "log_score"])

    return (base.mapInArrow(explode, schema).repartitionById(parts, F.col("part")).mapInArrow(count, schema)
            .repartition(parts, "piece").mapInArrow(merge, "id bigint, n_tokens bigint, log_score double"))
