"""Conversations as token ids with loss ranges, aligned by offsets.

A turn is written ``### role: text</turn>`` and a line end. Inside roles and texts a backslash goes before each
backslash, before a ``#`` that follows a ``#`` and between ``<`` and ``/turn>`` (in roles also between ``:`` and a blank),
so neither mark occurs there and taking the backslashes out gives the text again.

A conversation is rendered as a whole and encoded once, with offsets. The places of its assistant texts and the
offsets of its tokens are both sorted, so two binary searches per text give the tokens that touch it. A
token may reach over the edge of a text (a blank of the mark and the first word, say), so each range also
tells how many characters of its first token lie before the text and how long the text is.

A conversation above ``LONG`` bytes is ordered by range over several tasks and written in pieces of whole turns.
The line end before a mark always parts two tokens, so the ids of the pieces are those of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.tables import stored, strings, width
from memlake.session import broadcast_if_small

OPEN, HEAD, CLOSE = "### ", ": ", "</turn>\n"
LONG, PIECE = 16 << 20, 1 << 20  # bytes of a conversation that stays in one row; characters of a piece of a longer one
SEGMENT = 1 << 20  # characters that are encoded at once
LEARNED = "assistant"

_IN_TEXT = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)")
_IN_ROLE = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)|(?<=:) ")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
# Between a letter and a blank before a letter the tokenizer's words always part.
_CUT = re.compile("[A-Za-z](?= [A-Za-z])")


def escaped(text: str, rule: re.Pattern = _IN_TEXT) -> str:
    return rule.sub(r"\\\g<0>", text)


def plain(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the places of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escaped(role, _IN_ROLE) + HEAD, escaped(text)
        parts += head, body, CLOSE
        at += len(head)
        if role == LEARNED and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
    return "".join(parts), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) turns of a formatted text."""
    out, at = [], 0
    while at < len(text):
        head = text.index(HEAD, at + len(OPEN))
        end = text.index(CLOSE, head + len(HEAD))
        out.append((plain(text[at + len(OPEN):head]), plain(text[head + len(HEAD):end])))
        at = end + len(CLOSE)
    return out


class Coder:
    """A byte-level tokenizer, whose tokens cover every character. Strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def check(self) -> None:
        probe = " Two  words,\n\tÉté <|endoftext|> 漢字 ### "
        if self.text(self.encode([probe])[0][0]) != probe:
            raise ValueError("the tokenizer does not keep every character")

    def _segments(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > SEGMENT and (cut := _CUT.search(text, at + SEGMENT)):
            out.append(text[at:cut.end()])
            at = cut.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets: n x 2 characters) of each text; a long text goes in segments that part between words."""
        segments = [self._segments(t) for t in texts]
        found = iter(self.tokenizer.encode_batch([s for each in segments for s in each], add_special_tokens=False))
        out = []
        for each in segments:
            ids, offsets, at = [], [], 0
            for s in each:
                e = next(found)
                ids.append(np.array(e.ids, np.int32))
                offsets.append(np.array(e.offsets, np.int64).reshape(-1, 2) + at)
                at += len(s)
            out.append((np.concatenate(ids), np.concatenate(offsets)))
        return out

    def text(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def loss_ranges(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """(first, last, skip, chars) of each span: tokens first <= i < last touch it; the loss text is ``chars`` long after ``skip``."""
    if not spans or not len(offsets):
        return np.zeros((0, 4), np.int64)
    low, high = np.array(spans).T
    first = np.searchsorted(offsets[:, 1], low, side="right")
    last = np.searchsorted(offsets[:, 0], high, side="left")
    return np.stack([first, last, low - offsets[first, 0], high - low], axis=1)


RANGES = "array<struct<first:int,last:int,skip:int,chars:int>>"
SCHEMA = f"no_id boolean, conv bigint, piece bigint, whole boolean, n_turns bigint, ids array<int>, loss {RANGES}"
KEYS = ["no_id", "conv"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    no_id, conv, piece, whole, turns, ids, loss = zip(*rows)
    ends = lambda lists: pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
    flat = np.concatenate(loss).astype(np.int32)
    ranges = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], names=["first", "last", "skip", "chars"])
    return pa.RecordBatch.from_arrays(
        [pa.array(no_id), pa.array(conv, pa.int64()), pa.array(piece, pa.int64()), pa.array(whole), pa.array(turns, pa.int64()),
         pa.ListArray.from_arrays(ends(ids), pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(ends(loss), ranges)],
        names=["no_id", "conv", "piece", "whole", "n_turns", "ids", "loss"])


def formatted(rows: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
              long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(no_id, conv, piece, whole, n_turns, ids, loss): one row per conversation, or per piece of one above ``long`` bytes.

    Turns come by ``turn`` (nulls first), ties by role, then text (its first 64 characters, then a hash). Repeated rows are turns of
    their own. A null role or text is empty. Rows with a null conversation id are one conversation (``no_id``). Other
    columns are not read; an empty table gives none. A single text is held whole by one task.
    """
    Coder(tokenizer).check()
    turns = rows.select(F.col(f"`{conv_col}`").isNull().alias("no_id"), F.coalesce(F.col(f"`{conv_col}`").cast("bigint"), F.lit(0)).alias("conv"),
                        F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = [*KEYS, "turn", "role", F.left("text", F.lit(64)), F.xxhash64("text")]

    def render(cut: int | None):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, number = Coder(tokenizer), TaskContext.get().partitionId() << 32
            key, turns, size, n, waiting, weight = None, [], 0, 0, [], 0

            def close() -> int:
                nonlocal turns, size, n
                if turns:
                    waiting.append((*key, 0 if cut is None else number + n, len(turns), *rendered(turns)))
                    n += 1
                done, turns, size = size, [], 0
                return done

            def encoded() -> pa.RecordBatch:
                nonlocal waiting, weight
                found = coder.encode([w[4] for w in waiting])
                out = _batch([(no_id, conv, at, cut is None, count, ids, loss_ranges(offsets, spans))
                              for (no_id, conv, at, count, _, spans), (ids, offsets) in zip(waiting, found)])
                waiting, weight = [], 0
                return out

            for b in batches:
                columns = [b.column("no_id").to_pylist(), b.column("conv").to_pylist(), strings(b.column("role")), strings(b.column("text"))]
                for no_id, conv, role, text in zip(*columns):
                    if (no_id, conv) != key or cut and size >= cut:
                        weight += close()
                        key = no_id, conv
                        if weight >= SEGMENT:
                            yield encoded()
                    turns.append((role, text))
                    size += len(role) + len(text) + 16
            close()
            if waiting:
                yield encoded()

        return work

    parts = width(rows.sparkSession)
    large = stored(turns.groupBy(*KEYS).agg(F.sum(F.octet_length("role") + F.octet_length("text") + F.lit(16)).alias("size"))
                   .where(F.col("size") > long).select(*KEYS), "chat-long")
    if large.isEmpty():
        return turns.repartition(parts, *KEYS).sortWithinPartitions(*order).drop("turn").mapInArrow(render(None), SCHEMA)
    large = broadcast_if_small(large)
    short = turns.join(large, KEYS, "left_anti").repartition(parts, *KEYS).sortWithinPartitions(*order)
    # The last key only tells equal rows apart, so that a turn that is repeated any number of times is spread too.
    spread = [*order, F.monotonically_increasing_id()]
    ranged = turns.join(large, KEYS, "left_semi").repartitionByRange(parts, *spread).sortWithinPartitions(*order)
    return short.drop("turn").mapInArrow(render(None), SCHEMA).unionByName(ranged.drop("turn").mapInArrow(render(piece), SCHEMA))


def save(table: DataFrame, path: str) -> None:
    table.write.option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def with_mask(table: DataFrame) -> DataFrame:
    """``table`` with ``mask``, a boolean per token: true where the token touches an assistant's text."""
    places = F.when(F.size("ids") > 0, F.sequence(F.lit(0), F.size("ids") - 1)).otherwise(F.array().cast("array<int>"))
    return table.withColumn("mask", F.transform(places, lambda i: F.exists("loss", lambda r: (r["first"] <= i) & (i < r["last"]))))


def digests(table: DataFrame, tokenizer: str) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation, from ids and loss ranges alone.

    Whole conversations are read where they lie. Pieces of a longer one meet in one task in order, a piece
    at a time: a digest of a whole conversation can only be taken from its front to its end.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, key, held, out = Coder(tokenizer), None, None, []

        def flush() -> pa.RecordBatch:
            nonlocal out
            columns = list(zip(*out))
            out = []
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def end() -> None:
            if held:
                out.append((None if key[0] else key[1], held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]))

        for b in batches:
            no_id, conv, ids, loss = (b.column(c) for c in ("no_id", "conv", "ids", "loss"))
            for k in range(b.num_rows):
                if (mine := (no_id[k].as_py(), conv[k].as_py())) != key:
                    end()
                    key, held = mine, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    if len(out) >= 5000:
                        yield flush()
                row = ids[k].values.to_numpy()
                text = coder.text(row)
                held[4] += len(text)
                for role, said in parsed(text):
                    held[0] += 1
                    held[1].update(f"{role}\n{said}\n".encode())
                for r in loss[k].as_py():
                    said = plain(coder.text(row[r["first"]:r["last"]])[r["skip"]:r["skip"] + r["chars"]])
                    held[2] += len(said)
                    held[3].update(said.encode())
        end()
        if out:
            yield flush()

    schema = "id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    cut = table.where("not whole").repartition(width(table.sparkSession), *KEYS).sortWithinPartitions(*KEYS, "piece")
    return table.where("whole").mapInArrow(work, schema).unionByName(cut.mapInArrow(work, schema))
