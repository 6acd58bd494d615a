"""Windows over texts: best passage for a question, raw windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from memlake.functions import fixed, text as tx


FRONT = re.compile(r"---\n.*?(?:\n---[ \t]*(?:\n|\Z)|\Z)", re.S)
# Runs of lines that hold a visible character and do not begin a comment; line ends belong to their line.
PARAGRAPH = re.compile(r"(?:^(?!\s*<!--)[^\S\n]*\S[^\n]*(?:\n|\Z))+", re.M | re.A)


PIECE_BYTES = 1 << 20  # bytes of text whose paragraphs a Python task holds at once, besides the batch that it was sent


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of ``texts`` with at most ``PIECE_BYTES`` each, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > PIECE_BYTES:
            yield texts.slice(start, at - start)
            start, held = at, 0
        held += size
    yield texts.slice(start)


def _cut(texts: pa.Array) -> pa.Array:
    starts, ends, found, offsets = [], [], [], []
    for text in texts.to_pylist():
        offsets.append(None if text is None else len(found))
        if text is None:
            continue
        front = FRONT.match(text)
        for m in PARAGRAPH.finditer(text, front.end() if front else 0):
            starts.append(m.start())
            ends.append(m.end())
            found.append(m[0])
    items = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())], ["start", "end", "text"])
    return pa.ListArray.from_arrays(pa.array([*offsets, len(found)], pa.int32()), items)


@F.arrow_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("text", T.StringType())))
def _paragraphs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """(start, end, text) of the paragraphs of each text after its frontmatter: one pass, linear in the text.

    A batch has up to 10,000 rows however long they are; its paragraphs go back in small pieces.
    """
    for texts in batches:
        for piece in _pieces(texts):
            yield _cut(piece)


def select_passage(df: DataFrame, keys: list[str], text: str, question: str, limit: int = 260, lines: bool = True) -> DataFrame:
    """Best window of every (text, question) row: most overlapping terms, later start on ties.

    One row per key in; windows are exploded and reduced again by ``max_by``, which combines on the
    map side, so only one candidate per task and key is shuffled. ``lines`` adds line anchors, for which
    the texts are read once more.
    """
    limit = max(40, min(limit, 4000))
    stride = max(20, limit * 3 // 4)
    base = df.select(*keys, F.col(text).alias("__text"),
                     tx.term_set(F.col(question), 64).alias("__terms"))
    paras = tx.unnest(base.select(*keys, "__terms", _paragraphs(F.col("__text")).alias("__p"), F.sha2("__text", 256).alias("revision"),
                                  ), [*keys, "__terms", "revision"], F.col("__p"), "p")
    spots = F.sequence(F.lit(0), F.greatest(F.length("p.text"), F.lit(1)) - 1, F.lit(stride))
    wins = (tx.unnest(paras, [*keys, "__terms", "revision", "p"], spots, "o")
            .select(*keys, "__terms", "revision", (F.col("p.start") + F.col("o")).cast("bigint").alias("start_char"),
                    F.least(F.col("p.end"), F.col("p.start") + F.col("o") + limit).cast("bigint").alias("end_char"),
                    F.substr(F.col("p.text"), F.col("o") + 1, F.lit(limit)).alias("raw"))
            )
    wins = tx.hold(wins, tx.clean(F.col("raw"), limit).alias("passage")).where(
        (F.length("passage") >= 40) & ~F.col("passage").rlike(fixed.FIELD_ONLY))
    wins = tx.hold(wins, tx.term_set(F.col("raw"), 128).alias("words"))
    overlap = F.array_intersect("__terms", "words")
    score = F.aggregate(overlap, F.lit(0.0), lambda a, w: a + 1 + F.least(F.length(w), F.lit(20)) / 20)
    scored = wins.withColumn("score", F.round(score, 6))
    pick = F.max_by(F.struct("passage", "start_char", "end_char", "score", "revision"), F.struct("score", "start_char"))
    best = scored.groupBy(*keys).agg(pick.alias("b")).select(*keys, "b.*")
    if not lines:
        return best
    line = lambda at: (F.size(F.split(F.substr(F.col("__text"), F.lit(1), at.cast("int")), "\n"))).cast("bigint")
    return (best.join(base.select(*keys, "__text"), keys)
            .withColumn("start_line", line(F.col("start_char"))).withColumn("end_line", line(F.col("end_char"))).drop("__text"))


def tokens(c):
    return F.array_distinct(tx.find_all(F.lower(c), fixed.TOKEN))


def raw_windows(df: DataFrame, keys: list[str], text: str, question: str, size: int = 512) -> DataFrame:
    """Fixed windows of every line with their header and token overlap with the question."""
    base = df.select(*keys, F.split(text, "\n").alias("__ls"), tokens(F.col(question)).alias("__q"))
    lines = tx.unnest(base, [*keys, "__q"], F.col("__ls"), "l", "sequence").where("l <> ''")
    spots = F.sequence(F.lit(0), F.length("l") - 1, F.lit(size))
    wins = (tx.unnest(lines, [*keys, "__q", "sequence", "l"], spots, "o")
            .select(*keys, "__q", (F.col("sequence") - 1).alias("sequence"), F.col("o").cast("bigint").alias("start"),
                    F.substr(F.col("l"), F.col("o") + 1, F.lit(size)).alias("body")))
    header = F.format_string("[raw observation %d, characters %d:%d]\n", F.col("sequence"), F.col("start"), F.col("start") + F.col("n_chars"))
    return (wins.withColumn("n_chars", F.length("body").cast("bigint"))
            .withColumn("score", F.size(F.array_intersect("__q", tokens(F.col("body")))).cast("bigint"))
            .withColumn("part", F.concat(header, F.col("body"))).drop("__q"))
