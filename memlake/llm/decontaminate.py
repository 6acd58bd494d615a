"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers' bit-parallel distance.

An item may occur in a text with ``k`` edits, ``k`` being a share of its length. It is halved again and again,
the budget split so that an occurrence within the budget leaves one half within its own; ``k + 1`` pieces
without budget are left. One automaton finds all exact hits of all pieces in one pass over a text. A hit
climbs from its piece to the item: each ancestor must occur around the hit within its budget, so
chance hits end after some twenty characters and none within the budget is lost.

Items are compared in blocks of bounded size, one pass over the documents each; only a block is sent
to the executors. Texts and items are compared lower-cased with white space as single blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from memlake.llm.tables import strings

EDITS = 0.1
BLOCK_CHARS = 1_000_000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """A piece of an item with its budget, for Myers' algorithm: one bit per character, any length."""

    def __init__(self, text: str, start: int, budget: int, above: Pattern | None):
        self.text, self.start, self.budget, self.above = text, start, budget, above
        self.masks: dict[str, int] | None = None

    def distance(self, window: str) -> tuple[int, int]:
        """(least edit distance to a substring of ``window``, where the first such substring ends)."""
        if self.masks is None:
            self.masks = {}
            for i, c in enumerate(self.text):
                self.masks[c] = self.masks.get(c, 0) | 1 << i
        full = (1 << len(self.text)) - 1
        top = 1 << len(self.text) - 1
        up, down, score, best, end, masks = full, 0, len(self.text), len(self.text), 0, self.masks
        for at, c in enumerate(window, 1):
            same = masks.get(c, 0)
            across = (((same & up) + up) ^ up) | same
            rise = down | full & ~(across | up)
            fall = up & across
            if rise & top:
                score += 1
            elif fall & top:
                score -= 1
                if score < best:
                    best, end = score, at
            rise <<= 1
            same |= down
            up = fall << 1 & full | full & ~(same | rise)
            down = rise & same
        return best, end


class Items:
    """The pieces of a block of items and the automaton over them."""

    def __init__(self, items: list[tuple[int, str]], edits: float):
        leaves: dict[str, list[tuple[int, Pattern]]] = {}
        self.roots: list[tuple[int, Pattern]] = []
        for item_id, text in items:
            root = Pattern(text, 0, int(len(text) * edits), None)
            self.roots.append((item_id, root))
            for leaf in self._halve(root):
                leaves.setdefault(leaf.text, []).append((len(self.roots) - 1, leaf))
        self.found = list(leaves.values())
        self.automaton = ahocorasick.Automaton()
        for n, word in enumerate(leaves):
            self.automaton.add_word(word, n)
        if leaves:
            self.automaton.make_automaton()

    def _halve(self, p: Pattern) -> Iterator[Pattern]:
        if not p.budget:
            yield p
            return
        left = (p.budget - 1) // 2
        cut = round(len(p.text) * (left + 1) / (p.budget + 1))
        yield from self._halve(Pattern(p.text[:cut], p.start, left, p))
        yield from self._halve(Pattern(p.text[cut:], p.start + cut, p.budget - 1 - left, p))

    def hits(self, text: str, first_only: bool = False) -> dict[int, tuple[int, int]]:
        """Item number -> (distance, end in ``text``) of its closest occurrence within the budget."""
        out: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}  # where each item was last found
        if not self.found:
            return out
        for last, n in self.automaton.iter(text):
            for item, leaf in self.found[n]:
                shift = last + 1 - len(leaf.text) - leaf.start  # where the item would begin
                root = self.roots[item][1]
                if item in done and abs(shift - done[item]) <= root.budget:
                    continue
                p = leaf
                while p.above:
                    p = p.above
                    # The item is looked for twice as far, so that hits nearby need no second look.
                    room = p.budget if p.above else 2 * p.budget
                    low = max(0, shift + p.start - room)
                    found, end = p.distance(text[low:shift + p.start + len(p.text) + room])
                    if found > p.budget:
                        break
                else:
                    if p is leaf:
                        found, low, end = 0, 0, last + 1
                    done[item] = shift
                    out[item] = min(out.get(item, (found, low + end)), (found, low + end))
                    if first_only:
                        return out
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, normalized, in blocks of at most ``block_chars`` characters (or one item)."""
    rows = (items.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
            .where("text IS NOT NULL").orderBy("id", "text"))
    block: list[tuple[int, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        text = plain(r.text)
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        if text:
            block.append((r.id, text))
            size += len(text)
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
            item_text: str = "text", edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, distance, end_char): each row of ``docs`` with each item that occurs in it.

    An item occurs where a substring of the normalized text is within ``int(edits * length)`` edits. The
    closest place is reported, by its distance and its end in the normalized text. Null and blank
    texts hold nothing, null and blank items occur nowhere. Repeated rows and items each report.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "id bigint, item_id bigint, distance int, end_char int"
    out = spark.createDataFrame([], schema)
    for block in blocks(items, item_id, item_text, block_chars):
        sent = spark.sparkContext.broadcast(block)  # block_chars at most

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Items(sent.value, edits)
            for b in batches:
                found = [(i, known.roots[n][0], d, e) for i, t in zip(b.column("id").to_pylist(), strings(b.column("text"))) if t
                         for n, (d, e) in sorted(known.hits(plain(t)).items())]
                columns = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])],
                                                 names=["id", "item_id", "distance", "end_char"])

        out = out.unionByName(rows.mapInArrow(work, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
          edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns, in one pass per block and without a shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    schema = T.StructType(list(docs.schema.fields))
    for block in blocks(items, item_id, item_text, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Items(sent.value, edits)
            for b in batches:
                yield b.filter(pa.array([not t or not known.hits(plain(t), first_only=True) for t in strings(b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(work, schema)
    return docs
