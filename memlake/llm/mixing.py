"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a hashed order, are cut into blocks of equal mass (characters). Block i of a source
with weight w may be placed from slot floor(i / w) on and must be placed before slot ceil((i + 1) / w). Earliest
deadline first meets all these windows, so at every slot each source is less than one block away from
its share. Windows follow the weights as given, in whole numbers without rounding. Where the weights are whole
slots of a period, one period is scheduled once and the slot of any block follows by arithmetic; else
the windows run over the whole phase and the plan holds a row per block (not per row of the input). When a source runs
out, a new phase begins with the weights of those left: every row is placed, none is repeated.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from memlake.llm.tables import width
from memlake.session import broadcast_if_small

PERIOD = 1000  # slots in a period that is repeated if the weights are whole slots of it
MAX_SOURCES = 256  # bounds the plan, which is broadcast
BLOCK_CHARS = 20_000
BUCKET_ROWS = 20_000


def whole(weights: dict) -> dict:
    """The weights as whole numbers in exactly their proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*parts.values())
    return {s: q // common for s, q in parts.items()}


def quotas(weights: dict, period: int) -> dict:
    """Whole slots per period in proportion to ``weights`` (largest remainders); one for a source that would get none."""
    parts = whole(weights)
    total = sum(parts.values())
    none = {s for s, q in parts.items() if q * period < total}
    while more := {s for s in parts if s not in none and parts[s] * (period - len(none)) < sum(q for t, q in parts.items() if t not in none)}:
        none |= more  # the rest shares what is left
    rest = {s: q for s, q in parts.items() if s not in none}
    free, total = period - len(none), sum(rest.values())
    out = dict.fromkeys(none, 1) | {s: q * free // total for s, q in rest.items()}
    short = sorted(rest, key=lambda s: (-(rest[s] * free % total), str(s)))[:period - sum(out.values())]
    return out | {s: out[s] + 1 for s in short}


def dealt_slots(parts: dict) -> Iterator:
    """The source of each slot without end, for whole-number weights: earliest deadline first among released blocks."""
    total = sum(parts.values())
    waiting = [(0, str(s), 0, s) for s in parts]
    heapq.heapify(waiting)
    ready: list = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, name, i, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // parts[s]), name, i, s))
        deadline, name, i, s = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        yield s
        t += 1
        heapq.heappush(waiting, ((i + 1) * total // parts[s], name, i + 1, s))


def one_period(slots: dict, period: int) -> dict[object, list[int]]:
    """The slots of each source's blocks in one period."""
    out: dict[object, list[int]] = {s: [] for s in slots}
    for t, s in zip(range(period), dealt_slots(slots)):
        out[s].append(t)
    return out


def one_phase(parts: dict, left: dict) -> tuple[dict[object, list[int]], int]:
    """The slots of each source's blocks until one source has placed its ``left`` blocks, and their number."""
    out: dict[object, list[int]] = {s: [] for s in parts}
    for t, s in enumerate(dealt_slots(parts)):
        out[s].append(t)
        if len(out[s]) == left[s]:
            return out, t + 1
    raise AssertionError("slots have no end")


def plan(blocks: dict, weights: dict, period: int = PERIOD) -> tuple[list[tuple], list[tuple], int]:
    """(phases, slots, total): ``phases`` are (source, phase, first, last, quota, base), ``slots`` (phase, source, nth, slot)."""
    left, placed = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    phases, slots, base, phase = [], [], 0, 0
    while left:
        active = {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1)
        parts = whole(active)
        if period % sum(parts.values()):
            table, length = one_phase(parts, left)
            use = quota = {s: len(t) for s, t in table.items()}
        else:
            quota = {s: q * period // sum(parts.values()) for s, q in parts.items()}
            table = one_period(quota, period)
            length = min((left[s] - 1) // quota[s] * period + table[s][(left[s] - 1) % quota[s]] + 1 for s in active)
            use = {s: length // period * quota[s] + bisect_left(table[s], length % period) for s in active}
        for s in active:
            used = use[s]
            if used:
                phases.append((s, phase, placed[s], placed[s] + used, quota[s], base))
                slots += [(phase, s, n, t) for n, t in enumerate(table[s])]
                placed[s] += used
                left[s] -= used
                if not left[s]:
                    del left[s]
        base += length
        phase += 1
    return phases, slots, base


def _names(source: str) -> Column:
    """Source with a name for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-"))


def placed(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", block_chars: int = BLOCK_CHARS, period: int = PERIOD, seed: int = 17) -> tuple[DataFrame, int]:
    """(``docs`` with __chars, __start, __block, __slot, __hash; number of slots).

    ``__start`` is the characters before the row in its source, ``__block`` its block, ``__slot`` the block's
    place in the mixture; sorted by slot and hash the rows are mixed. Without ``weights`` a source
    weighs the square root of its characters. A source without a weight, or of weight zero, comes after all
    others; null is a source of its own. Null and empty texts have no mass and are placed too. A
    row longer than a block takes the place of its first block and leaves the blocks it fills without
    others. More than ``MAX_SOURCES`` sources are refused.
    """
    spark = docs.sparkSession
    sized = (docs.withColumn("__source", _names(source_col)).withColumn("__chars", F.coalesce(F.length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("bigint"))
             .withColumn("__hash", F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))))
    total = sized.groupBy("__source").agg(F.sum("__chars").alias("chars"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(total) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    blocks = {r["__source"]: max(1, math.ceil(r.chars / block_chars)) for r in total}
    given = {r["__source"]: math.sqrt(r.chars) for r in total} if weights is None else {"-" if s is None else f"={s}": w for s, w in weights.items()}
    phases, slots, length = plan(blocks, given, period)

    # Running mass in two levels: inside buckets of the hash, and over the buckets of a source.
    bits = max(8, math.ceil(math.log2(max(1, max((r.n for r in total), default=1) / BUCKET_ROWS))))
    rows = sized.withColumn("__bucket", F.shiftrightunsigned("__hash", 64 - bits))
    unsigned = F.col("__hash").bitwiseXOR(F.lit(-(1 << 63)))  # sorts as an unsigned number
    inner = W.partitionBy("__source", "__bucket").orderBy(unsigned, F.col(f"`{id_col}`")).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("__source", "__bucket").agg(F.sum("__chars").alias("__sum"))
    outer = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("__source", "__bucket", F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__base"))
    dealt = (rows.withColumn("__before", F.coalesce(F.sum("__chars").over(inner), F.lit(0))).join(bases, ["__source", "__bucket"])
             .withColumn("__start", F.col("__base") + F.col("__before")))
    last = F.create_map(*[F.lit(x) for s, n in blocks.items() for x in (s, n - 1)]) if blocks else F.lit(None).cast("map<string,int>")
    # Rows without mass at the very end would begin a block more.
    dealt = dealt.withColumn("__block", F.least((F.col("__start") / block_chars).cast("bigint"), last[F.col("__source")].cast("bigint")))
    phase = spark.createDataFrame(phases, "__source string, __phase int, __first bigint, __last bigint, __quota bigint, __from bigint")
    kinds = [("__phase", pa.int32()), ("__source", pa.string()), ("__nth", pa.int64()), ("__offset", pa.int64())]
    slot = spark.createDataFrame(pa.table({c: pa.array(v, k) for (c, k), v in zip(kinds, zip(*slots) if slots else [()] * 4)}))
    # Phases are bounded by MAX_SOURCES; the slots have up to a row per block, so they are broadcast only if they are few.
    joined = (dealt.join(F.broadcast(phase), ["__source"]).where("__block >= __first AND __block < __last")
              .withColumn("__nth", (F.col("__block") - F.col("__first")) % F.col("__quota"))
              .join(broadcast_if_small(slot), ["__phase", "__source", "__nth"])
              .withColumn("__slot", F.col("__from") + F.floor((F.col("__block") - F.col("__first")) / F.col("__quota")) * period + F.col("__offset")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__chars", "__start", "__block", "__slot", "__hash"), length


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """``docs`` in mixture order: partitions follow each other, and rows inside them.

    Slots hold equal mass, so equal ranges of slots make even partitions without sampling. All rows
    and columns are kept.
    """
    rows, length = placed(docs, weights, **options)
    parts = width(docs.sparkSession)
    part = F.floor(F.col("__slot") * parts / max(1, length)).cast("int")
    return (rows.repartitionById(parts, part).sortWithinPartitions("__slot", F.col("__hash").bitwiseXOR(F.lit(-(1 << 63))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
