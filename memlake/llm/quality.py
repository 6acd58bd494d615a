"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, linear hinge loss.

Features are hashed indicators of word uni- and bigrams and of shape uni-, bi- and trigrams (a shape is
the word with runs of upper case, lower case and digits folded, marked where the word repeats
the one before it). The ratio of each indicator's smoothed share in good and bad texts scales it; rows are brought
to length one; dual coordinate descent fits the hinge loss; margins of rows left out of a first fit
calibrate a logistic score. The fit sees a bounded, hashed sample of the labelled rows
(``per_class`` of each label); the score is computed for every row from its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F, types as T

from memlake.llm.tables import stored, strings

DIM = 1 << 18
PER_CLASS = 3000
COST, EPOCHS = 1.0, 12
CACHED_WORDS = 300_000
FOLDS = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "0")]


def shape(word: str) -> str:
    for pattern, fold in FOLDS:
        word = pattern.sub(fold, word)
    return word[:12]


class Features:
    """Hashed indicators of a text. Words are looked up once; the memory is emptied when it is full."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.hashes = np.zeros((0, 2), np.uint64)

    def _learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known, self.hashes, new = {}, self.hashes[:0], sorted(words)
        end = len(self.known) + len(new)
        if end > len(self.hashes):  # room for twice as many, so that rows are not moved for every text
            self.hashes = np.concatenate([self.hashes[:len(self.known)], np.zeros((2 * end - len(self.known), 2), np.uint64)])
        if new:
            self.hashes[len(self.known):end] = [(xxhash.xxh64_intdigest(w, 1), xxhash.xxh64_intdigest(shape(w), 2)) for w in new]
        self.known.update(zip(new, range(len(self.known), end)))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        try:
            rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            self._learn(set(words))
            rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        word, form = self.hashes[rows].T.copy()
        with np.errstate(over="ignore"):
            form[1:] += (word[1:] == word[:-1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            k = np.uint64(0xD6E8FEB86659FD93)
            pairs, shapes = word[:-1] * k + word[1:], form[:-1] * k + form[1:]
            every = np.concatenate([word, pairs * k + np.uint64(1), form + np.uint64(2), shapes * k + np.uint64(3), (shapes[:-1] * k + form[2:]) * k + np.uint64(4)])
            every ^= every >> np.uint64(32)
            every *= k
        return np.unique((every >> np.uint64(64 - 18)).astype(np.int32)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``weights`` already hold the ratios; ``ratio2`` are their squares, for the row lengths."""

    weights: np.ndarray
    ratio2: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = np.sqrt(self.ratio2[found].sum())
        return self.bias + (self.weights[found].sum() / length if length else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -500, 500))))


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of each indicator in good rows over that in bad rows."""
    counts = [1 + np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, g in zip(rows, good) if g == side)]), minlength=DIM) for side in (True, False)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def descend(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, weight: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with a bias; ``weight`` scales each row's cost."""
    y = np.where(good, 1.0, -1.0)
    # A row's values are worked out when it is looked at: stored, they would take as much of the driver as all rows do.
    length = [np.sqrt((ratio[r] ** 2).sum()) or 1.0 for r in rows]
    value = lambda i: ratio[rows[i]] / length[i]
    squares = np.array([value(i) @ value(i) for i in range(len(rows))]) + 1
    alpha, w, bias = np.zeros(len(rows)), np.zeros(DIM), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            mine = value(i)
            gradient = y[i] * (w[rows[i]] @ mine + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), COST * weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * mine
                bias += step
                alpha[i] = new
    return w * ratio, bias


def calibrate(margins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps with a small ridge."""
    a = weight[good].sum() + 1
    b = weight[~good].sum() + 1
    target = np.where(good, a / (a + 1), 1 / (b + 1))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-6), float(theta[1])


def fit(rows: list[np.ndarray], good: np.ndarray, share: float) -> Model:
    """Model from sampled rows; ``share`` is the share of good rows among all labelled rows.

    With rows of one label only the score is that label's smoothed share; with none it is one half.
    """
    flat = np.zeros(DIM)
    if not len(rows) or good.all() or not good.any():
        p = (good.sum() + 1) / (len(rows) + 2) if len(rows) else 0.5
        return Model(flat, flat, 0.0, 1.0, float(np.log(p / (1 - p))))
    weight = np.where(good, share / good.mean(), (1 - share) / (1 - good.mean()))
    held = np.arange(len(rows)) % 4 == 0
    part = lambda keep: ([r for r, k in zip(rows, keep) if k], good[keep], weight[keep])
    margins, slope, offset = None, 4.0, 0.0
    some, other = part(~held)[1], good[held]
    if some.any() and not some.all() and other.any() and not other.all():
        tried, g, _ = part(~held)
        ratio = ratios(tried, g)
        w, bias = descend(tried, g, ratio, np.ones(len(g)))
        first = Model(w, ratio ** 2, bias, 1.0, 0.0)
        margins = np.array([first.margin(r) for r in part(held)[0]])
        slope, offset = calibrate(margins, good[held], weight[held])
    ratio = ratios(rows, good)
    w, bias = descend(rows, good, ratio, np.ones(len(good)))
    return Model(w, ratio ** 2, bias, slope, offset)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled rows of each label that are not held out.

    Rows are taken in the order of a hash of their id. Of the rows with one id and one text one counts, and
    further texts of an id come after the first of every id, so at most ``per_class`` rows of each label reach
    the driver however often an id occurs. Null ids, null labels and labels other than 0 and 1 are no labels.
    """
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
             .where("id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("id"))))
    total = dict(map(tuple, known.groupBy("y").count().collect()))
    order = F.xxhash64("id")
    pick = [known.where(F.col("y") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    sample = pick[0].unionByName(pick[1])  # 2 * per_class rows at most
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    named = texts.select("id", "hash").join(F.broadcast(sample), "id").distinct()
    nth = F.row_number().over(W.partitionBy("id", "y").orderBy("hash"))
    ranked = stored(named.withColumn("nth", nth).where(F.col("nth") <= per_class), "labelled")
    take = [ranked.where(F.col("y") == y).orderBy("nth", order, "id", "hash").limit(per_class) for y in (0, 1)]
    chosen = take[0].unionByName(take[1]).drop("nth")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen = Features(), set()  # copies go: of 2 * per_class rows at most each task gives one
        for b in batches:
            b = b.set_column(b.schema.get_field_index("id"), "id", b.column("id").cast(pa.int64()))
            new = []
            for k, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "y", "hash")))):
                if row not in seen:
                    seen.add(row)
                    new.append(k)
            b = b.take(pa.array(new, pa.int64()))
            found = [features(t).astype("<i4").tobytes() for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), b.column("hash"), pa.array(found, pa.binary())], names=["id", "y", "hash", "found"])

    got = (texts.join(F.broadcast(chosen), ["id", "hash"]).select("id", "y", "hash", "text")
           .mapInArrow(work, "id bigint, y int, hash bigint, found binary").dropDuplicates(["id", "y", "hash"]).toArrow())
    rows = sorted(zip(got.column("id").to_pylist(), got.column("y").to_pylist(), got.column("found").to_pylist()), key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r))
    del got
    good = np.array([r[1] == 1 for r in rows], bool)
    share = total.get(1, 0) / max(1, sum(total.values()))
    rows.reverse()
    return fit([np.frombuffer(rows.pop()[2], "<i4").astype(np.int64) for _ in range(len(rows))], good, share)  # each row is let go as it is read


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, from the whole text of each row. Null and empty texts are scored too.

    A column that already has this name is replaced; all others, repeated rows included, pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.ratio2, model.bias, model.slope, model.offset))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    at = rows.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, held = Features(), Model(*sent.value)
        for b in batches:
            score = pa.array([held.score(features(t)) for t in strings(b.column(at))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score], names=[*b.schema.names, name])

    return rows.mapInArrow(work, schema)
