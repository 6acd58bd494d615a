import random
import tracemalloc
import zlib

import numpy as np
import pytest

from memlake.llm import quality
from memlake.llm.tables import read
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    table, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = quality.train(table, labels)
    got = {r.doc_id: r.score for r in quality.scored(table, model).select("doc_id", "score").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    right = sum((got[d] >= 0.7) == (q == 1) for d, q in truth.items())
    assert len(got) == 1000 and right >= 0.97 * len(truth) and all(0 <= s <= 1 for s in got.values())


def test_only_training_labels_count(spark):
    table, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.train(table, labels), quality.train(table, flipped)
    assert (a.weights == b.weights).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_dual_descent_reaches_the_optimum_of_the_hinge_loss(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 400)
    rng = np.random.default_rng(0)
    good = rng.random(60) < 0.5
    rows = [np.unique(rng.integers(0, 12, 5) + (6 if g and rng.random() < 0.8 else 0)) for g in good]
    ratio = quality.ratios(rows, good)
    w, bias = quality.descend(rows, good, ratio, np.ones(60))
    x = np.zeros((60, quality.DIM))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    x = np.concatenate([x[:, :20], np.ones((60, 1))], axis=1)
    y = np.where(good, 1, -1)
    plain = np.append(np.divide(w, ratio, out=np.zeros_like(w), where=ratio != 0)[:20], bias)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    best = plain.copy()
    for step in range(1, 4000):  # plain subgradient descent from there finds nothing better
        grad = best - ((y * (x @ best) < 1) * y) @ x
        best = best - grad / (50 + step)
        assert loss(best) >= loss(plain) - 1e-3


def test_odd_rows(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["calm", "words", "here", "and", "there"], k=30)) for _ in range(40)] + [" ".join(rng.choices(["BUY!!", "NOW!!", "WIN!!"], k=30)) for _ in range(40)]
    table = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (None, "calm words"), (0, texts[0]), (102, "x" * 200_000)]
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, table, clash=True).selectExpr("*", "'old' AS score")
    model = quality.train(df, labels)
    got = quality.scored(df, model)
    assert got.columns == df.columns and got.count() == len(table)
    scores = [(r.doc_id, r.score) for r in got.collect()]
    assert all(s > 0.7 for d, s in scores if d is not None and d < 40) and all(s < 0.5 for d, s in scores if d is not None and 40 <= d < 80)
    assert len({s for d, s in scores if d in (100, 101)}) == 1
    nothing = quality.train(df, labels.limit(0))
    assert {r.score for r in quality.scored(df, nothing).collect()} == {0.5}
    assert quality.scored(df.limit(0), model).count() == 0
    one = quality.train(df, labels.where("quality = 1"))
    assert len({r.score for r in quality.scored(df, one).collect()}) == 1


def test_memory_of_words_is_bounded(monkeypatch):
    texts = [" ".join(f"w{i}-{k}" for k in range(30)) for i in range(50)] * 2
    plain = [quality.Features()(t) for t in texts]
    monkeypatch.setattr(quality, "CACHED_WORDS", 64)
    small = quality.Features()
    assert all((small(t) == p).all() for t, p in zip(texts, plain)) and len(small.known) <= 64


@pytest.mark.parametrize("word,want", [("Hello,", "Aa,"), ("BUY!!", "A!!"), ("a1b22", "a0a0"), ("éÉ", "a"), ("***", "***")])
def test_shape(word, want):
    assert quality.shape(word) == want


def test_an_id_with_many_rows_stays_within_the_sample(spark, monkeypatch):
    given = []
    monkeypatch.setattr(quality, "fit", lambda rows, good, share: given.append((rows, good)))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    table = [(i, f"text number{i} of id{i}") for i in ids] + [(ids[0], f"hot text{k}") for k in range(400)] + [(ids[0], "copy")] * 400
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in ids], "doc_id bigint, quality int, toxic int")
    for per_class in (10, 100):
        quality.train(docs(spark, table, clash=True), labels, per_class=per_class)
        found, good = given.pop()
        side = good if ids[0] % 2 else ~good
        assert side.sum() == per_class and (~side).sum() == min(per_class, sum(i % 2 != ids[0] % 2 for i in ids))
        words = {quality.Features()(t).tobytes() for i, t in table if i != ids[0]}
        others = sum(r.tobytes() in words for r, s in zip(found, side) if s)
        assert others >= min(per_class, sum(i % 2 == ids[0] % 2 for i in ids)) - 1  # one text of each id comes first


def test_descent_holds_no_second_copy_of_the_rows():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, quality.DIM, 20_000)) for _ in range(60)]
    good = np.arange(60) % 2 == 0
    ratio = quality.ratios(rows, good)
    tracemalloc.start()
    quality.descend(rows, good, ratio, np.ones(60))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(r.nbytes for r in rows)
