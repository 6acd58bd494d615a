import math
import random
from collections import Counter

from memlake.llm import lm
from tests.llm.helpers import docs


def brute(table, max_words):
    words = [(d, (t or "").encode().lower().split()) for d, t in table]
    counts = Counter(w for _, ws in words for w in ws)
    n = sum(counts.values())
    known = {w for w, c in counts.items() if c >= max(1, math.ceil(n / max_words))}
    lines = [(d, [w if w in known else None for w in ws]) for d, ws in words]
    uni = Counter(w for _, ws in lines for w in ws)
    uni["start"] = sum(1 for _, ws in lines if ws)
    bi = Counter(p for _, ws in lines for p in zip(["start", *ws], ws))
    s = lambda v, w: math.log(bi[v, w] / uni[v]) if bi[v, w] >= 2 else math.log(0.4 * uni[w] / n)
    return sorted([(d is not None, d or 0, len(ws), round(sum(s(v, w) for v, w in zip(["start", *ws], ws)), 6)) for d, ws in lines])


def got(df, **options):
    return sorted((r.id is not None, r.id or 0, r.n_tokens, round(r.log_score, 6)) for r in lm.scores(df, **options).collect())


def test_equals_brute_force(spark):
    table = [(i, f"the cat {i % 5} sat on\tThe mat number{i} . " * (i % 4)) for i in range(200)] + [(300, None), (301, " \n"), (None, "the cat sat"), (None, None), (5, "the cat"), (5, "the cat"), (302, "the cat " * 20_000)]
    for max_words in (lm.MAX_WORDS, 20):
        assert got(docs(spark, table, clash=True), max_words=max_words) == brute(table, max_words)


def test_nothing(spark):
    assert got(docs(spark, [])) == []
    assert got(docs(spark, [(1, None), (2, "")])) == [(True, 1, 0, 0.0), (True, 2, 0, 0.0)]


def test_rare_words_count_as_themselves(spark):
    """No word is folded, in a corpus that passes MAX_WORDS tokens and with any size of the broadcast head."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(50)]
    table = [(i, " ".join(rng.choices(common, k=4000))) for i in range(280)]
    rare = [[f"r{i}-{k}" for k in range(6)] for i in range(40)]
    table += [(1000 + i, " ".join(r)) for i, r in enumerate(rare)] + [(2000 + i, " ".join([*r[:3], "c1", *r[:2]])) for i, r in enumerate(rare[:20])]
    assert sum(len(t.split()) for _, t in table) > lm.MAX_WORDS
    want = brute(table, 1 << 60)
    assert got(docs(spark, table)) == want
    small = table[270:] + [(5, "c1 r0-0"), (5, "c1 r0-0"), (None, "r0-0 r0-1")]
    for head in (1, 40, 400):
        assert got(docs(spark, small), head_words=head) == brute(small, 1 << 60)


def test_words_that_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(lm, "KEY_BITS", 5)
    table = [(i, f"a b w{i % 25} w{i % 7} x{i}") for i in range(60)]
    assert got(docs(spark, table), head_words=5) == brute(table, 1 << 60)


def shuffled(spark):
    sc = spark.sparkContext
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_shuffle_does_not_grow_with_partitions(spark, monkeypatch):
    """A document's bigrams go to many partitions; what is written for them stays below the texts."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(3000)]
    table = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(3000)], k=400))) for i in range(300)]
    monkeypatch.setattr(lm, "PART_TOKENS", 1000)
    before = shuffled(spark)
    assert got(docs(spark, table).coalesce(1)) == brute(table, 1 << 60)
    moved = shuffled(spark) - before
    assert 0 < moved < 1.5 * sum(len(t) for _, t in table)


def test_pieces_of_any_size(spark, monkeypatch):
    """Long texts, texts without words and null ids at the borders of pieces; rare and frequent words on both sides."""
    table = [(1, None), (2, "a b a b"), (None, "a x1 x2 b"), (3, "b " * 500 + "x1 x2"), (4, ""), (None, None), (5, "x3 a x1 x2"), (5, "x3 a x1 x2")]
    for size in (1, 12, 1 << 20):
        monkeypatch.setattr(lm, "PIECE_BYTES", size)
        for head in (1, 4, 1 << 20):
            assert got(docs(spark, table).coalesce(1), head_words=head) == brute(table, 1 << 60)
