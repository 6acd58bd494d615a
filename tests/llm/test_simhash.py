import itertools
import random

import xxhash
from pyspark.sql import functions as F

from memlake.llm import simhash
from memlake.llm.components import components
from tests.llm.helpers import docs, rows


def slow_print(text, words=4):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    grams = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    out = 0
    for bit in range(64):
        out |= (2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams)) << bit
    return out


def slow_components(ids, prints, radius=4):
    label = list(range(len(ids)))
    find = lambda i: i if label[i] == i else find(label[i])
    for a, b in itertools.combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            label[find(a)] = find(b)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


def sample_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)]
    for t in out[:20]:
        w = t.split()
        out += [" ".join(w[:-1]), t.upper(), t + " more", t.replace(" ", "\n\t")]
    return out + ["", "  \n", "É é", "one two three", "ONE two  three", "x" * 10_000]


def test_fingerprints_and_groups_equal_brute_force(spark):
    texts = sample_texts() + [None, "é A"]
    prints = [slow_print(t) for t in texts]
    want = slow_components(list(range(len(texts))), prints)
    got = simhash.near_duplicates(docs(spark, list(enumerate(texts)), clash=True)).select("id", "fp", "component_id").collect()
    assert len(got) == len(texts)
    assert {r.id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (p, c) for i, (p, c) in enumerate(zip(prints, want))}


def test_every_pair_within_the_radius_collides():
    rng = random.Random(1)
    tables = [m % (1 << 64) for m in simhash.masks(4)]
    assert len(tables) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not diff & m for m in tables)
    assert all(30 <= m.bit_count() <= 36 for m in tables)


def test_large_buckets_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 20)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(150)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.close_pairs(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 4)
    got = {r.node: r.component for r in components(edges).collect()}
    want = slow_components(signed, fps)
    assert [got.get(f, f) for f in signed] == want


def test_keep_one(spark):
    long = "a b c d e f g h"
    table = [(5, long), (3, long), (3, long), (None, long), (9, "other words stand in this text here"), (None, None), (None, ""), (2, "")]
    kept = simhash.keep_one(docs(spark, table, clash=True))
    assert kept.columns == docs(spark, [], clash=True).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, ""), (3, long), (9, "other words stand in this text here")]
    assert rows(simhash.keep_one(docs(spark, [(None, long), (None, long)])).select("doc_id", "text")) == [(None, long)]
    assert rows(simhash.keep_one(docs(spark, []))) == [] == rows(simhash.near_duplicates(docs(spark, [])))


def test_components_of_chains_stars_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    edges = spark.createDataFrame(chain[::-1] + star + star + [(5000, 5000), (None, 3), (-7, -9)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(500)} | {-7: -9, -9: -9}


def test_exploded_keys_are_not_broadcast(spark):
    # Spark takes the 31 keys of a fingerprint to be no larger than the fingerprint: a driver broke on them at 0.6 GB.
    links = simhash.close_pairs(spark.range(1000).select(F.xxhash64("id").alias("fp")), 4)
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()
    links.collect()
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()
