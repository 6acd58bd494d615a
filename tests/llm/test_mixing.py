import math
import random
from collections import Counter

import pytest

from memlake.llm import mixing
from tests.llm.helpers import docs, rows


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 1, "d": 1}, {i: i + 1 for i in range(20)}, {"a": 997, "b": 1, "c": 1, "d": 1}])
def test_less_than_one_block_from_the_share(weights):
    slots = mixing.quotas(weights, 1000)
    assert sum(slots.values()) == 1000
    order = {t: s for s, ts in mixing.one_period(slots, 1000).items() for t in ts}
    assert sorted(order) == list(range(1000))
    done = Counter()
    for t in range(1000):
        done[order[t]] += 1
        assert all(abs(done[s] - q * (t + 1) / 1000) < 1 for s, q in slots.items())


def test_plan_places_every_block_once():
    blocks = {"a": 1234, "b": 77, "c": 1, "d": 0, "e": 400}
    phases, slots, total = mixing.plan(blocks, {"a": 1, "b": 2, "c": 5, "e": 0}, 100)
    table = {(p, s, n): t for p, s, n, t in slots}
    places = {}
    for s, p, first, last, quota, base in phases:
        for i in range(first, last):
            places[base + (i - first) // quota * 100 + table[p, s, (i - first) % quota]] = (s, i)
    assert sorted(places) == list(range(total)) and Counter(s for s, _ in places.values()) == {s: n for s, n in blocks.items() if n}
    assert min(t for t, (s, _) in places.items() if s == "e") > max(t for t, (s, _) in places.items() if s != "e")


def test_rows_are_kept_and_mixed(spark):
    rng = random.Random(1)
    table = [(i, "x" * rng.randint(1, 400), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(3000, None, None), (3001, "", None), (None, "y" * 5000, "hot"), (1, "twice", "s1"), (1, "twice", "s1")]
    df = docs(spark, table, clash=True)
    placed, total = mixing.placed(df, block_chars=1000, period=100)
    got = placed.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((t[0], t[1]) for t in table)
    # Mass before a row in its source, by brute force over the order of the hash.
    before = Counter()
    for r in sorted(got, key=lambda r: (r["__hash"] % (1 << 64), r.doc_id or -1)):
        if r.text != "twice":
            assert r["__start"] == before[r.source]
        before[r.source] += len(r.text or "")
        assert r["__block"] == min(r["__start"] // 1000, max(1, math.ceil(sum(len(t[1] or "") for t in table if t[2] == r.source) / 1000)) - 1)
    assert len({(r.source, r["__block"]) for r in got}) == len({r["__slot"] for r in got}) and max(r["__slot"] for r in got) < total
    out = mixing.mixed(df, block_chars=1000, period=100)
    assert out.columns == df.columns
    order = [r.doc_id for r in out.collect()]
    want = [r.doc_id for r in sorted(got, key=lambda r: (r["__slot"], r["__hash"] % (1 << 64)))]
    assert order == want


def test_weights_limits_and_nothing(spark):
    table = [(i, "x" * 100, "ab"[i % 2]) for i in range(400)]
    placed, _ = mixing.placed(docs(spark, table), {"a": 3.0, "b": 1.0}, block_chars=100)
    head = Counter(r.source for r in placed.where("__slot < 200").collect())
    assert abs(head["a"] - 150) <= 1 and abs(head["b"] - 50) <= 1
    assert rows(mixing.mixed(docs(spark, []))) == []
    many = docs(spark, [(i, "x", f"s{i}") for i in range(mixing.MAX_SOURCES + 1)])
    with pytest.raises(ValueError, match="sources"):
        mixing.mixed(many)


@pytest.mark.parametrize("weights", [{"a": 0.91} | {f"s{i}": 0.01 for i in range(9)}, {"a": 0.5} | {f"s{i}": 0.5 / 199 for i in range(199)}, {"a": math.sqrt(2), "b": 1, "c": math.pi / 3000}])
def test_placed_blocks_follow_the_given_weights_over_many_periods(weights):
    total = sum(weights.values())
    phases, slots, length = mixing.plan({s: int(120_000 * w / total) + 1 for s, w in weights.items()}, weights)
    at = {(s, p): (first, last, quota, base) for s, p, first, last, quota, base in phases}
    places = {}
    for p, s, n, t in slots:
        first, last, quota, base = at[s, p]
        for k, i in enumerate(range(first + n, last, quota)):
            places[base + k * mixing.PERIOD + t] = (s, p)
    assert sorted(places) == list(range(length)) and length > 100 * mixing.PERIOD
    end = next(t for t in range(length + 1) if t == length or places[t][1])  # of the first phase
    assert end > 100 * mixing.PERIOD
    done = Counter()
    for t in range(end):
        done[places[t][0]] += 1
        if t % 97 == 0 or t == end - 1:
            assert all(abs(done[s] - w / total * (t + 1)) < 1 + 1e-6 for s, w in weights.items())


def test_only_sources_without_a_slot_get_the_least():
    assert mixing.quotas({"a": 91} | {f"s{i}": 1 for i in range(9)}, 1000) == {"a": 910} | {f"s{i}": 10 for i in range(9)}
    small = mixing.quotas({"a": 1_000_000, "b": 500_000, "c": 1}, 100)
    assert small["c"] == 1 and sum(small.values()) == 100 and small["a"] == 66


def test_rows_of_a_plan_by_block(spark, monkeypatch):
    table = [(i, "x" * 100, "abc"[i % 3]) for i in range(900)]
    weights = {"a": math.sqrt(2), "b": 1.0, "c": 0.3}
    want = rows(mixing.placed(docs(spark, table), weights, block_chars=100)[0])
    monkeypatch.setattr(mixing, "broadcast_if_small", lambda df: df)
    assert rows(mixing.placed(docs(spark, table), weights, block_chars=100)[0]) == want and len(want) == 900
