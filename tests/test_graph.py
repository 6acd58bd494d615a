"""Graph jobs against brute force on small random graphs."""

import random

import pytest

from memlake.operators import graph as gr


@pytest.fixture
def rounds(monkeypatch):
    """One entry per table that a job has written."""
    taken = []
    plain = gr.written
    monkeypatch.setattr(gr, "written", lambda df: taken.append(1) or plain(df))
    return taken


def _pairs(spark, rows, a, b):
    return spark.createDataFrame(rows, f"{a} long, {b} long")


def _closure(edges):
    reach = {a: set() for e in edges for a in e}
    for a in reach:
        stack = [d for s, d in edges if s == a]
        while stack:
            x = stack.pop()
            if x not in reach[a]:
                reach[a].add(x)
                stack += [d for s, d in edges if s == x]
    return reach


def _brute_governance(nodes, depends, supersedes, cyclic):
    part = nodes - cyclic
    edges = {(n, d) for d, n in depends if n in part and d in part} | {(a, b) for a, b in supersedes if a in part and b in part}
    governing, replaced, state, left = set(), set(), {}, set(part)
    while left:
        ready = {x for x in left if not any(b == x and a in left for a, b in edges)}
        assert ready
        for x in ready:
            if all(n in governing for d, n in depends if d == x):
                state[x] = "superseded" if x in replaced else "governing"
            else:
                state[x] = "invalidated"
        for x in ready:
            if state[x] == "governing":
                governing.add(x)
            if state[x] != "invalidated":
                replaced |= {b for a, b in supersedes if a == x}
        left -= ready
    return state


def test_reachable_and_cycles(spark):
    rnd = random.Random(1)
    edges = {(rnd.randrange(25), rnd.randrange(25)) for _ in range(28)} | {(30, 30), (40, 41)}
    reach = _closure(edges)
    df = _pairs(spark, sorted(edges), "src", "dst")
    assert {r.node for r in gr.cyclic_members(df).collect()} == {a for a in reach if a in reach[a]}
    seeds = spark.createDataFrame([(0,), (3,)], "node long")
    assert {r.node for r in gr.reachable(seeds, df).collect()} == {0, 3} | reach.get(0, set()) | reach.get(3, set())


def test_settled_rejects_cycles_and_open_ends(spark):
    edges = _pairs(spark, [(1, 0), (2, 1), (2, 0), (3, 4), (4, 3), (5, 9), (6, 2), (6, 3)], "node", "need")
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {r.node for r in gr.settled(nodes, edges, seeds).collect()} == {0, 1, 2}


def test_governance_matches_brute_force(spark):
    rnd = random.Random(7)
    nodes = set(range(14))
    depends = sorted({(a, b) for a, b in ((rnd.randrange(14), rnd.randrange(16)) for _ in range(12)) if a > b or b > 13})
    supersedes = sorted({(a, b) for a, b in ((rnd.randrange(14), rnd.randrange(14)) for _ in range(6)) if a < b})
    edges = {(n, d) for d, n in depends if n in nodes} | set(supersedes)
    reach = _closure(edges)
    cyclic = {a for a in reach if a in reach[a]}
    got = gr.governance(spark.createDataFrame([(n,) for n in nodes], "node long"), _pairs(spark, depends, "node", "need"),
                        _pairs(spark, supersedes, "node", "target"), spark.createDataFrame([(c,) for c in cyclic], "node long"))
    assert {r.node: r.state for r in got.collect()} == _brute_governance(nodes, depends, supersedes, cyclic)


def test_replacement_resolves_a_contradiction(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    none = spark.createDataFrame([], "node long, need long")
    # 1 and 2 contradict; 3 replaces 1 and rests on nothing: resolved. 4 and 5 contradict with no replacement.
    gov, out, _ = gr.conflicts(nodes, none, _pairs(spark, [(3, 1)], "node", "target"), _pairs(spark, [(1, 2), (5, 4)], "a", "b"))
    assert {r.node for r in out.collect()} == {4, 5}
    assert {r.node: r.state for r in gov.collect()} == {0: "governing", 1: "superseded", 2: "governing", 3: "governing"}
    # The replacement rests on one side of the contradiction: it cannot resolve it.
    _, out, _ = gr.conflicts(nodes, _pairs(spark, [(3, 2)], "node", "need"), _pairs(spark, [(3, 1)], "node", "target"), _pairs(spark, [(1, 2)], "a", "b"))
    assert {r.node for r in out.collect()} == {1, 2}


CHAIN = 10_000


def _chain(spark, n, a, b):
    return spark.range(1, n).selectExpr(f"id - 1 AS {a}", f"id AS {b}")


def test_a_long_chain_takes_few_rounds(spark, rounds):
    seeds = spark.createDataFrame([(0,)], "node long")
    assert gr.reachable(seeds, _chain(spark, CHAIN, "src", "dst")).count() == CHAIN
    assert len(rounds) < 2 * 40
    rounds.clear()
    assert gr.settled(seeds, _chain(spark, CHAIN, "need", "node"), seeds).count() == CHAIN
    assert len(rounds) < 3 * 40


def test_governance_of_a_long_chain(spark, rounds):
    n = 300
    nodes, none = spark.range(n).toDF("node"), spark.createDataFrame([], "node long")
    # Each claim rests on the one before; the one in the middle is replaced by a claim that governs.
    depends = _chain(spark, n - 1, "need", "node").select("node", "need")
    got = gr.governance(nodes, depends, _pairs(spark, [(n - 1, n // 2)], "node", "target"), none)
    assert len(rounds) < 4 * 40
    want = {i: "governing" if i < n // 2 or i == n - 1 else "superseded" if i == n // 2 else "invalidated" for i in range(n)}
    assert {r.node: r.state for r in got.collect()} == want
    # Each replaces the next: all issue, so all but the first are superseded.
    got = gr.governance(nodes, _pairs(spark, [], "node", "need"), _chain(spark, n, "node", "target"), none)
    assert {r.node: r.state for r in got.collect()} == {i: "superseded" if i else "governing" for i in range(n)}


def test_a_tail_before_a_ring(spark, rounds):
    n = 5000
    tail = _chain(spark, n, "src", "dst")
    ring = _pairs(spark, [(n - 1, n), (n, n + 1), (n + 1, n + 2), (n + 2, n), (n + 1, n + 50), (n + 50, n + 51)], "src", "dst")
    assert {r.node for r in gr.cyclic_members(tail.union(ring)).collect()} == {n, n + 1, n + 2}
    assert len(rounds) < 5 * 40
    rounds.clear()
    n = 300
    assert gr.cyclic_members(_chain(spark, n, "src", "dst").union(_pairs(spark, [(n - 1, 0)], "src", "dst"))).count() == n
    assert len(rounds) < 5 * 40


def _components(edges):
    reach = _closure(edges)
    return {a: frozenset(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}


def test_components_on_many_shapes(spark):
    rnd = random.Random(12)
    for n, m in ((30, 38),):
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
        ring = [100, 101, 102, 103, 104]
        edges |= {(ring[i], ring[i - 1]) for i in range(5)} | {(104, 200), (200, 201), (201, 104), (201, 300), (300, 300), (300, 301), (301, 302), (302, 300), (400, 400), (400, 401), (399, 400)}
        got = {r.node: r.component for r in gr.strong_components(_pairs(spark, sorted(edges), "src", "dst")).collect()}
        want = _components(edges)
        assert set(got) == set(want)
        for a in got:
            assert {b for b in got if got[b] == got[a]} == set(want[a])


def _brute_conflicts(nodes, depends, supersedes, contradicts):
    influence = {(n, d) for d, n in depends if n in nodes and d in nodes} | {(a, b) for a, b in supersedes if a in nodes and b in nodes}
    cyclic = set(_components(influence))
    reach, out = _closure(depends), set()
    while True:
        state = _brute_governance(nodes - out, depends, supersedes, cyclic)
        issuers = {x for x in state if state[x] != "invalidated"}
        open_ = set()
        for a, b in contradicts:
            if a != b and {a, b} <= issuers and not any(not reach.get(i, set()) & {a, b} for i, x in supersedes if x in (a, b) and i in issuers):
                open_ |= {a, b}
        if not open_:
            return state, out, cyclic
        out |= open_


def test_conflicts_match_brute_force(spark):
    rnd = random.Random(3)
    seen = 0
    for size in (24,):
        pick = lambda: rnd.randrange(size)
        depends = sorted({(max(a, b), min(a, b)) for a, b in ((pick(), pick()) for _ in range(size // 2)) if a != b} | {(2, 3), (3, 2)})
        supersedes = sorted({(a, b) for a, b in ((pick(), pick()) for _ in range(size // 3)) if a > b})
        contradicts = sorted({(a, b) for a, b in ((pick(), pick()) for _ in range(size // 2))})
        nodes = set(range(size))
        gov, out, cyclic = gr.conflicts(spark.createDataFrame([(i,) for i in nodes], "node long"), _pairs(spark, depends, "node", "need"),
                                        _pairs(spark, supersedes, "node", "target"), _pairs(spark, contradicts, "a", "b"))
        state, lost, rings = _brute_conflicts(nodes, depends, supersedes, contradicts)
        assert {r.node: r.state for r in gov.collect()} == state
        assert {r.node for r in out.collect()} == lost and {r.node for r in cyclic.collect()} == rings
        seen += len(lost)
    assert seen


def test_premises_by_label_and_walk(spark, monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(gr, "WORDS", 1)
    n = 90  # more premises than a filter has bits, so labels alone cannot tell
    depends = sorted({(a, rnd.randrange(a)) for a in range(1, n) for _ in range(rnd.choice([1, 1, 2]))})
    reach = _closure(depends)
    asked = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(400)]
    got = gr.rests_on(_pairs(spark, asked, "node", "target"), _pairs(spark, depends, "node", "need"))
    assert {(r.node, r.target) for r in got.collect()} == {(a, b) for a, b in asked if a != b and b in reach.get(a, ())}
    labels = {r.node: r for r in gr.premise_labels(_pairs(spark, depends, "node", "need")).collect()}
    depth = {}
    for a in range(n):
        depth[a] = max((depth[b] + 1 for x, b in depends if x == a), default=0)
    assert {a: labels[a].depth for a in labels} == depth
    chain = gr.premise_labels(_chain(spark, 100, "need", "node"))
    assert {r.node: r.depth for r in chain.collect()} == {i: i for i in range(100)}


def test_empty_graphs(spark):
    none = _pairs(spark, [], "src", "dst")
    seeds = spark.createDataFrame([(4,)], "node long")
    assert gr.cyclic_members(none).collect() == [] and [r.node for r in gr.reachable(seeds, none).collect()] == [4]
    assert gr.settled(seeds, _pairs(spark, [], "node", "need"), seeds.limit(0)).collect() == []
    assert gr.rests_on(_pairs(spark, [(1, 2)], "node", "target"), _pairs(spark, [], "node", "need")).collect() == []
