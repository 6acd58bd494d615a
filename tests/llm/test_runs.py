import hashlib
import random
import zlib

import numpy as np
import pytest

from memlake.llm import runs
from memlake.llm.queries import planted_period
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.001"


def slow_runs(w, least=12):
    """Every period by direct comparison; a stretch with a smaller period is that period's run."""
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in out.items())


def slow_collapsed(w, found):
    gone = {i for s, e, q in found for i in range(s + q, e)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def fib(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def shapes():
    rnd = random.Random(5)
    yield []
    yield [1] * 11
    yield [1] * 12
    yield [1] * 700
    yield [1, 2] * 300 + [1] * 40
    yield fib(900)
    for _ in range(60):
        n, k = rnd.randrange(1, 260), rnd.choice([2, 2, 3, 6])
        yield [rnd.randrange(k) for _ in range(n)]
    for _ in range(60):
        w = [rnd.randrange(50) for _ in range(rnd.randrange(400))]
        for _ in range(rnd.randrange(4)):
            a, p = rnd.randrange(len(w) + 1), rnd.randrange(1, 90)
            unit = [rnd.randrange(50) for _ in range(p)]
            w[a:a] = (unit * 5)[:rnd.randrange(p, 5 * p + 1)]
        yield w


def test_runs_equal_brute_force():
    every = list(shapes())
    found = runs.runs_of([np.array(w, np.int64) for w in every])
    for w, f in zip(every, found):
        assert [tuple(r) for r in f.tolist()] == slow_runs(w)
        words = [str(x).encode() for x in w]
        assert runs.collapsed(words, f).decode() == slow_collapsed([str(x) for x in w], slow_runs(w))
    short = runs.runs_of([np.array(w, np.int64) for w in every], least=2)
    for w, f in zip(every, short):
        assert [tuple(r) for r in f.tolist()] == slow_runs(w, 2)


@pytest.mark.parametrize("step", [1, 7, 64])
def test_appending_word_by_word_gives_the_same(step):
    for w in list(shapes())[3:40]:
        c = runs.Catchers()
        for at in range(0, len(w), step):
            c.append(np.array(w[at:at + step]))
            if at % 50 == 0:  # what has been reported so far is right at any time
                assert [tuple(r) for r in c.runs().tolist()] == slow_runs(w[:at + step])
        assert [tuple(r) for r in c.runs().tolist()] == slow_runs(w)


def test_chance_fingerprints_do_no_harm(monkeypatch):
    monkeypatch.setattr(runs, "_mix", lambda a, b: (a + b * np.uint64(0)) & np.uint64(1))
    for w in list(shapes())[:60]:
        assert [tuple(r) for r in runs.runs_of([np.array(w, np.int64)])[0].tolist()] == slow_runs(w)


def test_long_documents():
    rnd = random.Random(1)
    unit = [rnd.randrange(10**6) for _ in range(70_001)]
    w = np.array((unit * 3)[:180_000] + [1] * 400_000)
    assert [tuple(r) for r in runs.runs_of([w])[0].tolist()] == [(0, 180_000, 70_001), (180_000, 580_000, 1)]


def expected(doc_id, text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(slow_collapsed(w, found)))


def test_query_equals_brute_force(spark, tmp_path):
    from memlake.llm.queries import QUERIES

    table = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 6000]
    given = [(r.doc_id, r.text) for r in table] + [(None, "a b " * 9), (-5, None), (-6, " \t\n"), (-6, " \t\n"), (10**12, "la " * 5000), (7, "ä ö　ü " * 8)]
    docs(spark, given, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[7])
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted((expected(*r) for r in given), key=key)
    assert got == want
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_periodic_runs"](spark, f"{tmp_path}/none").collect() == []


def test_planted_period_leaves_others_alone():
    assert planted_period(None, [b"a"]) == [b"a"]
    assert planted_period(1, []) == []
