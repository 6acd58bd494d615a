import math

import numpy as np
import pytest

from memlake.llm import whiten
from memlake.llm.queries import QUERIES

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def slow(vectors, count=16):
    """(n, deviation, whitened, explained) by a dense eigensolver over the distinct vectors."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in fit])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:count], turn[:, ::-1][:, :count]
    rows = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    return n, [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x], rows @ turn / np.sqrt(values), values / (centred ** 2).sum() * n


def compare(got, ids, vectors, count=16, tolerance=1e-7):
    n, deviation, want, explained = slow(vectors, count)
    k = want.shape[1]
    assert len(got) == len(ids) * k
    table = {(r.vec_id, r.component): r for r in got}
    found = np.array([[table[i, c + 1].whitened for c in range(k)] for i in ids])
    found *= np.sign((found * want).sum(axis=0))
    assert np.abs(found - want).max() < tolerance
    for i, d in zip(ids, deviation):
        assert all(table[i, c + 1].deviation == d and table[i, c + 1].n == n for c in range(k))
    assert np.allclose([table[ids[0], c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_dense_solver(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()
    df = QUERIES["op12_embedding_whitening"](spark, f"/root/testdata/sf{sf}")
    assert df.columns == COLUMNS
    compare(df.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("spread", [1.0, 0.97, 0.5, 0.01])
def test_filter_finds_the_leading_pairs(spread):
    """Steep and nearly flat spectra, wide blocks of unwanted values, far more dimensions than columns."""
    rng = np.random.default_rng(3)
    dim = 300
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    values = np.concatenate([[900.0, 80, 30], np.linspace(2, 1, dim - 3) if spread == 1 else 2 * spread ** np.arange(dim - 3)])
    matrix = (turn * values) @ turn.T
    passes = []
    found, vectors = whiten.leading(lambda b: passes.append(b.shape[1]) or matrix @ b, dim, 16)
    assert np.allclose(found, values[:len(found)], rtol=1e-10) and len(found) == (values[:16] > 8 * dim * 2.3e-16 * 900).sum()
    angle = np.abs((vectors * turn[:, :len(found)]).sum(axis=0))
    assert (1 - angle).max() < 1e-9
    assert max(passes) <= 49


def test_deficient_matrices():
    assert len(whiten.leading(lambda b: 0 * b, 70, 16)[0]) == 0
    rng = np.random.default_rng(4)
    thin = rng.standard_normal((100, 5))
    values, vectors = whiten.leading(lambda b: thin @ (thin.T @ b), 100, 16)
    assert len(values) == 5 and np.allclose(thin @ (thin.T @ vectors), vectors * values)


def test_odd_rows(spark):
    schema = "vec_id bigint, embedding array<double>, x int, id string, n int, component int"
    frame = lambda rows: spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], schema)
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.standard_normal(5) * 3]) for i in range(40)]
    bad = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (94, [])]
    short = [(50, [1.0, 2.0]), (51, [])]
    got = whiten.whitened(frame(good + bad[:4] + short + [(60, good[0][1])] * 2 + [(None, good[1][1])])).collect()
    assert len(got) == (40 + 2 + 2 + 1) * 5 and {r.id for r in got} == {*range(40), 50, 51, 60, None}
    filled = good + [(50, [1.0, 2.0, 0.0, 0.0, 0.0]), (51, [0.0] * 5)]
    plain = whiten.whitened(frame(filled)).withColumnRenamed("id", "vec_id").collect()
    compare(plain, [i for i, _ in filled], [v for _, v in filled])
    same = lambda rows, i: sorted((r.component, r.n, r.deviation, r.whitened) for r in rows if r[0] == i)
    for i in (50, 51):
        for a, b in zip(same(got, i), same(plain, i), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
    for rows in ([], bad[:4], [(1, [])], [(1, [2.0, 3.0])] * 3):
        out = whiten.whitened(frame(rows))
        assert out.columns[0] == "id" and out.collect() == []
    huge = [(1, [1e308, 0.0]), (2, [-1e308, 1.0]), (3, [0.0, -1.0])]
    far = whiten.whitened(frame(huge)).collect()
    assert len(far) > 0 and all(r.deviation is None or r.deviation >= 0 for r in far)
