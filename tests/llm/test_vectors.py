import numpy as np

from memlake.llm import vectors
from tests.llm.helpers import rows

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(ids, vecs, cosine=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in vecs]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vecs, good)]
    n = len(ids)
    link = [[i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in range(n):
                if link[todo[0]][j] and j not in seen:
                    seen.add(j)
                    todo.append(j)
            todo.pop(0)
        out.append((ids[i], sum(link[i]), min(ids[j] for j in seen)))
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 16)
    rng = np.random.default_rng(1)
    vecs = [rng.normal(size=16) for _ in range(60)]
    for base in vecs[:6]:
        vecs += [base + rng.normal(size=16) * s for s in (0.02, 0.05, 0.1, 0.15) for _ in range(6)]
    vecs += [vecs[0] * 3, vecs[1], vecs[1], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, None, [], [1.0, None] + [0.0] * 14, [1.0, 0.0], [2.0, 0.0], [1e-30] * 16, [3e38] * 16]
    vecs = [v if v is None else [x if x is None else float(np.float32(x)) for x in v] for v in vecs]
    ids = list(range(len(vecs)))
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vecs)], SCHEMA).selectExpr("*", "1 AS id", "'x' AS vec", "2 AS n")
    got = sorted(map(tuple, vectors.near_duplicates(df, recall=0.999999).collect()))
    assert got == brute(ids, vecs)


def test_recall_of_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(2)
    made = []
    for _ in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        made += [a, 0.905 * a + np.sqrt(1 - 0.905 ** 2) * b]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(made)], SCHEMA)
    found = sum(r.n_links for r in vectors.near_duplicates(df).collect()) / 2
    assert found >= 0.9 * 400


def test_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (2, None, 0)], SCHEMA)
    assert rows(vectors.near_duplicates(df)) == [(None, 2, 4), (2, 0, 2), (4, 2, 4), (4, 2, 4)]
    assert rows(vectors.near_duplicates(df.limit(0))) == []
    assert rows(vectors.near_duplicates(df.where("vec_id = 2"))) == [(2, 0, 2)]
