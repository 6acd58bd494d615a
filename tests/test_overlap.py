"""The early stop gives what counting every shared word gives, also with words that everyone shares."""

import random

import pytest
from memlake.operators import overlap as ov


@pytest.mark.parametrize("descending", [True, False])
def test_most_shared_equals_counting(spark, tmp_path, descending):
    rnd = random.Random(6)
    words = ["all", "most"] + [f"w{i}" for i in range(40)]
    pick = lambda n: {"all"} | ({"most"} if rnd.random() < .8 else set()) | {words[min(int(rnd.expovariate(.12)), 41)] for _ in range(n)}
    entries = [(i, rnd.randrange(30), sorted(pick(rnd.randrange(6)))) for i in range(400)] + [(900, 3, []), (901, 3, None)]
    questions = [(q, sorted(pick(rnd.randrange(1, 7)))) for q in range(25)] + [(90, ["all"]), (91, ["all", "most"]), (92, ["unheard"]), (93, []), (94, None), (95, ["w39", "all"])]
    index = ov.build(spark.createDataFrame(entries, "id long, seq int, words array<string>"), "id", "seq", str(tmp_path / "o"))
    asked = spark.createDataFrame(questions, "q int, words array<string>")
    for k in (1, 7, 1000):
        want = set()
        for q, ws in questions:
            found = [(len(set(ws or []) & set(e or [])), s, i) for i, s, e in entries]
            found = sorted((f for f in found if f[0]), key=lambda f: (-f[0], -f[1] if descending else f[1], f[2]))[:k]
            want |= {(q, i, n, pos + 1) for pos, (n, _, i) in enumerate(found)}
        got = ov.most_shared(index, asked, "q", "id", "seq", descending, k)
        assert {(r.q, r.id, r.overlap, r.pos) for r in got.collect()} == want
