import random

from hypothesis import given, settings, strategies as st

from memlake.llm import decontaminate as dc
from tests.llm.helpers import docs, rows


def slow(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", min_size=1, max_size=30), st.text("ab ", max_size=60))
def test_distance_equals_dynamic_programming(pattern, text):
    assert dc.Pattern(pattern, 0, 0, None).distance(text)[0] == slow(pattern, text)


def test_hits_equal_brute_force():
    rng = random.Random(3)
    pick = lambda n: "".join(rng.choices("abcd efg", k=n))
    for _ in range(300):
        item = dc.plain(pick(rng.randint(8, 60))) or "x"
        text = list(item)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(text) + 1)
            text[k:k + rng.randint(0, 1)] = rng.choices("abx", k=rng.randint(0, 1))
        whole = dc.plain(pick(40) + "".join(text) + pick(40))
        found, budget = dc.Items([(1, item)], 0.15).hits(whole), int(len(item) * 0.15)
        best = slow(item, whole)
        assert bool(found) == (best <= budget) and (not found or found[0][0] == best)


def test_matches_and_clean(spark):
    item = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    near = item.replace("quick", "quack").replace("lazy", "laazy").replace("stone", "ston")
    table = [(1, "x " * 5000 + item + " y" * 5000), (2, near.upper().replace(" ", "\n ")), (3, "nothing to see in this text"), (4, None), (5, ""), (None, item), (2, near), (6, item[:40])]
    items = spark.createDataFrame([(10, item), (11, None), (12, " "), (13, item), (14, "a wholly different passage that no document holds")], "item_id bigint, text string")
    got = rows(dc.matches(docs(spark, table, clash=True), items, block_chars=80).select("id", "item_id", "distance"))
    assert got == [(None, 10, 0), (None, 13, 0), (1, 10, 0), (1, 13, 0), (2, 10, 3), (2, 10, 3), (2, 13, 3), (2, 13, 3)]
    kept = dc.clean(docs(spark, table, clash=True), items)
    assert kept.columns == docs(spark, [], clash=True).columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert dc.clean(docs(spark, table), items.limit(0)).count() == len(table)
    assert rows(dc.matches(docs(spark, []), items)) == [] == rows(dc.matches(docs(spark, table), items.limit(0)))
