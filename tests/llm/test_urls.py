import random

import numpy as np
import pytest

from memlake.llm import urls
from tests.llm.helpers import rows


def hashes(keys):
    rng = {k: (random.Random(k).getrandbits(64) - (1 << 63), random.Random("g" + k).getrandbits(64) - (1 << 63)) for k in keys}
    return np.array([rng[k] for k in keys], np.int64)


def test_cascade_is_exact_over_the_universe(spark):
    universe = [f"host{i}.example" for i in range(6000)]
    listed = universe[::7] + ["not.in.corpus"]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    cascade = urls.build(frame(universe), frame(listed))
    assert len(cascade.levels) > 1  # false positives of the first level were met and undone
    u = frame(universe)
    got = {r.key for r in u.where(urls.in_list(urls.F.array("key"), cascade, spark)).collect()}
    assert got == set(universe[::7])


def test_levels_alternate():
    listed, other = hashes([f"a{i}" for i in range(200)]), hashes([f"b{i}" for i in range(5000)])
    # Two levels by hand: what of the others passes the first is encoded in the second.
    def level(keys, n, bits):
        held = np.zeros(-(-bits // 64) * 8, np.uint8)
        for s in urls._spots(keys, n, bits).ravel():
            held[int(s) >> 3] |= 1 << (int(s) & 7)
        return bits, held
    levels, inside, outside = [], listed, other
    while len(inside):
        levels.append(level(inside, len(levels), max(64, 4 * len(inside))))
        bits, held = levels[-1]
        inside, outside = outside[urls._passes(held, bits, len(levels) - 1, outside)], inside
    cascade = urls.Cascade(levels)
    assert cascade.has(listed).all() and not cascade.has(other).any()


def test_rules_and_odd_urls(spark):
    pages = spark.createDataFrame([
        (1, "http://A.Example.NET/en/x?y#z"), (2, "http://example.net/de/"), (3, "https://b.example.com/de/1"), (4, "http://bad.example.com/x"),
        (5, "http://sub.bad.example.com"), (6, None), (7, "no scheme/net/"), (8, "http://x.org/fr/"), (9, "http://xorg/fr/"), (10, ""), (11, "http://net#/"),
        (4, "http://bad.example.com/x"), (None, "http://example.net")], "page_id bigint, url string").selectExpr("*", "1 AS id", "'x' AS host", "'y' AS rule", "'z' AS key")
    listed = spark.createDataFrame([("bad.example.com",), (None,)], "key string")
    rules = [urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"), urls.Rule("example.com/de/", "block"), urls.Rule("org/fr/", "allow")]
    got = {(r.id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, "page_id", "url", listed, rules).collect()}
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"), (3, "b.example.com", "/de/1", "example.com/de/", "block"),
        (4, "bad.example.com", "/x", None, "block"), (5, "sub.bad.example.com", "", None, "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "x.org", "/fr/", "org/fr/", "allow"), (9, "xorg", "/fr/", None, "allow"), (10, "", "", None, "allow"), (11, "net", "", None, "allow"), (None, "example.net", "", None, "allow")}
    assert urls.judge(pages, "page_id", "url", listed, rules).count() == 13


def test_empty_tables_and_size_bound(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    listed = spark.createDataFrame([(f"k{i}",) for i in range(100)], "key string")
    assert rows(urls.judge(pages, "page_id", "url", listed, [])) == []
    some = spark.createDataFrame([(1, "http://k1/")], "page_id bigint, url string")
    assert rows(urls.judge(some, "page_id", "url", listed.limit(0), [])) == [(1, "k1", "/", None, "allow")]
    with pytest.raises(ValueError, match="max_bytes"):
        urls.build(listed, listed, max_bytes=10)
