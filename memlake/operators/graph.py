"""Iterative graph jobs that contract chains as they go.

Each round settles what can be settled and then shortens what is left: a node whose fate hangs on one other node passes
its edges on to that node, so a chain of any length is halved per round and a job takes a logarithmic
number of rounds on it. What is settled leaves the edges, so a round costs a pass over what is still open. No job
materializes all pairs of connected nodes. Loops run until a round changes nothing, however deep the graph is.
Rounds are cut by tables in the shared folder; finished rounds are merged, so that neither plan nor partition count grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.session import written


def count_rows():
    return F.count(F.lit(1))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _compact(parts: list[DataFrame]) -> list[DataFrame]:
    """Merge the stored waves from time to time, so that neither plan nor partition count grows on."""
    if len(parts) < 12:
        return parts
    width = int(parts[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [written(_union(parts).coalesce(width))]


def _named(df: DataFrame, column: str) -> DataFrame:
    """The nodes of ``df`` under another name."""
    return df.select(F.col("node").alias(column))


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): seeds and everything reached from them along ``edges`` (src, dst).

    A node that is not reached and has one way in is reached when its source is: its edges start there from now
    on. One with no way in never is: its edges go.
    """
    frontier = written(seeds.select("node").distinct())
    waves = [frontier]
    # Edges into nodes not reached yet.
    live = written(edges.select("src", "dst").where("src <> dst").distinct().join(_named(frontier, "dst"), "dst", "left_anti"))
    while True:
        frontier = written(live.join(_named(frontier, "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
        if frontier.isEmpty():
            return _union(waves)
        waves = _compact([*waves, frontier])
        open_ = live.join(_named(frontier, "dst"), "dst", "left_anti")
        ways = open_.groupBy(F.col("dst").alias("src")).agg(count_rows().alias("ways"), F.min("src").alias("one"))
        ahead = frontier.select(F.col("node").alias("src"), F.lit(0).cast("bigint").alias("ways"), F.lit(None).cast(open_.schema["src"].dataType).alias("one"))
        start = F.when(F.col("ways") == 1, F.col("one")).otherwise(F.col("src"))
        live = written(open_.join(ways.unionByName(ahead), "src").select(start.alias("src"), "dst").where("src <> dst").distinct())


def settled(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): least set with all seeds and every node that has prerequisites, all of them in the set.

    ``edges`` are (node, need) pairs. Members of cycles never settle. A node with one open prerequisite
    settles when that does: others wait for the prerequisite itself from then on.
    """
    frontier = written(seeds.select("node").distinct())
    waves = [frontier]
    live = written(edges.select("node", "need").distinct().join(frontier, "node", "left_anti"))
    while True:
        met = live.join(_named(frontier, "need"), "need", "left_semi").select("node").distinct()
        open_ = written(live.join(_named(frontier, "need"), "need", "left_anti"))
        frontier = written(met.join(open_.select("node").distinct(), "node", "left_anti"))
        if frontier.isEmpty():
            return _union(waves)
        waves = _compact([*waves, frontier])
        singles = open_.groupBy(F.col("node").alias("need")).agg(count_rows().alias("n"), F.min("need").alias("one")).where("n = 1").drop("n")
        live = written(open_.join(singles, "need", "left").select("node", F.coalesce("one", "need").alias("need")).distinct())


# -- cycles -------------------------------------------------------------------------------------------

def _degrees(edges: DataFrame) -> DataFrame:
    """(node, into, out, before, after): numbers of edges, and the neighbours of a node with one of each."""
    side = lambda node, other, n, m: edges.groupBy(F.col(node).alias("node")).agg(count_rows().alias(n), F.min(other).alias(m))
    return (side("dst", "src", "into", "before").join(side("src", "dst", "out", "after"), "node", "full")
            .select("node", F.coalesce("into", F.lit(0)).alias("into"), F.coalesce("out", F.lit(0)).alias("out"), "before", "after"))


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(core, loops, passed): ``edges`` without nodes that end or begin nowhere and without nodes in the middle of chains.

    A node with one edge in and one out is bridged by an edge between its neighbours if its hash is the smallest around;
    ``passed`` (node, before, after) tells, round by round, which were. A bridge from a node to itself is a ``loop``.
    """
    live, loops, passed = written(edges.select("src", "dst").where("src <> dst").distinct()), [], []
    while True:
        degrees = written(_degrees(live))
        ends = degrees.where("into = 0 OR out = 0").select("node")
        rank = F.struct(F.xxhash64(F.lit(len(passed)), "node"), "node")
        middle = degrees.where("into = 1 AND out = 1").select("node", "before", "after", rank.alias("rank"))
        around = middle.select(F.col("node").alias("other"), F.col("rank").alias("theirs"))
        first = middle
        for side in ("before", "after"):
            near = around.select(F.col("other").alias(side), F.col("theirs").alias(f"by_{side}"))
            first = first.join(near, side, "left")
        least = lambda c: F.col(c).isNull() | (F.col("rank") < F.col(c))
        chosen = first.where(least("by_before") & least("by_after"))
        # A chain's end that goes in this round takes no part in a bridge.
        for side in ("before", "after"):
            chosen = chosen.join(_named(ends, side), side, "left_anti")
        chosen = written(chosen.select("node", "before", "after"))
        gone = ends.unionByName(chosen.select("node"))
        if gone.isEmpty():
            return live, written(_union([*loops, live.select(F.col("src").alias("node")).limit(0)]).distinct()), passed
        kept = live.join(_named(gone, "src"), "src", "left_anti").join(_named(gone, "dst"), "dst", "left_anti")
        bridges = chosen.select(F.col("before").alias("src"), F.col("after").alias("dst"))
        live = written(kept.select("src", "dst").unionByName(bridges.where("src <> dst")).distinct())
        loops.append(bridges.where("src = dst").select(F.col("src").alias("node")))
        passed.append(chosen)


def _colors(edges: DataFrame) -> DataFrame:
    """(node, color): the largest node that reaches each node, itself included. Only nodes that changed send on."""
    frontier = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("color", F.col("node")))
    waves = [frontier]
    while True:
        sent = edges.join(frontier.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("sent"))
        now = _union(waves).join(sent, "node").groupBy("node").agg(F.max("color").alias("color"), F.max("sent").alias("sent"))
        frontier = written(now.where("sent > color").select("node", F.col("sent").alias("color")))
        if frontier.isEmpty():
            return written(_union(waves).groupBy("node").agg(F.max("color").alias("color")))
        waves = _compact([*waves, frontier])


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles of ``edges`` (src, dst); two share a component if each reaches the other.

    Chains and dead ends are contracted, what is left is coloured forward with the largest id, each root's component is
    collected backward within its colour and taken out, and the rest goes the same way. Bridged nodes
    then come back round by round: one lies on a cycle if both neighbours are in one component.
    """
    own = written(edges.where("src = dst").select(F.col("src").alias("node")).distinct())
    core, loops, passed = _contracted(edges)
    found = []
    if not core.isEmpty():
        color = _colors(core)
        inside = (core.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src")
                  .join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd"))
        members = written(reachable(color.where("node = color").select("node"), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        # A root alone is no cycle: it needs an edge to another member of its colour.
        both = inside.join(_named(members, "src"), "src", "left_semi").join(_named(members, "dst"), "dst", "left_semi")
        found.append(written(both.select(F.col("src").alias("node"), F.col("cs").alias("component")).union(both.select("dst", "cs")).distinct()))
        rest = written(core.join(_named(members, "src"), "src", "left_anti").join(_named(members, "dst"), "dst", "left_anti"))
        if not rest.isEmpty():
            found.append(strong_components(rest))
    known = _union([*found, loops.withColumn("component", F.col("node")).limit(0)])
    itself = lambda nodes: nodes.join(loops, "node", "left_semi").withColumn("component", F.col("node"))
    bridged = _union([loops.limit(0), *[p.select("node") for p in passed]])
    # A node with a loop is at least a component by itself; a bridged one may turn out to be in a larger one.
    free = loops.join(known.select("node"), "node", "left_anti").join(bridged, "node", "left_anti")
    parts = [written(known.unionByName(itself(free)))]
    for chosen in reversed(passed):
        of = lambda side: _union(parts).select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        back = (chosen.join(of("before"), "before").join(of("after"), "after").where("of_before = of_after")
                .select("node", F.col("of_before").alias("component")))
        alone = itself(chosen.join(back.select("node"), "node", "left_anti").select("node"))
        parts = _compact([*parts, written(back.unionByName(alone))])
    whole = _union(parts)
    return written(whole.unionByName(own.join(whole.select("node"), "node", "left_anti").withColumn("component", F.col("node"))))


def cyclic_members(edges: DataFrame) -> DataFrame:
    """(node): members of strongly connected components with a cycle, self-loops included."""
    return strong_components(edges).select("node").distinct()


# -- claims -------------------------------------------------------------------------------------------

STATES = ("governing", "superseded", "invalidated")


def _state(governed: Column, replaced: Column) -> Column:
    """Place in ``STATES`` of a claim whose counts are complete."""
    return F.when(F.col("deps") != governed, 2).when(replaced, 1).otherwise(0)


def _pick(name: str, by: Column) -> Column:
    """The effect column of an edge for the state of its source."""
    return F.when(by == 0, F.col(f"{name}0")).when(by == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}2"))


def governance(nodes: DataFrame, depends: DataFrame, supersedes: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(node, state, superseded): which claims govern.

    ``depends`` (node, need) and ``supersedes`` (node, target) are the relations of all claims; only
    ``nodes`` take part, and members of ``cyclic`` are left out. A claim is decided once every
    prerequisite and every replacement that takes part is decided. It issues its effects when all
    its prerequisites govern, and governs when it issues and nothing that issues replaces it.

    An edge holds its effect for each state of its source: ``g`` how many prerequisites it meets, ``r`` whether it
    replaces. A claim with one open influence is a function from that claim's three states to its own, so
    its edges start at that claim instead, with the two functions composed.
    """
    part = written(nodes.select("node").distinct().join(cyclic, "node", "left_anti"))
    deps = depends.select("node", "need").distinct()
    effect = lambda src, dst, g, r: [F.col(src).alias("src"), F.col(dst).alias("dst"), *[F.lit(v).alias(f"g{i}") for i, v in enumerate(g)],
                                     *[F.lit(v).alias(f"r{i}") for i, v in enumerate(r)]]
    merged = lambda df: df.groupBy("src", "dst").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(3)], *[F.max(f"r{i}").alias(f"r{i}") for i in range(3)])
    every = (deps.select(*effect("need", "node", (1, 0, 0), (False, False, False)))
             .unionByName(supersedes.select("node", "target").distinct().select(*effect("node", "target", (0, 0, 0), (True, True, False)))))
    live = written(merged(every.join(_named(part, "src"), "src", "left_semi").join(_named(part, "dst"), "dst", "left_semi")))
    left = written(part.join(deps.groupBy("node").agg(count_rows().alias("deps")), "node", "left").select(
        "node", F.coalesce("deps", F.lit(0)).alias("deps"), F.lit(0).cast("bigint").alias("governed"), F.lit(False).alias("replaced")))
    done: list[DataFrame] = []
    while True:
        ready = written(left.join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
                        .select("node", _state(F.col("governed"), F.col("replaced")).alias("code"), "replaced"))
        if ready.isEmpty():
            break
        done = _compact([*done, ready])
        hits = (live.join(ready.select(F.col("node").alias("src"), "code"), "src").groupBy(F.col("dst").alias("node"))
                .agg(F.sum(_pick("g", F.col("code"))).alias("g"), F.max(_pick("r", F.col("code"))).alias("r")))
        left = written(left.join(ready.select("node"), "node", "left_anti").join(hits, "node", "left").select(
            "node", "deps", (F.col("governed") + F.coalesce("g", F.lit(0))).alias("governed"), (F.col("replaced") | F.coalesce("r", F.lit(False))).alias("replaced")))
        open_ = written(live.join(_named(ready, "src"), "src", "left_anti"))
        singles = (open_.groupBy(F.col("dst").alias("node")).agg(count_rows().alias("n"), *[F.min(c).alias(c) for c in open_.columns if c != "dst"]).where("n = 1")
                   .join(left, "node").select(F.col("node").alias("src"), F.col("src").alias("one"), *[
                       _state(F.col("governed") + F.col(f"g{i}"), F.col("replaced") | F.col(f"r{i}")).alias(f"f{i}") for i in range(3)]))
        turned = lambda name: [F.when(F.col("one").isNull(), F.col(f"{name}{i}")).otherwise(_pick(name, F.col(f"f{i}"))).alias(f"{name}{i}") for i in range(3)]
        live = written(merged(open_.join(singles, "src", "left").select(F.coalesce("one", "src").alias("src"), "dst", *turned("g"), *turned("r"))))
    if not done:
        return left.select("node", F.lit(None).cast("string").alias("state"), F.col("replaced").alias("superseded"))
    name = F.get(F.array(*map(F.lit, STATES)), F.col("code"))
    return _union(done).select("node", name.alias("state"), F.col("replaced").alias("superseded"))


WORDS = 4  # 64-bit words of a premise filter


def _bit(node: str, word: int) -> Column:
    """Word ``word`` of a filter that holds one node."""
    place = f"pmod(xxhash64({node}), {64 * WORDS})"
    return F.expr(f"CASE WHEN {place} div 64 = {word} THEN shiftleft(1L, CAST({place} % 64 AS INT)) ELSE 0L END")


def premise_labels(depends: DataFrame) -> DataFrame:
    """(node, depth, b0..): for each node of an acyclic ``depends`` (node, need), its longest way down and a filter of all its premises.

    A premise has a smaller depth and its bit is in the filter; so a node that fails either test is none. Edges carry
    what lies on the way they stand for (``base`` the depth it already has, ``len`` what it adds), so a node with
    one open premise is passed over like the others.
    """
    words = range(WORDS)
    bits = lambda f: [f(w).alias(f"b{w}") for w in words]
    merged = lambda df: df.groupBy("node", "need").agg(F.max("len").alias("len"), F.max("base").alias("base"), *bits(lambda w: F.bit_or(f"b{w}")))
    pairs = written(depends.select("node", "need").distinct())
    zero = F.lit(0).cast("bigint")
    live = written(pairs.select("node", "need", F.lit(1).cast("bigint").alias("len"), zero.alias("base"), *bits(lambda w: zero)))
    left = written(pairs.select("node").union(pairs.select("need")).distinct().select("node", zero.alias("depth"), *bits(lambda w: zero)))
    done: list[DataFrame] = []
    none = left.limit(0)
    while True:
        ready = written(left.join(live.select("node").distinct(), "node", "left_anti"))
        if ready.isEmpty():
            return _union(done) if done else none
        done = _compact([*done, ready])
        below = ready.select(F.col("node").alias("need"), F.col("depth").alias("d"), *[F.col(f"b{w}").alias(f"n{w}") for w in words])
        full = lambda w: F.col(f"b{w}").bitwiseOR(F.col(f"n{w}")).bitwiseOR(_bit("need", w))
        hits = (live.join(below, "need").select("node", F.greatest(F.col("base"), F.col("len") + F.col("d")).alias("d"), *[full(w).alias(f"h{w}") for w in words])
                .groupBy("node").agg(F.max("d").alias("d"), *[F.bit_or(f"h{w}").alias(f"h{w}") for w in words]))
        left = written(left.join(ready.select("node"), "node", "left_anti").join(hits, "node", "left").select(
            "node", F.greatest("depth", F.coalesce("d", zero)).alias("depth"), *bits(lambda w: F.col(f"b{w}").bitwiseOR(F.coalesce(f"h{w}", zero)))))
        open_ = written(live.join(_named(ready, "need"), "need", "left_anti"))
        single = (open_.groupBy("node").agg(count_rows().alias("n"), *[F.min(c).alias(f"s_{c}") for c in open_.columns if c != "node"]).where("n = 1")
                  .join(left, "node").select(F.col("node").alias("need"), F.col("s_need").alias("one"), F.col("s_len").alias("one_len"), F.greatest("depth", "s_base").alias("one_base"),
                                             *[F.col(f"b{w}").bitwiseOR(F.col(f"s_b{w}")).alias(f"n{w}") for w in words]))
        over = F.col("one").isNotNull()
        live = written(merged(open_.join(single, "need", "left").select(
            "node", F.coalesce("one", "need").alias("need"), F.when(over, F.col("len") + F.col("one_len")).otherwise(F.col("len")).alias("len"),
            F.when(over, F.greatest(F.col("base"), F.col("len") + F.col("one_base"))).otherwise(F.col("base")).alias("base"),
            *bits(lambda w: F.when(over, full(w)).otherwise(F.col(f"b{w}"))))))


def rests_on(pairs: DataFrame, depends: DataFrame) -> DataFrame:
    """``pairs`` (node, target) without repeats, where ``target`` is a premise of ``node``, however far back; ``depends`` is acyclic.

    Labels decide most pairs. The others are walked, only through nodes whose own labels still allow the target, and
    a pair ends with its first hit.
    """
    labels = written(premise_labels(depends))
    words = range(WORDS)
    at = lambda column, to: labels.select(F.col("node").alias(column), F.col("depth").alias(to), *[F.col(f"b{w}").alias(f"{to}{w}") for w in words])
    allowed = reduce(Column.__or__, [F.col(f"up{w}").bitwiseAND(_bit("target", w)) != 0 for w in words]) & (F.col("low") < F.col("up"))
    asked = pairs.select("node", "target").where("node <> target").distinct()
    low = labels.select(F.col("node").alias("target"), F.col("depth").alias("low"))
    walk = written(asked.join(at("node", "up"), "node").join(low, "target").where(allowed).select("node", "target", "low", F.col("node").alias("at")))
    seen, found = [walk.select("node", "target", "at")], []
    edges = written(depends.select(F.col("node").alias("at"), "need").distinct())
    while not walk.isEmpty():
        step = written(walk.join(edges, "at").select("node", "target", "low", F.col("need").alias("at")).distinct())
        hit = written(step.where("at = target").select("node", "target"))
        found = _compact([*found, hit])
        walk = written(step.join(hit, ["node", "target"], "left_anti").join(at("at", "up"), "at").where(allowed)
                       .select("node", "target", "low", "at").join(_union(seen), ["node", "target", "at"], "left_anti"))
        seen = _compact([*seen, walk.select("node", "target", "at")])
    return _union(found) if found else asked.limit(0)


def conflicts(nodes: DataFrame, depends: DataFrame, supersedes: DataFrame, contradicts: DataFrame):
    """(governance, conflicted, cyclic): repeat governance without the parties of unresolved contradictions.

    A contradiction is resolved when some issuing claim replaces one side and none of that claim's
    premises, however far back, is a side of the same contradiction.
    """
    influence = (depends.select(F.col("need").alias("src"), F.col("node").alias("dst"))
                 .unionByName(supersedes.select(F.col("node").alias("src"), F.col("target").alias("dst"))))
    inside = influence.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    cyclic = written(cyclic_members(inside))
    pairs = written(contradicts.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    out = written(nodes.select("node").where(F.lit(False)))
    while True:
        gov = governance(nodes.join(out, "node", "left_anti"), depends, supersedes, cyclic)
        issuers = written(gov.where("state IN ('governing', 'superseded')").select("node"))
        both = written(pairs.join(issuers.withColumnRenamed("node", "a"), "a", "left_semi").join(issuers.withColumnRenamed("node", "b"), "b", "left_semi"))
        if both.isEmpty():
            return gov, out, cyclic
        side = both.select("a", "b", F.explode(F.array("a", "b")).alias("target"))
        helper = written(side.join(supersedes.join(issuers, "node", "left_semi"), "target").select("a", "b", F.col("node").alias("issuer")).distinct())
        # All premises of an issuer govern, so they lie among the issuers; only those below a helper matter.
        among = written(depends.join(issuers, "node", "left_semi").join(_named(issuers, "need"), "need", "left_semi").select("node", "need"))
        below = reachable(helper.select(F.col("issuer").alias("node")), among.select(F.col("node").alias("src"), F.col("need").alias("dst")))
        asked = helper.select(F.col("issuer").alias("node"), F.explode(F.array("a", "b")).alias("target")).distinct()
        spoils = written(rests_on(asked, among.join(below, "node", "left_semi")))
        spoiled = (helper.select("a", "b", "issuer", F.explode(F.array("a", "b")).alias("target"))
                   .join(spoils.withColumnRenamed("node", "issuer"), ["issuer", "target"], "left_semi").select("a", "b", "issuer").distinct())
        resolved = helper.join(spoiled, ["a", "b", "issuer"], "left_anti").select("a", "b").distinct()
        open_ = written(both.join(resolved, ["a", "b"], "left_anti"))
        if open_.isEmpty():
            return gov, out, cyclic
        out = written(out.unionByName(open_.select(F.explode(F.array("a", "b")).alias("node"))).distinct())
