"""Connected components by random contraction.

Each round gives every node a random order of its own (a bijective hash), merges it into the first
of its neighbours and keeps one edge between what is left, so the number of nodes falls by a
constant factor whatever the shape (a long chain too). The maps of all rounds are then folded from
the last, smallest one to the first. No node, edge or component reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b: bigint) with the smallest node it reaches.

    Loops, repeats and null ends are ignored. No edges give no rows. There is no cap on rounds.
    """
    live = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not live.isEmpty():
        order = lambda c: F.xxhash64(F.lit(len(maps)), c)  # noqa: E731  one-to-one on bigint
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        into = durable(both.groupBy(F.col("a").alias("node")).agg(F.min(order(F.col("b"))).alias("to"))
                       .select("node", F.least("to", order(F.col("node"))).alias("to")))
        live = durable(
            live.join(into.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(into.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        maps.append(into)
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # A node's last name and the round that gave it: equal only inside a component.
    ends = maps[-1].select("node", "to", F.lit(len(maps)).alias("round"))
    for depth in range(len(maps) - 2, -1, -1):
        later = ends.select(F.col("node").alias("to"), F.col("to").alias("last"), F.col("round"))
        ends = durable(maps[depth].join(later, "to", "left").select(
            "node", F.coalesce("last", "to").alias("to"), F.coalesce("round", F.lit(depth + 1)).alias("round")))
    # Stored, so that a component with a third of all nodes is a skewed join that Spark can split.
    first = durable(ends.groupBy("to", "round").agg(F.min("node").alias("component")))
    return ends.join(first, ["to", "round"]).select("node", "component")
