"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.storage import drop_table, write_table


def _flatten(parents: DataFrame) -> DataFrame:
    """Pointer jumping: every node of the forest ``(node, root)`` gets the root of its tree.

    The forest's depth halves with each step. Only the table of links is moved, never a tree's members.
    """
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        jumped = write_table(
            parents.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")), "jump"
        )
        moved = not jumped.where("_moved").isEmpty()
        drop_table(parents)
        parents = jumped.drop("_moved")
        if not moved:
            return parents


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``(node, component)`` for each node of ``edges``; ``component`` is the smallest node it is joined to.

    Nodes may be of any type that Spark can hash and order (structs, too). Self edges and repeated edges are
    allowed; an edge with a null end is ignored; no edges give no rows.

    Rounds of contraction: each node hangs itself under the neighbour of least priority, if that is less than
    its own, the trees are flattened, and the edges between different trees go to the next round. Priorities
    are hashes that change with the round, so each round about halves the nodes left whatever the shape of the
    graph (a chain of n nodes takes about log2(n) rounds), and there is no cap on rounds. All steps are map-side
    combined groupings and joins against one row per node, which adaptive execution splits when a node is hot.
    """
    x, y = F.col(a), F.col(b)
    live = write_table(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")).distinct(), "edges"
    )
    maps: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("p"), F.col(c).alias("v"))  # noqa: B023
        both = live.union(live.select("dst", "src"))
        best = both.groupBy("src").agg(F.min(rank("dst")).alias("_best"))
        parents = write_table(
            best.select(F.col("src").alias("node"), F.when(F.col("_best") < rank("src"), F.col("_best.v")).otherwise(F.col("src")).alias("root")),
            "parents",
        )
        flat = _flatten(parents)
        maps.append(flat)
        to = lambda side, name: flat.select(F.col("node").alias(side), F.col("root").alias(name))  # noqa: B023
        ends = live.join(to("src", "_s"), "src").join(to("dst", "_d"), "dst").where(F.col("_s") != F.col("_d"))
        following = write_table(ends.select(F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst")).distinct(), "edges")
        drop_table(live)
        live = following
    if not maps:
        return live.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    member = maps[0]
    for later in maps[1:]:
        up = later.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        member = member.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    member = write_table(member, "members")
    for m in maps:
        drop_table(m)
    least = member.groupBy("root").agg(F.min("node").alias("component"))
    return member.join(least, "root").select("node", "component")
