"""A directed graph condensed to its strongly connected components and dealt into levels.

Nodes without outgoing edges, the leaves, are most of a lineage graph. They stay outside: each
stands beside the components of its parents, takes its values from them in one join, and is
neither numbered nor peeled. What follows concerns the inner nodes, all parents.

Ids become numbers in their own order. Nodes without incoming or without outgoing edges
are peeled off from both ends, which gives every node of an acyclic graph its level: an edge
leads to a higher one. What is left is a core with cycles; its components are found by
spreading minima forward and walking back from them, and the condensed graph is peeled
anew. ``sweep`` then carries values from level to level: every edge is used once, and a
level reads only the levels that lead to it. No round looks at all that is known.

Rounds are settled: a level's values are files, which a lost executor reads again. The
number of rounds follows the depth of the graph, not its size; the driver holds a few
numbers per pair of levels.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.session import discard, scratch, settle


@dataclass
class Graph:
    """``members(id, node, comp)`` of all inner nodes; ``leaves(id, comp)`` with the components of their parents;
    ``inner(parent, child)`` the edges between inner nodes; ``cyclic(comp)`` have several members or a loop;
    ``levels(comp, level)``; ``links(up, down, up_level, down_level)`` between components."""

    members: DataFrame
    leaves: DataFrame
    inner: DataFrame
    cyclic: DataFrame
    levels: DataFrame
    links: DataFrame
    leads: dict[int, list[int]]  # to each level: the levels that lead to it

    def components(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` of inner nodes with the number and the component of the node named in ``key``."""
        return rows.join(self.members.withColumnRenamed("id", key), key)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def peel(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, level) of what can be peeled from links(up, down), and the links of the core, None where there is none.

    Sources of round k have level k, sinks of round k of K in all have level 2K - k; nodes that
    vanish between the two have level K, and no edge leads from one of them to another.
    """
    left, firsts, lasts = links, [], []
    size = None
    while True:
        downs = left.select(F.col("down").alias("up"), F.lit(True).alias("has_in")).distinct()
        ups = left.select(F.col("up").alias("down"), F.lit(True).alias("has_out")).distinct()
        flagged = settle(left.join(downs, "up", "left").join(ups, "down", "left").select(
            "up", "down", F.col("has_in").isNull().alias("source"), F.col("has_out").isNull().alias("sink")))
        n, kept = flagged.agg(F.count(F.lit(1)), F.count_if(~F.col("source") & ~F.col("sink"))).first()
        if n:
            firsts.append(flagged.where("source").select(F.col("up").alias("node")).distinct())
            lasts.append(flagged.where("sink").select(F.col("down").alias("node")).distinct())
        left = flagged.where("not source and not sink").select("up", "down")
        if not kept or kept == size:
            break
        size = kept
    rounds = len(firsts)
    every = links.select(F.col("up").alias("node")).union(links.select("down"))
    levels = [every.withColumn("level", F.lit(rounds)).withColumn("own", F.lit(False))]
    for k, (a, b) in enumerate(zip(firsts, lasts)):
        levels += [a.withColumn("level", F.lit(k)).withColumn("own", F.lit(True)), b.withColumn("level", F.lit(2 * rounds - k)).withColumn("own", F.lit(True))]
    level = F.coalesce(F.max(F.when(F.col("own"), F.col("level"))), F.max("level"))
    return _union(levels).groupBy("node").agg(level.alias("level")), (left if kept else None)


def _spread(links: DataFrame) -> DataFrame:
    """(node, value): the smallest node among itself and its ancestors."""
    every = links.select(F.col("up").alias("node")).union(links.select("down")).distinct()
    known = settle(every.withColumn("value", F.col("node")))
    moved = known
    while True:
        sent = links.join(moved.withColumnRenamed("node", "up"), "up").groupBy(F.col("down").alias("node")).agg(F.min("value").alias("new"))
        after = settle(known.join(sent, "node", "left").select(
            "node", F.least("value", F.coalesce("new", "value")).alias("value"), (F.col("new") < F.col("value")).alias("moved")))
        known, moved = after.select("node", "value"), after.where("moved").select("node", "value")
        if moved.isEmpty():
            return known


def strong_components(core: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of components with several members; comp is the smallest node of it."""
    left, found = settle(core.distinct()), []
    while not left.isEmpty():
        colour = _spread(left)
        # A component lies inside one colour, and holds the colour's root if the root is on a cycle.
        inside = settle(left.join(colour.select(F.col("node").alias("up"), F.col("value").alias("root")), "up")
                        .join(colour.select(F.col("node").alias("down"), F.col("value").alias("down_root")), "down")
                        .where("root = down_root").select("up", "down", "root"))
        known = frontier = settle(colour.where("node = value").select("node", F.col("value").alias("root")))
        while True:
            step = inside.join(frontier.select(F.col("node").alias("down"), "root"), ["down", "root"]).select(F.col("up").alias("node"), "root").distinct()
            frontier = settle(step.join(known, ["node", "root"], "left_anti"))
            if frontier.isEmpty():
                break
            known = known.union(frontier)
        known = settle(known)
        found.append(known)
        gone = known.select("node")
        left = left.join(gone.withColumnRenamed("node", "up"), "up", "left_anti").join(gone.withColumnRenamed("node", "down"), "down", "left_anti")
        left = peel(settle(left))[1]
        if left is None:
            break
    every = _union(found)
    several = every.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    return settle(every.join(several, "root", "left_semi").select("node", F.col("root").alias("comp")))


def condense(edges: DataFrame) -> Graph:
    """The graph of edges(parent, child)."""
    whole = edges.where("parent is not null and child is not null").select("parent", "child")
    parents = settle(whole.select(F.col("parent").alias("id")).distinct())
    # Joined by child, so equal edges meet in the same task.
    told = settle(whole.join(parents.select(F.col("id").alias("child"), F.lit(True).alias("inner")), "child", "left")
                  .select("parent", "child", F.col("inner").isNotNull().alias("inner")).distinct())
    inner = settle(told.where("inner").select("parent", "child"))
    # Sorted in ranges: the numbers have gaps, but the order of the ids.
    named = settle(parents.orderBy("id").withColumn("node", F.monotonically_increasing_id()))
    all_links = settle(inner.join(named.select(F.col("id").alias("parent"), F.col("node").alias("up")), "parent")
                       .join(named.select(F.col("id").alias("child"), F.col("node").alias("down")), "child")
                       .select("up", "down"))
    links = all_links.where("up <> down")
    cyclic = all_links.where("up = down").select(F.col("up").alias("comp"))
    levels, core = peel(links)
    if core is None:
        members = named.withColumn("comp", F.col("node"))
    else:
        comps = strong_components(core)
        members = settle(named.join(comps, "node", "left").select("id", "node", F.coalesce("comp", "node").alias("comp")))
        of = comps.select(F.col("node").alias("n"), "comp")
        links = settle(links.join(of.select(F.col("n").alias("up"), F.col("comp").alias("u")), "up", "left")
                       .join(of.select(F.col("n").alias("down"), F.col("comp").alias("d")), "down", "left")
                       .select(F.coalesce("u", "up").alias("up"), F.coalesce("d", "down").alias("down")).where("up <> down").distinct())
        cyclic = settle(comps.select("comp").union(
            cyclic.join(of.withColumnRenamed("n", "loop").withColumnRenamed("comp", "c"), F.col("comp") == F.col("loop"), "left").select(F.coalesce("c", "comp"))).distinct())
        levels, _ = peel(links)
    levels = settle(levels.withColumnRenamed("node", "comp"))
    path = scratch(edges.sparkSession, "links")
    (links.join(levels.select(F.col("comp").alias("up"), F.col("level").alias("up_level")), "up")
     .join(levels.select(F.col("comp").alias("down"), F.col("level").alias("down_level")), "down")
     .select("up", "down", "up_level", "down_level").write.partitionBy("down_level", "up_level").parquet(path))
    schema = "up bigint, down bigint, down_level int, up_level int"
    links = edges.sparkSession.read.schema(schema).parquet(path)
    leads = defaultdict(list)
    for a, b in links.select("up_level", "down_level").distinct().collect():
        leads[b].append(a)
    leaves = settle(told.where("not inner").join(members.select(F.col("id").alias("parent"), "comp"), "parent").select(F.col("child").alias("id"), "comp"))
    discard(told)
    return Graph(members, leaves, inner, cyclic, levels, links, dict(leads))


def sweep(graph: Graph, own: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(comp, value): what reaches a component from those strictly above it, of own(comp, value).

    ``merge`` makes one set of rows out of all that meet at a component, such as a minimum
    or distinct rows, and doesn't mind the order or repeats.
    """
    placed = settle(own.join(graph.levels, "comp").select("comp", "value", "level"))
    reached: dict[int, DataFrame] = {}
    for level in sorted(graph.leads):
        parts = []
        for above in graph.leads[level]:
            mine = placed.where(F.col("level") == above).select("comp", "value")
            state = mine if above not in reached else mine.union(reached[above])
            links = graph.links.where((F.col("down_level") == level) & (F.col("up_level") == above)).select("up", "down")
            parts.append(links.join(state.withColumnRenamed("comp", "up"), "up").select(F.col("down").alias("comp"), "value"))
        reached[level] = settle(merge(_union(parts)))
    return _union(list(reached.values())) if reached else placed.where("false").select("comp", "value")
