"""Breadth-first search, paths, components and bounded simple cycles.

Each is a loop of joins with a table written to the shared folder per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import dropped, stored
from .cycles import core_of, cycles
from .graph import TradeGraph


def khop(graph: TradeGraph, start: str, max_depth: int) -> DataFrame:
    """node_id, depth of nodes within max_depth undirected hops, without the start."""
    e = graph.edges
    seen = graph.nodes.where(F.col("node_id") == start).select("node_id", F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        front = seen.where(F.col("depth") == depth - 1).select(F.col("node_id").alias("at"))
        # edges meet the front at either end; only what is found is made distinct
        found = e.join(front, e["src"] == front["at"]).select(F.col("dst").alias("node_id")).union(e.join(front, e["dst"] == front["at"]).select("src")).distinct()
        new = found.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(depth))
        before, seen = seen, stored(seen.union(new))
        dropped(before)
    return seen.where("depth > 0")


def shortest_path(graph: TradeGraph, source: str, target: str, weighted: bool = False, max_rounds: int = 64) -> DataFrame:
    """path (array), length (hops), distance of the shortest directed path; no row if there is none.

    Parallel edges count at their smallest weight; ties go to the
    lexicographically smallest path. max_rounds bounds the hops; a search that
    has not settled by then raises.
    """
    cost = F.coalesce("weight", F.lit(1.0)) if weighted else F.lit(1.0)
    e = graph.edges.where("src <> dst").groupBy("src", "dst").agg(F.min(cost).alias("w"))
    known = graph.nodes.where(F.col("node_id") == source).select("node_id", F.lit(0.0).alias("d"), F.array("node_id").alias("path"))
    front = known
    for _ in range(max_rounds):
        step = front.join(e, front["node_id"] == e["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.col("dst").alias("node_id"), (F.col("d") + F.col("w")).alias("d"), F.concat("path", F.array("dst")).alias("path"))
        goal = known.where(F.col("node_id") == target).agg(F.min("d").alias("best"))
        step = step.crossJoin(F.broadcast(goal)).where("best is null or d <= best").drop("best")
        both = known.withColumn("new", F.lit(0)).unionByName(step.withColumn("new", F.lit(1)))
        best = both.groupBy("node_id").agg(F.min(F.struct("d", "path", "new")).alias("b")).select("node_id", "b.*")
        best = stored(best)
        known, front = best.drop("new"), best.where("new = 1").drop("new")
        if front.isEmpty():
            break
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    return known.where(F.col("node_id") == target).select("path", (F.size("path") - 1).alias("length"), F.col("d").alias("distance"))


def label_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (smallest node reachable) of the nodes in undirected pairs.

    Large-star and small-star steps in turn, until every node has one edge, to a
    root that has none. No node's neighbours meet in one row: steps take minima
    by key and join them back, which adaptive execution can split. Self-loops and
    repeats don't matter; nodes without another are left out.
    """
    e = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        dropped(e)
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = stored(small.where("u <> v").distinct())
        dropped(large)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v"), F.col("v")).distinct().toDF("node", "component"))


def components(graph: TradeGraph) -> DataFrame:
    """node_id, component: smallest node id of the weakly connected component."""
    found = label_components(graph.edges, "src", "dst")
    return graph.nodes.select("node_id").join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def simple_cycles(edges: DataFrame, max_length: int, min_length: int = 3) -> DataFrame:
    """cycle (array): simple directed cycles of src, dst pairs, each once, from its smallest node."""
    return cycles(edges, core_of(edges), max_length, min_length).select("cycle")
