"""Decaying risk propagation by levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Propagation
from ..functions.normalize import risk_level
from ..plans.tables import stored
from .graph import TradeGraph


def propagate(graph: TradeGraph, sources: DataFrame, cfg: Propagation | None = None) -> DataFrame:
    """source_node, node_id, risk, depth, path, edge_type, decay_applied for each node reached.

    sources: node_id, risk (null: the node's risk_score, .5 without one). A step
    multiplies the parent's risk by decay, type weight and the edge weight up to
    1. Within a level the highest risk wins, then the smallest parent; nodes keep
    the level that reached them first. Unknown sources raise ValueError.
    """
    cfg = cfg or Propagation()
    s = sources.join(graph.nodes.select("node_id", "risk_score"), "node_id", "left")
    known = graph.nodes.select("node_id")
    if not sources.join(known, "node_id", "left_anti").isEmpty():
        raise ValueError("unknown source node")
    w = F.lit(cfg.other_weight)
    for kind, value in cfg.type_weights.items():
        w = F.when(F.col("edge_type") == kind, value).otherwise(w)
    factor = cfg.decay * w * F.least(F.coalesce("weight", F.lit(1.0)), F.lit(1.0))
    one = graph.edges.select(F.col("src").alias("parent"), F.col("dst").alias("child"), "edge_type", factor.alias("f"))
    steps = stored(one.unionByName(one.select(F.col("child").alias("parent"), F.col("parent").alias("child"), "edge_type", "f")))
    seen = stored(s.select(F.col("node_id").alias("source_node"), "node_id", F.coalesce("risk", "risk_score", F.lit(0.5)).alias("risk"), F.lit(0).alias("depth"), F.array("node_id").alias("path"), F.lit(None).cast("string").alias("edge_type")))
    best = Window.partitionBy("source_node", "node_id").orderBy(F.desc("risk"), "parent", "edge_type")
    for depth in range(1, cfg.max_depth + 1):
        front = seen.where(F.col("depth") == depth - 1).select("source_node", F.col("node_id").alias("parent"), "risk", "path")
        new = front.join(steps, "parent").select("source_node", F.col("child").alias("node_id"), (F.col("risk") * F.col("f")).alias("risk"), "parent", "edge_type", "path")
        new = new.where(F.col("risk") >= cfg.threshold).join(seen.select("source_node", "node_id"), ["source_node", "node_id"], "left_anti")
        new = new.withColumn("r", F.row_number().over(best)).where("r = 1")
        new = new.select("source_node", "node_id", "risk", F.lit(depth).alias("depth"), F.concat("path", F.array("node_id")).alias("path"), "edge_type")
        seen = stored(seen.unionByName(new))
    return seen.where("depth > 0").withColumn("decay_applied", F.pow(F.lit(cfg.decay), F.col("depth")))


def applied(graph: TradeGraph, affected: DataFrame, sources: DataFrame | None = None) -> TradeGraph:
    """The graph with risks raised to what reached each node; sources get their risk and a flag."""
    a = affected.groupBy("node_id").agg(F.max("risk").alias("new"))
    n = graph.nodes.join(a, "node_id", "left")
    old = F.coalesce("risk_score", F.lit(0.0))
    if sources is not None:
        n = n.join(sources.select("node_id", F.col("risk").alias("own")), "node_id", "left")
        score = F.coalesce("own", F.greatest(old, F.coalesce("new", old)))
        n = n.withColumn("flagged", F.coalesce("flagged", F.lit(False)) | F.col("own").isNotNull())
    else:
        score = F.greatest(old, F.coalesce("new", old))
    n = n.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score")))
    return TradeGraph(n.select(graph.nodes.columns), graph.edges)


def reset(graph: TradeGraph) -> TradeGraph:
    return TradeGraph(graph.nodes.withColumns({"risk_score": F.lit(0.0), "risk_level": F.lit("LOW"), "flagged": F.lit(False)}), graph.edges)


def summary(graph: TradeGraph, threshold: float = 0.1) -> DataFrame:
    """One row of counts and statistics of the nodes' risk."""
    r = F.coalesce("risk_score", F.lit(0.0))
    levels = [F.count_if(risk_level(r) == x).alias(x.lower()) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]
    return graph.nodes.agg(
        F.count("*").alias("total_nodes"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.max(r).alias("max"), F.stddev_pop(r).alias("std"),
        F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged"), F.count_if(r >= threshold).alias("at_risk"), *levels,
    )


def totals(affected: DataFrame) -> DataFrame:
    """source_node, affected (nodes), max_depth, total_risk of a propagation."""
    return affected.groupBy("source_node").agg(F.count("*").alias("affected"), F.max("depth").alias("max_depth"), F.sum("risk").alias("total_risk"))


def riskiest(graph: TradeGraph, k: int = 10) -> DataFrame:
    """node_id, node_type, risk_score, risk_level of the k nodes at the highest risk above 0."""
    n = graph.nodes.where("risk_score > 0").select("node_id", "node_type", "risk_score", "risk_level")
    return n.orderBy(F.desc("risk_score"), "node_id").limit(k)
