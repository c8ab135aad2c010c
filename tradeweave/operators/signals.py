"""Findings as risk-signal records; high-risk entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import TradeGraph


def ladder(score: Column, high: float = 0.6) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= high, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")


def _signals(rows: DataFrame, kind: str, severity: Column, confidence: Column, ids: Column, payload: Column, as_of: str | None, source: str, metadata: Column | None = None) -> DataFrame:
    """Ids come from the contents, so a retry makes the same records."""
    body = F.to_json(payload)
    sid = F.concat(F.lit("SIG-"), F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit(kind), F.array_join(ids, ","), body), 256), 1, 12)))
    return rows.select(
        sid.alias("signal_id"), F.lit(kind).alias("signal_type"), F.lit(source).alias("source_system"), F.lit(as_of).cast("string").alias("timestamp"),
        severity.alias("severity"), F.least(confidence, F.lit(1.0)).alias("confidence"), ids.alias("entity_ids"), body.alias("payload"), F.coalesce(F.to_json(metadata) if metadata is not None else F.lit("{}"), F.lit("{}")).alias("metadata"),
    )


def entity_signals(graph: TradeGraph, min_risk: float = 0.3, as_of: str | None = None, source: str = "tradeweave") -> DataFrame:
    n = graph.nodes.where(F.coalesce("risk_score", F.lit(0.0)) >= min_risk)
    return _signals(n, "entity_risk", F.col("risk_level"), F.col("risk_score"), F.array("node_id"), F.struct("node_id", "node_type", "risk_score"), as_of, source)


def community_signals(communities: DataFrame, as_of: str | None = None, source: str = "tradeweave") -> DataFrame:
    """communities: community_id, size, risk_score, anomaly_indicators."""
    r = F.col("risk_score")
    return _signals(communities, "community_alert", ladder(r), r, F.array(F.col("community_id").cast("string")), F.struct("community_id", "size", "anomaly_indicators"), as_of, source)


def ring_signals(rings: DataFrame, as_of: str | None = None, source: str = "tradeweave") -> DataFrame:
    """rings: ring_type, ring_key, size, confidence."""
    c = F.col("confidence")
    severity = F.when(c >= 0.8, "CRITICAL").when(c >= 0.5, "HIGH").otherwise("MEDIUM")
    return _signals(rings, "fraud_ring_alert", severity, c, F.split("ring_key", ">"), F.struct("ring_type", "size"), as_of, source)


def change_signals(changes: DataFrame, as_of: str | None = None, source: str = "tradeweave") -> DataFrame:
    """changes: window_id, change_type, severity."""
    s = F.col("severity")
    return _signals(changes, "network_evolution", ladder(s, 0.5), s, F.array(F.col("window_id").cast("string")), F.struct("window_id", "change_type"), as_of, source)


def propagation_signals(affected: DataFrame, min_risk: float = 0.3, as_of: str | None = None, source: str = "tradeweave") -> DataFrame:
    r = F.col("risk")
    rows = affected.where(r >= min_risk)
    return _signals(rows, "entity_risk", ladder(r), r, F.array("node_id"), F.struct("source_node", "depth", (F.size("path") - 1).alias("hops")), as_of, source)


def flush(signals: DataFrame, path: str, batch_size: int = 100) -> None:
    """JSON files of at most batch_size signals each; nothing is dropped."""
    signals.write.mode("append").option("maxRecordsPerFile", batch_size).json(path)


def high_risk(graph: TradeGraph, min_risk: float = 0.5, limit: int | None = 50, node_type: str | None = None) -> DataFrame:
    """node_id, node_type, risk_score, risk_level, flagged, indicators, neighbor_count; the riskiest first.

    neighbor_count is the degree: parallel edges count. Only edges of the nodes at risk are counted.
    """
    n = graph.nodes.where(F.coalesce("risk_score", F.lit(0.0)) >= min_risk)
    if node_type:
        n = n.where(F.col("node_type") == node_type)
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("node_id")).join(n.select("node_id"), "node_id", "left_semi")
    n = n.join(ends.groupBy("node_id").agg(F.count("*").alias("neighbor_count")), "node_id", "left").fillna(0, ["neighbor_count"])
    flags = F.array_compact(F.array(F.when(F.col("flagged"), "directly_flagged"), F.when(F.col("risk_score") >= 0.8, "critical_risk"), F.when(F.col("neighbor_count") > 20, "high_connectivity")))
    out = n.select("node_id", "node_type", "risk_score", "risk_level", F.coalesce("flagged", F.lit(False)).alias("flagged"), flags.alias("indicators"), "neighbor_count")
    return out if limit is None else out.orderBy(F.desc("risk_score"), "node_id").limit(limit)
