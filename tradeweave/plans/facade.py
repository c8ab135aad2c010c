"""The eight questions of the query interface, each a DataFrame, and a health report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Propagation
from ..operators import community, propagation, rings, signals, traversal
from ..operators.graph import TradeGraph


class Questions:
    """Nothing here changes the graph."""

    def __init__(self, graph: TradeGraph):
        self.graph = graph

    def node(self, node_id: str) -> DataFrame:
        return self.graph.node(node_id)

    def neighbors(self, node_id: str, edge_type: str | None = None, direction: str = "both", max_depth: int = 1) -> DataFrame:
        """Node rows; beyond depth 1 all edge types and both directions count."""
        if max_depth <= 1:
            return self.graph.neighbors(node_id, edge_type, direction)
        return self.graph.nodes.join(traversal.khop(self.graph, node_id, max_depth).select("node_id"), "node_id", "left_semi")

    def shortest_path(self, source: str, target: str, weighted: bool = False) -> DataFrame:
        return traversal.shortest_path(self.graph, source, target, weighted)

    def communities(self, algorithm: str = "louvain", resolution: float = 1.0, min_size: int = 3) -> DataFrame:
        return community.metrics(self.graph, community.detect(self.graph, algorithm, resolution), min_size).orderBy(F.desc("size"), "community_id")

    def community_members(self, partition: DataFrame, most: int = 100) -> DataFrame:
        """community_id, node_id, node_type: at most so many members of each, the smallest ids first. partition: node_id, community_id."""
        first = Window.partitionBy("community_id").orderBy("node_id")
        p = partition.select("node_id", "community_id").withColumn("at", F.row_number().over(first)).where(F.col("at") <= most).drop("at")
        return p.join(self.graph.nodes.select("node_id", "node_type"), "node_id").select("community_id", "node_id", "node_type")

    def high_risk_entities(self, min_risk: float = 0.5, limit: int | None = 50, node_type: str | None = None) -> DataFrame:
        return signals.high_risk(self.graph, min_risk, limit, node_type)

    def statistics(self) -> dict[str, object]:
        return self.graph.statistics()

    def fraud_rings(self, min_confidence: float = 0.5) -> DataFrame:
        return rings.detect(self.graph, min_confidence=min_confidence).orderBy(F.desc("confidence"), "ring_type", "ring_key")

    def propagate_risk(self, node_id: str, risk: float = 0.8, max_depth: int = 4, top: int = 20) -> DataFrame:
        """The top nodes by risk; no rows for an unknown node."""
        s = self.graph.node(node_id).select("node_id", F.lit(risk).alias("risk"))
        return propagation.propagate(self.graph, s, Propagation(max_depth=max_depth)).orderBy(F.desc("risk"), "node_id").limit(top)

    def health(self) -> dict[str, object]:
        return {"status": "healthy", "nodes": self.graph.node_count(), "edges": self.graph.edge_count()}
