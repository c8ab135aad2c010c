"""The graph as two DataFrames: lookups, projections, upserts, statistics, persistence."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGES, ENDPOINTS, NODES


@dataclass(frozen=True)
class TradeGraph:
    """nodes: node_id, node_type and attributes; edges: one for each (src, dst, edge_type).

    single: no two edges join the same two nodes, in either direction, so that pairs needn't be made distinct or summed.
    """

    nodes: DataFrame
    edges: DataFrame
    single: bool = False

    # Lookups

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def nodes_by_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("node_type") == node_type)

    def edges_where(self, src: str | None = None, dst: str | None = None, edge_type: str | None = None) -> DataFrame:
        given = {"src": src, "dst": dst, "edge_type": edge_type}
        return reduce(lambda e, x: e.where(F.col(x[0]) == x[1]), [(k, v) for k, v in given.items() if v is not None], self.edges)

    def neighbors(self, node_id: str, edge_type: str | None = None, direction: str = "both") -> DataFrame:
        """Distinct neighbours as node rows; none for an unknown node."""
        if direction not in ("out", "in", "both"):
            raise ValueError(f"unknown direction {direction}")
        e = self.edges_where(edge_type=edge_type)
        out = e.where(F.col("src") == node_id).select(F.col("dst").alias("node_id"))
        into = e.where(F.col("dst") == node_id).select(F.col("src").alias("node_id"))
        ids = out if direction == "out" else into if direction == "in" else out.union(into)
        return self.nodes.join(ids.distinct(), "node_id", "left_semi")

    def subgraph(self, ids: DataFrame) -> TradeGraph:
        """Nodes among ids (column node_id), and edges with both ends among them."""
        ids = ids.select("node_id").distinct()
        e = self.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
        e = e.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(self.edges.columns)
        return TradeGraph(self.nodes.join(ids, "node_id", "left_semi"), e)

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    # Updates return new graphs

    def upsert_nodes(self, rows: DataFrame) -> TradeGraph:
        """Given attributes overwrite those of nodes with the same id; new ids and new attributes are added.

        Nulls overwrite nothing. Of rows that repeat an id the greatest value of each attribute counts.
        """
        return TradeGraph(_upserted(self.nodes, rows, ["node_id"]), self.edges)

    def upsert_edges(self, rows: DataFrame) -> TradeGraph:
        """The same for edges, by (src, dst, edge_type); endpoints that are unknown become bare nodes."""
        ends = rows.select(F.col("src").alias("node_id")).union(rows.select("dst")).distinct()
        bare = ends.join(self.nodes.select("node_id"), "node_id", "left_anti")
        return TradeGraph(self.nodes.unionByName(bare, allowMissingColumns=True), _upserted(self.edges, rows, ["src", "dst", "edge_type"]))

    def cleared(self) -> TradeGraph:
        return TradeGraph(self.nodes.limit(0), self.edges.limit(0))

    # Projections

    def simple_digraph(self) -> DataFrame:
        """src, dst, weight: parallel edges summed."""
        if self.single:
            return self.edges.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        return self.edges.groupBy("src", "dst").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))

    def undirected(self) -> DataFrame:
        """a <= b, weight: parallel and reciprocal edges summed."""
        ends = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
        if self.single:
            return self.edges.select(*ends, F.coalesce("weight", F.lit(1.0)).alias("weight"))
        return self.edges.groupBy(*ends).agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))

    def adjacency(self) -> DataFrame:
        """node_id, other, for each distinct pair in either direction."""
        one = self.edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other"))
        both = one.union(one.select("other", "node_id"))
        return both if self.single else both.distinct()

    def degrees(self) -> DataFrame:
        """node_id, in_degree, out_degree, degree of all nodes; parallel edges count."""
        ends = self.edges.select(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(self.edges.select("dst", F.lit(1), F.lit(0)))
        d = ends.groupBy("node_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        d = self.nodes.select("node_id").join(d, "node_id", "left")
        i, o = F.coalesce("i", F.lit(0)).cast("bigint"), F.coalesce("o", F.lit(0)).cast("bigint")
        return d.select("node_id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"))

    # Statistics and checks

    def type_counts(self) -> tuple[DataFrame, DataFrame]:
        return (
            self.nodes.groupBy("node_type").agg(F.count("*").alias("count")),
            self.edges.groupBy("edge_type").agg(F.count("*").alias("count")),
        )

    def totals(self) -> DataFrame:
        """nodes, edges, density, components, connected; one row."""
        from .traversal import components

        n = self.nodes.agg(F.count("*").alias("nodes"))
        e = self.edges.agg(F.count("*").alias("edges"))
        c = components(self).agg(F.count_distinct("component").alias("components"))
        pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1)
        density = F.when((F.col("nodes") > 1) & (F.col("edges") > 0), F.col("edges") / pairs).otherwise(0.0)
        return n.crossJoin(e).crossJoin(c).select("nodes", "edges", density.alias("density"), "components", (F.col("components") == 1).alias("connected"))

    def statistics(self) -> dict[str, object]:
        """Totals, and the number of nodes and edges of each type: as many entries as there are types."""
        nodes, edges = self.type_counts()
        found = self.totals().first().asDict()
        return found | {"node_types": {r["node_type"]: r["count"] for r in nodes.collect()}, "edge_types": {r["edge_type"]: r["count"] for r in edges.collect()}}

    def save_statistics(self, path: str) -> None:
        """The statistics as a JSON file."""
        spark = self.nodes.sparkSession
        spark.createDataFrame([(json.dumps(self.statistics(), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def records(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as JSON records without null attributes, a row each."""
        one = lambda df: df.select(F.to_json(F.struct(*df.columns)).alias("record"))
        return one(self.nodes), one(self.edges)

    @classmethod
    def from_records(cls, nodes: DataFrame, edges: DataFrame) -> TradeGraph:
        """The graph of such records; attributes outside NODES and EDGES are left out."""
        one = lambda df, schema: df.select(F.from_json("record", schema).alias("r")).select("r.*")
        return cls(one(nodes, NODES), one(edges, EDGES))

    def violations(self) -> DataFrame:
        """Edges whose endpoint types the ontology doesn't allow."""
        t = self.nodes.select("node_id", "node_type")
        e = self.edges.join(t.select(F.col("node_id").alias("src"), F.col("node_type").alias("src_type")), "src").join(
            t.select(F.col("node_id").alias("dst"), F.col("node_type").alias("dst_type")), "dst"
        )
        ok = F.lit(False)
        for kind, (s, d) in ENDPOINTS.items():
            ok |= (F.col("edge_type") == kind) & (F.col("src_type").isin(*s) if s else F.lit(True)) & (F.col("dst_type").isin(*d) if d else F.lit(True))
        return e.where(~ok)

    # Persistence

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TradeGraph:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    @classmethod
    def empty(cls, spark: SparkSession) -> TradeGraph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def _upserted(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    given = [c for c in rows.columns if c not in keys]
    new = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in given]) if given else rows.select(*keys).distinct()
    n, o = new.alias("n"), old.alias("o")
    kinds = dict(old.dtypes)
    columns = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys]
    columns += [F.coalesce(F.col(f"n.{c}").cast(kinds[c]), F.col(f"o.{c}")).alias(c) if c in given else F.col(f"o.{c}") for c in old.columns if c not in keys]
    columns += [F.col(f"n.{c}") for c in given if c not in old.columns]
    return o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer").select(columns)


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns as columns named key_sub, for flat sinks; arrays stay."""
    columns = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            columns += [F.col(f"{f.name}.{s.name}").alias(f"{f.name}_{s.name}") for s in f.dataType.fields]
        else:
            columns.append(F.col(f.name))
    return df.select(columns)


def create_store(spark: SparkSession, backend: str = "memory", path: str | None = None) -> TradeGraph:
    if backend == "memory":
        return TradeGraph.empty(spark)
    if backend == "parquet" and path:
        return TradeGraph.load(spark, path)
    raise ValueError(f"Unknown backend: {backend}")
