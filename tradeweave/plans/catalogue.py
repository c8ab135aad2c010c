"""Registered queries over the star-schema tables, and their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Carousel, EdgeWeights
from ..functions import normalize as N
from ..operators import build as B
from ..operators import centrality as C
from ..operators import community as M
from ..operators import evidence as V
from ..operators import propagation as P
from ..operators import resolution as X
from ..operators import rings as R
from ..operators import shell as H
from ..operators import signals as E
from ..operators import temporal as W
from ..operators import traversal as G
from ..operators.graph import TradeGraph
from ..sources import declarations as D
from ..sources import star as S
from .oracles import AS_OF, oracles
from .tables import stored

_built: dict[tuple[str, str], TradeGraph] = {}


def graph(spark: SparkSession, sf_dir: str) -> TradeGraph:
    """The declaration graph of the tables, built once a session; its nodes and edges are read from stored tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        if (g := S.graph(spark, sf_dir, AS_OF)) is None:
            g = B.build(D.from_tables(spark, sf_dir), AS_OF)
            g = TradeGraph(stored(g.nodes), stored(g.edges))
        _built[key] = g
    return _built[key]


def companies(spark: SparkSession, sf_dir: str) -> TradeGraph:
    """A graph with cycles: customers and suppliers of the same key are one company, with all its links."""
    f = D.flat(spark, sf_dir)
    e = f.where("imp <> exp")
    e = e.groupBy(F.col("imp").alias("src"), F.col("exp").alias("dst")).agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total_value"), F.count("*").alias("transaction_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    e = stored(e.withColumns({"edge_type": F.lit("IMPORTS_FROM"), "weight": F.lit(1.0)}))
    c = spark.table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    only = spark.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    c = c.unionByName(only.join(c.select("key"), "key", "left_anti"))
    c = c.join(spark.table("nation"), F.col("nation") == F.col("n_nationkey"), "left")
    nodes = c.select(F.col("key").cast("string").alias("node_id"), F.lit("IMPORTER").alias("node_type"), "name", F.col("n_name").alias("country"))
    nodes = nodes.withColumns({"risk_score": F.lit(0.0), "risk_level": F.lit("LOW"), "flagged": F.lit(False)})
    return TradeGraph(stored(nodes), e)


def by_country(g: TradeGraph) -> DataFrame:
    """A fixed partition: importers and exporters by their country."""
    return g.nodes.where("node_type IN ('IMPORTER', 'EXPORTER')").select("node_id", F.col("country").alias("community_id"))


def top_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph(spark, sf_dir).edges_where(edge_type="IMPORTS_FROM")
    return e.select("src", "dst", "transaction_count", F.round("total_value", 2).alias("total_value"), F.round("weight", 6).alias("weight")).orderBy(F.desc("total_value"), "src", "dst").limit(10)


def _r(c: str, places: int = 6):
    return F.round(F.col(c).cast("double"), places).alias(c)


def _spans(spark: SparkSession) -> DataFrame:
    return W.windows(spark, "2001-01-01", "2001-12-31", 30, 7)


def _all_spans(g: TradeGraph) -> DataFrame:
    """Windows from the first to the last date of the edges; the last one may end after it."""
    day = F.try_to_date(F.substring("last_seen", 1, 10))
    lo, hi = g.edges.agg(F.min(day), F.max(day)).first()
    if lo is None:
        return _spans(g.edges.sparkSession).where("false")
    days, overlap = 30, 7
    # the last start lies less than a window before the last date
    end = max(hi + timedelta(days - overlap - 1), lo + timedelta(days - 1))
    return W.windows(g.edges.sparkSession, str(lo), str(end), days, overlap)


def _weights(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = B.weighted(graph(spark, sf_dir).edges.drop("weight"), AS_OF, EdgeWeights(method=method))
        return e.select("src", "dst", "edge_type", _r("weight"))

    return run


def _risky(g: TradeGraph) -> TradeGraph:
    """Importers whose tax id is a multiple of 7 are flagged with risk .9."""
    on = (F.col("node_type") == "IMPORTER") & (F.col("tax_id").cast("bigint") % 7 == 0)
    return TradeGraph(g.nodes.withColumns({"flagged": on, "risk_score": F.when(on, 0.9).otherwise(0.0)}).withColumn("risk_level", N.risk_level(F.col("risk_score"))), g.edges, g.single)


def queries() -> dict:
    def on(f):
        return lambda spark, sf_dir: f(graph(spark, sf_dir))

    def snap(f, whole=False):
        def run(spark, sf_dir):
            g = graph(spark, sf_dir)
            s = _all_spans(g) if whole else _spans(spark)
            e = stored(W.snapshot_edges(g.edges, s))
            return f(s, e)

        return run

    def snapshots(s, e):
        return W.snapshots(e, s, with_components=False).select("window_id", "window_start", "window_end", "node_count", "edge_count", _r("density", 9))

    def velocity(s, e):
        return W.velocity(stored(W.snapshots(e, s, with_components=False)), e).select(*[_r(c, 9) for c in ("node_growth", "edge_growth", "density_trend", "turnover")])

    joined = lambda c: F.array_join(c, "|").alias(c)
    return {
        "top_links": top_links,
        "b03_addresses": lambda s, d: stored(D.flat(s, d).select(F.explode(F.array("imp_address", "exp_address")).alias("raw")).distinct()).select("raw", N.address(F.col("raw")).alias("normalized"), N.address_id(F.col("raw")).alias("node_id")),
        "b04_phones": lambda s, d: D.flat(s, d).where("phone is not null").select(F.col("phone").alias("raw")).distinct().select("raw", N.phone(F.col("raw")).alias("normalized")),
        "b07_nodes": on(lambda g: g.nodes.select("node_id", "node_type", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("country", F.lit("")).alias("country"), F.coalesce("description", F.lit("")).alias("description"))),
        "b08_edges": on(lambda g: g.edges.select("src", "dst", "edge_type", "transaction_count", _r("total_value", 2), "first_seen", "last_seen")),
        "b09_w_frequency": _weights("frequency"),
        "b10_w_volume": _weights("volume"),
        "b11_w_composite": _weights("composite"),
        "b14_node_types": on(lambda g: g.type_counts()[0]),
        "b14_edge_types": on(lambda g: g.type_counts()[1]),
        "b14_totals": on(lambda g: g.totals().select("nodes", "edges", _r("density", 12), "components", "connected")),
        "t03_node": on(lambda g: g.node("IMP:1").select("node_id", "node_type", "name", "country")),
        "t04_neighbors_out": on(lambda g: g.neighbors("IMP:1", direction="out").select("node_id", "node_type")),
        "t04_neighbors_in": on(lambda g: g.neighbors("EXP:1", direction="in").select("node_id", "node_type")),
        "t04_neighbors_both": on(lambda g: g.neighbors("EXP:1", direction="both").select("node_id", "node_type")),
        "t05_edges": on(lambda g: g.edges_where(src="IMP:1", edge_type="IMPORTS_FROM").select("src", "dst", "transaction_count")),
        "t07_by_type": on(lambda g: g.nodes_by_type("ROUTE").select("node_id", "origin", "destination")),
        "t01_upsert_nodes": on(lambda g: _upserted_nodes(g).select("node_id", "node_type", F.coalesce("name", F.lit("")).alias("name"), "note")),
        "t02_upsert_edges": on(lambda g: _upserted_edges(g).select("src", "dst", "edge_type", _r("weight"), "transaction_count", "first_seen")),
        "t08_subgraph": on(lambda g: g.subgraph(g.nodes.where("node_type IN ('IMPORTER', 'AGENT')")).edges.select("src", "dst", "edge_type")),
        "g01_khop": on(lambda g: G.khop(g, "IMP:1", 2)),
        "g02_path": on(lambda g: G.shortest_path(g, "IMP:1", "COMM:" + _commodity(g)).select(F.array_join("path", "|").alias("path"), F.col("length").cast("bigint").alias("length"))),
        "g03_components": on(lambda g: G.components(g)),
        "c01_pagerank_3it": on(lambda g: C.pagerank(g, max_iter=3, tol=0).select("node_id", _r("score", 9))),
        "c01_pagerank": on(lambda g: C.pagerank(g).select("node_id", _r("score", 9))),
        "c02_betweenness": on(lambda g: C.betweenness(g, normalized=False, weighted=False).select("node_id", _r("score"))),
        "c03_degree": on(lambda g: C.degree(g).select("node_id", _r("score", 9))),
        "c04_in_degree": on(lambda g: C.degree(g, "in_degree").select("node_id", _r("score", 9))),
        "c05_out_degree": on(lambda g: C.degree(g, "out_degree").select("node_id", _r("score", 9))),
        "c06_hits_3it": on(lambda g: C.hits(g, max_iter=3, tol=0).select("node_id", _r("hub", 9), _r("authority", 9))),
        "c06_hits": on(lambda g: C.hits(g).select("node_id", _r("hub", 9), _r("authority", 9))),
        "c07_facilitators": on(_facilitators),
        "c08_divergence": on(lambda g: C.divergence(g).select("node_id", _r("divergence"))),
        "c09_statistics": on(lambda g: C.statistics(C.degree(g, normalized=False)).select(*[_r(c) for c in ("mean", "std", "max", "min", "median")])),
        "c10_simple": on(lambda g: g.simple_digraph().select("src", "dst", _r("weight"))),
        "m01_louvain": on(lambda g: M.louvain(g)),
        "m02_leiden": on(lambda g: M.leiden(g)),
        "m03_label_propagation_3it": on(lambda g: M.label_propagation(g, 3)),
        "m03_label_propagation": on(lambda g: M.label_propagation(g)),
        "m05_modularity": on(lambda g: M.modularity(g, by_country(g)).select(_r("modularity"))),
        "m06_metrics": on(lambda g: M.metrics(g, by_country(g)).select("community_id", "size", "internal_edges", "external_edges", _r("density"))),
        "m08_anomalies": on(lambda g: M.anomalies(g, by_country(g)).select("community_id", "size", joined("anomaly_indicators"), "shared_addresses")),
        "m09_shared": on(lambda g: M.shared_addresses(g, by_country(g))),
        "p01_propagate": on(lambda g: P.propagate(g, g.node("IMP:1").select("node_id", F.lit(0.9).alias("risk"))).select("node_id", _r("risk"), "depth", joined("path"))),
        "p02_propagate_many": on(lambda g: _spread(g).groupBy("node_id").agg(F.max("risk").alias("risk")).select("node_id", _r("risk"))),
        "p03_applied": on(lambda g: P.applied(g, _spread(g), _sources(g)).nodes.where("risk_score > 0").select("node_id", _r("risk_score"), "risk_level", "flagged")),
        "p08_totals": on(lambda g: P.totals(_spread(g)).select("source_node", "affected", "max_depth", _r("total_risk"))),
        "p06_summary": on(lambda g: P.summary(_risky(g)).select("total_nodes", *[_r(c) for c in ("mean", "median", "max", "std")], "flagged", "at_risk", "low", "medium", "high", "critical")),
        "p06_riskiest": on(lambda g: P.riskiest(_risky(g)).select("node_id", "node_type", _r("risk_score"), "risk_level")),
        "m06_node_types": on(lambda g: M.node_types(g, by_country(g))),
        # the SQL of w01, w02 and w05 has the windows of 2001; those named _all span all dates
        "w01_snapshots": snap(snapshots),
        "w01_snapshots_all": snap(snapshots, whole=True),
        "w01_node_types": on(lambda g: W.snapshot_node_types(g, W.snapshot_edges(g.edges, _spans(g.edges.sparkSession)))),
        "w02_windows": lambda s, d: _spans(s),
        "w02_windows_all": on(_all_spans),
        "w03_changes": snap(lambda s, e: W.changes(e, stored(W.snapshots(e, s))).select("window_id", "change_type", _r("severity"), _r("previous"), _r("current"), "count"), whole=True),
        "w04_evolution": on(lambda g: W.evolution(by_country(g), by_country(g).select("node_id", F.substring("community_id", -1, 1).alias("community_id"))).select("community_id", "event_type", "previous_size", "current_size", _r("jaccard_similarity"))),
        "w03_changed_entities": snap(lambda s, e: W.changed_entities(e, stored(W.changes(e, stored(W.snapshots(e, s, with_components=False)))))),
        "w04_members": on(lambda g: W.evolution_members(by_country(g), by_country(g).select("node_id", F.substring("community_id", -1, 1).alias("community_id")))),
        "w05_velocity": snap(velocity),
        "w05_velocity_all": snap(velocity, whole=True),
        "r01_cycles": lambda s, d: R.circular(companies(s, d)).select(F.array_join("cycle", ">").alias("cycle"), F.col("length").cast("bigint").alias("length"), _r("total_value", 2)),
        "r02_clusters": on(lambda g: R.clusters(g)),
        "r02_entities": on(lambda g: R.cluster_entities(g)),
        "r06_groups": on(lambda g: R.cluster_groups(g).select("component", "clusters", "types", "largest", _r("confidence"))),
        "r09_synchronized": on(lambda g: R.synchronized(g, max_cv=0.3).select("date", "declarations", "importers", _r("cv"), _r("confidence"))),
        "r10_rings": lambda s, d: R.detect(graph(s, d), max_cv=0.3).select("ring_type", "ring_key", "size", _r("confidence")),
        "r07_report": on(lambda g: V.report(g, max_cv=0.3).select("ring_id", "ring_type", "ring_key", _r("confidence"), "size", _r("total_value", 2))),
        "r08_members": on(lambda g: V.members(g, max_cv=0.3)),
        "x01_co_occurrence": lambda s, d: X.co_occurrence(_parties(s, d)).select("src", "dst", "edge_type", "transaction_count", _r("total_value", 2), "first_seen", "last_seen"),
        "k04_carousels": lambda s, d: H.carousels(companies(s, d), Carousel(max_days=10_000, vat_countries=tuple(f"NATION_{i}" for i in range(10)))).select(F.array_join("cycle", ">").alias("cycle"), "border_crossings", _r("total_value", 2), _r("confidence")),
        "k05_missing_traders": lambda s, d: _missing(companies(s, d)).select(F.array_join("cycle", ">").alias("cycle"), "node_id", _r("missing_trader_score"), joined("indicators"), _r("import_value", 2), _r("export_value", 2)),
        "h02_volumes": on(lambda g: H.volumes(g).select("node_id", _r("volume", 2))),
        "h03_flagged": on(lambda g: H.flagged_connections(_risky(g))),
        "h04_commodities": on(lambda g: H.commodities(g)),
        "h06_shells": on(lambda g: H.score(_risky(g), H.combined_centrality(g), AS_OF, min_confidence=0.3).select("node_id", _r("confidence"), joined("indicators"))),
        "h06_shells_by_degree": on(lambda g: H.score(_risky(g), C.degree(g), AS_OF, min_confidence=0.3).select("node_id", _r("confidence"), _r("centrality_volume_ratio", 4), "connection_count", "flagged_connection_count", joined("indicators"))),
        "h07_score_one": on(lambda g: H.score(_risky(g), C.degree(g), AS_OF, min_confidence=0.0, node_id="IMP:7").select("node_id", _r("confidence"), _r("centrality_volume_ratio", 4), "connection_count", "flagged_connection_count", joined("indicators"))),
        "e02_community_signals": on(lambda g: E.community_signals(M.anomalies(g, by_country(g))).select("signal_type", "severity", _r("confidence"), joined("entity_ids"))),
        "e03_ring_signals": on(lambda g: E.ring_signals(R.detect(g, max_cv=0.3)).select("signal_type", "severity", _r("confidence"), joined("entity_ids"))),
        "e05_propagation_signals": on(lambda g: E.propagation_signals(_spread(g), 0.2).select("signal_type", "severity", _r("confidence"), joined("entity_ids"))),
        "e01_entity_signals": on(lambda g: E.entity_signals(_risky(g), 0.5).select("signal_type", "severity", _r("confidence"), joined("entity_ids"))),
        "q05_high_risk": on(lambda g: E.high_risk(_risky(g), 0.5, limit=None).select("node_id", _r("risk_score"), "risk_level", "flagged", joined("indicators"), "neighbor_count")),
    }


def _upserted_nodes(g: TradeGraph) -> DataFrame:
    """Agents are renamed, all given rows get a note, and one node is new."""
    rows = g.nodes.where("node_type = 'AGENT'").select("node_id", F.lit("renamed").alias("name"), F.lit("seen").alias("note"))
    return g.upsert_nodes(rows.unionByName(g.nodes.sparkSession.createDataFrame([("IMP:new", "new", "seen")], rows.schema))).nodes


def _upserted_edges(g: TradeGraph) -> DataFrame:
    """Edges to agents get a weight, their other attributes stay; one edge is new."""
    rows = g.edges.where("edge_type = 'REPRESENTED_BY'").select("src", "dst", "edge_type", F.lit(2.0).alias("weight"))
    return g.upsert_edges(rows.unionByName(g.nodes.sparkSession.createDataFrame([("IMP:1", "COMM:new", "TRADES_COMMODITY", 3.0)], rows.schema))).edges


def _sources(g: TradeGraph) -> DataFrame:
    return g.nodes.where(F.col("node_id").isin("IMP:1", "IMP:2", "IMP:3")).select("node_id", F.lit(0.9).alias("risk"))


def _spread(g: TradeGraph) -> DataFrame:
    return P.propagate(g, _sources(g))


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = lambda tag, c, name: F.concat(F.lit(f"{tag}:"), c).alias(name)
    return D.flat(spark, sf_dir).select(tagged("IMP", "imp", "imp"), tagged("EXP", "exp", "exp"), tagged("AGENT", "license_id", "agt"), "value", "date")


def _missing(g: TradeGraph) -> DataFrame:
    g = TradeGraph(g.nodes.withColumn("registration_date", F.lit(None).cast("string")), g.edges)
    cfg = Carousel(max_days=10_000, vat_countries=tuple(f"NATION_{i}" for i in range(10)))
    return H.missing_traders(g, H.carousels(g, cfg), AS_OF, cfg, in_order=True)


def _facilitators(g: TradeGraph) -> DataFrame:
    """With exact betweenness and settled ranks, for all node types."""
    return C.facilitators(g, C.betweenness(g), C.pagerank(g)).select("node_id", _r("bridging_score"), "in_degree", "out_degree", F.array_join("risk_indicators", "|").alias("risk_indicators"))


def _commodity(g: TradeGraph) -> str:
    """The hs code of the smallest commodity that importer 1 declares."""
    d = g.edges_where(src="IMP:1", edge_type="DECLARES").select(F.col("dst").alias("src"))
    return g.edges_where(edge_type="TRADES_COMMODITY").join(d, "src").agg(F.min("dst")).first()[0].removeprefix("COMM:")


def oracle_sql() -> dict[str, str]:
    return oracles()
