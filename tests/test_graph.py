from datetime import date

import pytest
from pyspark.sql import functions as F

from tradeweave.config import Carousel, Propagation, Settings
from tradeweave.operators import build, centrality, community, propagation, rings, shell, traversal
from tradeweave.operators.graph import TradeGraph, create_store
from tradeweave.plans.facade import Questions
from tradeweave.schema import EDGES, NODES
from tradeweave.sources import declarations

E = "src string, dst string, edge_type string, weight double, total_value double, transaction_count bigint, last_seen string"


def ring(spark) -> TradeGraph:
    rows = [("IMP:A", "IMPORTER", "US"), ("EXP:B", "EXPORTER", "CN"), ("IMP:C", "IMPORTER", "GB"), ("EXP:A", "EXPORTER", "US"), ("IMP:D", "IMPORTER", "DE"), ("ADDR:shared123", "ADDRESS", "US")]
    nodes = spark.createDataFrame(rows, "node_id string, node_type string, country string").withColumns(
        {"risk_score": F.lit(0.0), "risk_level": F.lit("LOW"), "flagged": F.lit(False)}
    )
    nodes = spark.createDataFrame([], NODES).unionByName(nodes, allowMissingColumns=True)
    edges = [
        ("IMP:A", "EXP:B", "IMPORTS_FROM", 1.0, 200000.0, 5, "2025-01-15"), ("EXP:B", "IMP:C", "IMPORTS_FROM", 1.0, 190000.0, 4, "2025-01-20"),
        ("IMP:C", "EXP:A", "IMPORTS_FROM", 1.0, 185000.0, 4, "2025-01-25"), ("EXP:A", "IMP:A", "IMPORTS_FROM", 1.0, 180000.0, 3, "2025-01-28"),
        ("IMP:D", "EXP:B", "IMPORTS_FROM", 0.5, 50000.0, 2, "2025-01-10"),
        ("IMP:A", "ADDR:shared123", "LOCATED_AT", 1.0, None, None, None), ("EXP:A", "ADDR:shared123", "LOCATED_AT", 1.0, None, None, None),
    ]
    return TradeGraph(nodes, spark.createDataFrame(edges, E))


def test_builder_counts_and_merges(spark):
    g = build.build(declarations.sample(spark), "2025-02-01")
    assert (g.node_count(), g.edge_count()) == (40, 98)
    assert g.node("IMP:IMP000").first()["country"] == "US"


def test_missing_fields_are_rejected(spark):
    bad = declarations.from_records(spark, [{"declaration_id": "X"}])
    with pytest.raises(ValueError, match="missing required fields"):
        build.build(bad, "2025-01-01", strict=True)
    assert build.validated(bad)[0].count() == 0


def test_circular_ring_and_confidence(spark):
    c = rings.circular(ring(spark)).withColumn("confidence", rings.circular_confidence()).collect()
    assert len(c) == 1
    assert (c[0]["length"], c[0]["total_value"], c[0]["shared"]) == (4, 755000.0, True)
    assert c[0]["confidence"] == pytest.approx(0.9)


def test_carousel(spark):
    c = shell.carousels(ring(spark)).collect()
    assert len(c) == 1
    assert (c[0]["border_crossings"], c[0]["temporal_span_days"]) == (3, 13)
    assert c[0]["estimated_vat_exposure"] == pytest.approx(453000)
    assert c[0]["confidence"] == pytest.approx(0.95)
    assert c[0]["pattern_id"].startswith("CAROUSEL-")
    assert len(c[0]["countries"]) == len(set(c[0]["countries"])) and set(c[0]["missing_trader_candidates"]) <= set(c[0]["cycle"])
    days = c[0]["transaction_dates"]
    assert days == sorted(set(days)) and (date.fromisoformat(days[-1]) - date.fromisoformat(days[0])).days == 13


def test_acyclic_graph_has_no_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert traversal.simple_cycles(e, 6).count() == 0


def test_propagation_threshold_and_types(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABC"], "node_id string").withColumn("risk_score", F.lit(0.0))
    chain = TradeGraph(nodes, spark.createDataFrame([("A", "B", "IMPORTS_FROM", 1.0), ("B", "C", "IMPORTS_FROM", 1.0)], "src string, dst string, edge_type string, weight double"))
    s = spark.createDataFrame([("A", 0.8)], "node_id string, risk double")
    assert propagation.propagate(chain, s, Propagation(decay=0.1, threshold=0.5)).count() == 0
    fork = TradeGraph(nodes, spark.createDataFrame([("A", "B", "IMPORTS_FROM", 1.0), ("A", "C", "LOCATED_AT", 1.0)], "src string, dst string, edge_type string, weight double"))
    got = {r["node_id"]: r["risk"] for r in propagation.propagate(fork, s.withColumn("risk", F.lit(1.0)), Propagation(decay=0.8, type_weights={"IMPORTS_FROM": 1.0, "LOCATED_AT": 0.3})).collect()}
    assert got == pytest.approx({"B": 0.8, "C": 0.24})
    with pytest.raises(ValueError):
        propagation.propagate(chain, spark.createDataFrame([("Z", 0.8)], "node_id string, risk double"))


def test_paths_and_components(spark):
    g = ring(spark)
    p = traversal.shortest_path(g, "IMP:A", "EXP:A").first()
    assert p["length"] == 3
    assert traversal.components(g).select("component").distinct().count() == 1
    assert {r["node_id"] for r in g.neighbors("ADDR:shared123").collect()} == {"IMP:A", "EXP:A"}


def test_store_and_settings(spark, tmp_path):
    g = ring(spark)
    g.save(str(tmp_path))
    assert TradeGraph.load(spark, str(tmp_path)).edge_count() == 7
    with pytest.raises(ValueError):
        create_store(spark, "other")
    assert Settings.from_dict({"temporal": {"overlap_days": 0}}).temporal.overlap_days == 0
    assert Carousel().min_value == 50_000
    assert spark.createDataFrame([], EDGES).count() == 0


def plain(spark, pairs) -> TradeGraph:
    nodes = spark.createDataFrame([(x,) for x in sorted({n for p in pairs for n in p[:2]})], "node_id string")
    return TradeGraph(nodes, spark.createDataFrame([(a, b, "IMPORTS_FROM", w) for a, b, w in pairs], "src string, dst string, edge_type string, weight double"))


def test_betweenness(spark):
    g = plain(spark, [("a", "b", 1.0), ("b", "d", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0), ("a", "e", 9.0)])
    score = lambda **k: {r["node_id"]: r["score"] for r in centrality.betweenness(g, **k).collect()}
    # a to e is direct by hops, and through b or c and d by weight
    assert score(normalized=False, weighted=False) == pytest.approx({"a": 0, "b": 0.5, "c": 0.5, "d": 2, "e": 0})
    assert score() == pytest.approx({"a": 0, "b": 1 / 12, "c": 1 / 12, "d": 3 / 12, "e": 0})
    with pytest.raises(ValueError, match="positive"):
        centrality.betweenness(plain(spark, [("a", "b", 0.0)]))


def test_louvain_and_leiden(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "xy" for i in range(5) for j in range(i)]
    g = plain(spark, [*cliques, ("x0", "y0", 1.0)])
    for name in ("louvain", "leiden"):
        p = community.detect(g, name)
        got = {r["node_id"]: r["community_id"] for r in p.collect()}
        assert got == {f"{c}{i}": f"{c}0" for c in "xy" for i in range(5)}
        assert community.modularity(g, p).first()[0] == pytest.approx(2 * (10 / 21 - 0.25))
    with pytest.raises(ValueError, match="Unknown algorithm"):
        community.detect(g, "other")


def test_missing_traders(spark):
    g = ring(spark)
    got = {r["node_id"]: r for r in shell.missing_traders(g, shell.carousels(g), "2025-02-01").collect()}
    assert set(got) == {"IMP:A", "EXP:B", "IMP:C", "EXP:A"}
    assert (got["EXP:B"]["import_value"], got["EXP:B"]["export_value"]) == (250000, 190000)
    assert got["IMP:C"]["indicators"] == ["minimal_external_connections"]
    assert got["IMP:C"]["missing_trader_score"] == pytest.approx(0.15)


def test_questions(spark):
    q = Questions(ring(spark))
    assert q.health() == {"status": "healthy", "nodes": 6, "edges": 7}
    assert q.shortest_path("IMP:A", "EXP:A").first()["length"] == 3
    assert q.propagate_risk("unknown").count() == 0
    assert q.neighbors("IMP:D", max_depth=2).count() == 3
    assert q.fraud_rings().first()["ring_type"] == "circular"
    assert q.communities("label_propagation", min_size=1).count() >= 1
