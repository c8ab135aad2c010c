import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_graph import ring
from tradeweave.config import EntityResolution, Settings
from tradeweave.operators import build, centrality, community, evidence, propagation, resolution, shell, signals, temporal
from tradeweave.operators.graph import TradeGraph
from tradeweave.sources import declarations
from tradeweave.streaming import ingest


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names_equal_brute_force(spark):
    rng = random.Random(5)
    names = {"", "a", "ab"}
    for _ in range(40):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 30)))
        names.add(base)
        for _ in range(3):
            x = list(base)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
            names.add("".join(x))
    rows = [(f"N{i:04d}", "one", n) for i, n in enumerate(sorted(names))]
    df = spark.createDataFrame(rows, "id string, block string, name string")
    for threshold in (0.85, 0.7):
        found = {tuple(sorted((r["a"], r["b"]))) for r in resolution.near_names(df, threshold).collect()}
        near = lambda a, b: a and b and edits(a, b) <= int((1 - threshold) * max(len(a), len(b)) + 1e-9)
        assert found == {(p[0], q[0]) for i, p in enumerate(rows) for q in rows[i + 1 :] if near(p[2], q[2])}


def test_resolution_joins_like_names_of_one_country(spark):
    rows = [
        {"declaration_id": f"D{i}", "importer": {"tax_id": f"T{i}", "name": n, "country": c}, "exporter": {"tax_id": "E"}, "commodity": {"hs_code": "1"}, "route": {"origin": "CN", "destination": "US"}, "value": 10.0, "date": "2025-01-01"}
        for i, (n, c) in enumerate([("Northern Trading Co.", "US"), ("Northern Tradng Co", "US"), ("Northern Trading Co.", "GB"), ("Other Imports", "US"), (None, "US")])
    ]
    g = build.build(declarations.from_records(spark, rows), "2025-02-01")
    r = resolution.resolve(g)
    assert {x["node_id"]: x["canonical_id"] for x in r.collect()} == {"IMP:T0": "IMP:T0", "IMP:T1": "IMP:T0", "IMP:T2": "IMP:T2", "IMP:T3": "IMP:T3"}
    u = resolution.unified(g, r)
    link = u.edges.where("src = 'IMP:T0' and edge_type = 'IMPORTS_FROM'").first()
    assert (link["transaction_count"], link["total_value"]) == (2, 20.0)
    assert u.node_count() == g.node_count() - 1 and u.node("IMP:T0").first()["tax_id"] == "T0"


def test_co_occurrence_counts_pairs(spark):
    rows = [("IMP:1", "EXP:1", "AGENT:1", 5.0, "2025-01-02"), ("IMP:1", "EXP:1", None, 7.0, "2025-01-01")]
    df = spark.createDataFrame(rows, "imp string, exp string, agt string, value double, date string")
    found = {(r["src"], r["dst"]): (r["transaction_count"], r["total_value"], r["first_seen"]) for r in resolution.co_occurrence(df).collect()}
    assert found == {("EXP:1", "IMP:1"): (2, 12.0, "2025-01-01"), ("AGENT:1", "IMP:1"): (1, 5.0, "2025-01-02"), ("AGENT:1", "EXP:1"): (1, 5.0, "2025-01-02")}
    assert resolution.co_occurrence(df.limit(0)).count() == 0


def test_ring_members_evidence_and_report(spark):
    g = ring(spark)
    m = {r["node_id"] for r in evidence.members(g).where("ring_type = 'circular'").collect()}
    assert m == {"IMP:A", "EXP:B", "IMP:C", "EXP:A"}
    assert evidence.members(g).where("ring_type = 'shared_attribute'").isEmpty()  # one shared address makes no ring
    amounts = [r["amount"] for r in evidence.evidence(g).where("ring_type = 'circular'").collect()]
    assert sorted(amounts) == [180000.0, 185000.0, 190000.0, 200000.0]
    r = evidence.report(g).where("ring_type = 'circular'").first()
    assert (r["ring_id"], r["size"], r["total_value"], round(r["confidence"], 6)) == ("RING-CIRC-0001", 4, 755000.0, 0.9)
    assert evidence.report(TradeGraph(g.nodes, g.edges.limit(0))).count() == 0


def test_stream_gives_the_graph_of_the_batch(spark, tmp_path):
    d = declarations.sample(spark)
    rows = [json.loads(x) for x in d.toJSON().collect()]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name, part in (("a", rows[:12]), ("b", rows[12:] + [{"declaration_id": "bad"}])):
        (folder / f"{name}.json").write_text("\n".join(map(json.dumps, part)))
        ingest.ingest(ingest.declarations(spark, str(folder)), out, "2025-02-01").awaitTermination()
    g, whole = ingest.ingested(spark, out, "2025-02-01"), build.build(d, "2025-02-01")
    columns = ["src", "dst", "edge_type", "transaction_count", "total_value", "weight"]
    assert g.edges.select(columns).exceptAll(whole.edges.select(columns)).isEmpty() and g.edge_count() == whole.edge_count() == 98
    assert g.nodes.select("node_id", "country").exceptAll(whole.nodes.select("node_id", "country")).isEmpty() and g.node_count() == 40
    assert spark.read.parquet(f"{out}/rejects").count() == 1


def test_link_windows(spark):
    w = ingest.link_windows(declarations.sample(spark), "7 days", "7 days")
    assert w.agg(F.sum("declarations")).first()[0] == 20


def test_upserts_keep_what_they_are_not_given(spark):
    g = ring(spark)
    e = "src string, dst string, edge_type string, weight double"
    rows = [("IMP:A", "EXP:B", "IMPORTS_FROM", 2.0), ("IMP:A", "EXP:B", "IMPORTS_FROM", 3.0), ("IMP:A", "NEW", "IMPORTS_FROM", 1.0), ("NEW", "NEW2", "DECLARES", None)]
    u = g.upsert_edges(spark.createDataFrame(rows, e))
    assert u.edges.columns == g.edges.columns
    got = {(r["src"], r["dst"], r["edge_type"]): r for r in u.edges.collect()}
    assert len(got) == u.edge_count() == g.edge_count() + 2
    assert (got["IMP:A", "EXP:B", "IMPORTS_FROM"]["weight"], got["IMP:A", "EXP:B", "IMPORTS_FROM"]["transaction_count"]) == (3.0, 5)
    assert {r["node_id"] for r in u.nodes.collect()} == {r["node_id"] for r in g.nodes.collect()} | {"NEW", "NEW2"}
    n = g.upsert_nodes(spark.createDataFrame([("IMP:A", None, "x"), ("IMP:A", "FR", None), ("NEW", "IT", "y")], "node_id string, country string, note string"))
    got = {r["node_id"]: r for r in n.nodes.collect()}
    assert n.node_count() == g.node_count() + 1
    assert (got["IMP:A"]["country"], got["IMP:A"]["note"], got["IMP:A"]["node_type"]) == ("FR", "x", "IMPORTER")
    assert (got["EXP:B"]["country"], got["EXP:B"]["note"], got["NEW"]["note"]) == ("CN", None, "y")
    assert g.upsert_nodes(spark.createDataFrame([("A",), ("A",)], "node_id string")).node_count() == g.node_count() + 1


def test_records_and_statistics(spark, tmp_path):
    g = ring(spark)
    back = TradeGraph.from_records(*g.records())
    assert back.nodes.select("node_id", "country").exceptAll(g.nodes.select("node_id", "country")).isEmpty() and back.node_count() == 6
    assert back.edges.select(g.edges.columns).exceptAll(g.edges).isEmpty() and back.edge_count() == 7
    s = g.statistics()
    assert (s["nodes"], s["edges"], s["components"], s["node_types"]["IMPORTER"], s["edge_types"]["LOCATED_AT"]) == (6, 7, 1, 3, 2)
    g.save_statistics(str(tmp_path / "stats"))
    assert json.loads(spark.read.text(str(tmp_path / "stats")).first()[0]) == s


def test_high_risk_counts_parallel_edges(spark):
    g = ring(spark)
    risky = TradeGraph(g.nodes.withColumn("risk_score", F.when(F.col("node_id") == "IMP:A", 0.9).otherwise(0.0)), g.edges.unionByName(g.edges.where("src = 'IMP:A'").withColumn("edge_type", F.lit("CO_OCCURS_WITH"))))
    r = signals.high_risk(risky).collect()
    assert [(x["node_id"], x["neighbor_count"], x["flagged"], x["indicators"]) for x in r] == [("IMP:A", 5, False, ["critical_risk"])]


def test_shell_features_and_neighbours(spark):
    """Fixture F3: a company of a free zone with eight small links, four of them to flagged companies."""
    nodes = [("IMP:SHELL", "IMPORTER", "HK", False, 0.0)] + [(f"EXP:LEGIT{i}", "EXPORTER", ("CN", "VN", "IN", "TH")[i % 4], i < 4, 0.7 if i < 4 else 0.1) for i in range(8)]
    nodes += [("IMP:NORMAL", "IMPORTER", "US", False, 0.1), ("COMM:8471", "COMMODITY", None, False, 0.0), ("DECL:SHELL1", "DECLARATION", None, False, 0.0)]
    edges = [("IMP:SHELL", f"EXP:LEGIT{i}", "IMPORTS_FROM", 1000.0) for i in range(8)] + [("IMP:NORMAL", "EXP:LEGIT0", "IMPORTS_FROM", 500000.0), ("IMP:SHELL", "DECL:SHELL1", "DECLARES", None), ("DECL:SHELL1", "COMM:8471", "TRADES_COMMODITY", None)]
    n = spark.createDataFrame(nodes, "node_id string, node_type string, country string, flagged boolean, risk_score double").withColumns({"name": F.col("node_id"), "registration_date": F.lit("2025-06-01")})
    g = TradeGraph(n, spark.createDataFrame(edges, "src string, dst string, edge_type string, total_value double"))
    found = shell.score(g, centrality.degree(g), "2025-07-15")
    r = found.first()
    assert found.count() == 1 and r["node_id"] == "IMP:SHELL"
    assert r["indicators"] == ["high_centrality_low_volume", "free_trade_zone_registration", "many_flagged_connections", "single_commodity_many_connections"]
    assert abs(r["confidence"] - 0.85) < 1e-9
    assert (r["trade_volume"], r["connection_count"], r["flagged_connection_count"], r["registration_age_days"], r["is_free_trade_zone"]) == (8000.0, 9, 4, 44, True)
    assert shell.score(g, centrality.degree(g), "2025-07-15", min_confidence=0.0, node_id="EXP:LEGIT0").count() == 1
    assert shell.connected_entities(g, found).count() == 9
    assert [x["other"] for x in shell.connected_entities(g, found, 2).orderBy("other").collect()] == ["DECL:SHELL1", "EXP:LEGIT0"]


def test_propagation_totals_and_riskiest(spark):
    g = ring(spark)
    s = spark.createDataFrame([("IMP:A", 0.9)], "node_id string, risk double")
    found = propagation.propagate(g, s)
    t = propagation.totals(found).first()
    assert (t["source_node"], t["affected"], t["max_depth"]) == ("IMP:A", found.count(), found.agg(F.max("depth")).first()[0])
    top = propagation.riskiest(propagation.applied(g, found, s), 2).collect()
    assert top[0]["node_id"] == "IMP:A" and top[0]["risk_level"] == "CRITICAL" and len(top) == 2


def parts(spark, text):
    return spark.createDataFrame([(n, p) for p, ns in text.items() for n in ns], "node_id string, community_id string")


def test_evolution_members(spark):
    old, new = parts(spark, {"a": "pqrs", "b": "xy", "d": "z"}), parts(spark, {"A": "pqrst", "C": "uv", "B": "xyz"})
    events = {r["community_id"]: r["event_type"] for r in temporal.evolution(old, new).collect()}
    assert events == {"A": "evolve", "C": "new", "B": "grow", "d": "dissolved"}
    got = {tuple(r) for r in temporal.evolution_members(old, new).collect()}
    assert got == {("A", "added", "t"), ("C", "added", "u"), ("C", "added", "v"), ("B", "added", "z"), ("d", "removed", "z")}


def test_changed_entities_against_sets(spark):
    rng = random.Random(4)
    rows = sorted({(w, rng.choice("abcdefgh"), rng.choice("abcdefgh"), "T") for w in range(5) if w != 3 for _ in range(6)})
    e = spark.createDataFrame(rows, "window_id int, src string, dst string, edge_type string")
    spans = spark.createDataFrame([(w, "", "") for w in range(5)], "window_id int, window_start string, window_end string")
    found = temporal.changes(e, temporal.snapshots(e, spans, with_components=False), threshold=0.5)
    kinds = {(r["window_id"], r["change_type"]) for r in found.collect()}
    at = [{r[1:] for r in rows if r[0] == w} for w in range(5)]
    nodes = [{n for r in x for n in r[:2]} for x in at]
    wanted = set()
    for w in range(1, 5):
        for kind, a, b in (("new", w, w - 1), ("disappeared", w - 1, w)):
            wanted |= {(w, f"{kind}_edges", n) for r in at[a] - at[b] for n in r[:2]} | {(w, f"{kind}_nodes", n) for n in nodes[a] - nodes[b]}
    assert {tuple(r) for r in temporal.changed_entities(e, found).collect()} == {x for x in wanted if x[:2] in kinds}


def test_nested_settings(tmp_path):
    path = tmp_path / "settings.yaml"
    path.write_text(
        "graph:\n  backend: memory\n  entity_resolution: {similarity_threshold: 0.9, match_fields: [name]}\n  edge_weights: {method: volume, components: {frequency: 0}}\n"
        "analysis:\n  centrality: {pagerank: {alpha: 0.5}, betweenness: {normalized: false, k: null}, degree: {normalized: true}}\n"
        "  temporal: {window_size: 10, window_overlap: 0}\n  propagation: {edge_type_weights: {LOCATED_AT: 0.2}}\n"
        "detection:\n  carousel: {vat_countries: [GB]}\napi: {port: 1}\nexport:\n  signals: {retry_attempts: 0}\n"
    )
    s = Settings.from_yaml(str(path))
    assert s.entity_resolution == EntityResolution(0.9, ("name",))
    assert (s.edge_weights.method, s.edge_weights.frequency, s.edge_weights.volume) == ("volume", 0, 0.3)
    assert (s.centrality.alpha, s.centrality.normalized, s.centrality.k, s.centrality.degree_normalized) == (0.5, False, None, True)
    assert (s.temporal.window_days, s.temporal.overlap_days, s.propagation.type_weights) == (10, 0, {"LOCATED_AT": 0.2})
    assert (s.carousel.vat_countries, s.signals.retry_attempts) == (("GB",), 0)
    with pytest.raises(ValueError):
        Settings.from_dict({"analysis": {"temporal": {"windows": 1}}})


def test_leiden_refines_and_is_connected(spark):
    """A ring of ten cliques: each is a community, and none is worse than louvain's."""
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abcdefghij" for i in range(5) for j in range(i)] + [(f"{c}0", f"{d}1") for c, d in zip("abcdefghij", "bcdefghija", strict=True)]
    nodes = spark.createDataFrame([(f"{c}{i}", "IMPORTER") for c in "abcdefghij" for i in range(5)] + [("alone", "IMPORTER")], "node_id string, node_type string")
    g = TradeGraph(nodes, spark.createDataFrame([(*p, "IMPORTS_FROM", 1.0) for p in pairs], "src string, dst string, edge_type string, weight double"))
    q = {}
    for name, run in (("louvain", community.louvain), ("leiden", community.leiden)):
        p = run(g).withColumnRenamed("community", "community_id")
        q[name] = community.modularity(g, p).first()[0]
        got = {r["node_id"]: r["community_id"] for r in p.collect()}
        assert got["alone"] == "alone" and len(got) == 51
        if name == "leiden":
            assert all(len({got[f"{c}{i}"] for i in range(5)}) == 1 for c in "abcdefghij")
    assert q["leiden"] >= q["louvain"] - 0.02 and q["leiden"] > 0.7
