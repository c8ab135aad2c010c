"""What the registered queries take in, on small tables and graphs."""

import pytest
from pyspark.sql import functions as F

from tradeweave.operators import community, rings
from tradeweave.operators.graph import TradeGraph
from tradeweave.plans import catalogue


def graph(spark, pairs) -> TradeGraph:
    nodes = spark.createDataFrame([(x,) for x in sorted({n for p in pairs for n in p[:2]})], "node_id string").withColumn("node_type", F.lit("IMPORTER"))
    rows = [(a, b, "IMPORTS_FROM", float(w), 1.0, 1, d) for a, b, w, d in pairs]
    return TradeGraph(nodes, spark.createDataFrame(rows, "src string, dst string, edge_type string, weight double, total_value double, transaction_count bigint, last_seen string"))


@pytest.fixture
def on(spark, monkeypatch):
    """Runs a registered query on a graph of pairs."""

    def run(name, pairs):
        g = graph(spark, pairs)
        monkeypatch.setattr(catalogue, "graph", lambda s, d: g)
        return catalogue.queries()[name](spark, "").collect()

    return run


def test_companies_have_all_links(spark, monkeypatch):
    trades = [(1, k, 100.0 * k) for k in (2, 3, 4, 5)] + [(2, 6, 1.0), (6, 1, 1.0), (9, 1, 1.0)]
    f = spark.createDataFrame([(str(a), str(b), v, "2001-01-01") for a, b, v in trades], "imp string, exp string, value double, date string")
    spark.createDataFrame([(k, f"s{k}", 0) for k in range(1, 7)], "s_suppkey int, s_name string, s_nationkey int").createOrReplaceTempView("supplier")
    spark.createDataFrame([(k, f"c{k}", 0) for k in range(1, 10)], "c_custkey int, c_name string, c_nationkey int").createOrReplaceTempView("customer")
    spark.createDataFrame([(0, "NATION_0")], "n_nationkey int, n_name string").createOrReplaceTempView("nation")
    monkeypatch.setattr(catalogue.D, "flat", lambda s, d: f)
    g = catalogue.companies(spark, "")
    assert {(int(r["src"]), int(r["dst"])) for r in g.edges.collect()} == {(a, b) for a, b, _ in trades}
    assert sorted(int(r["node_id"]) for r in g.nodes.collect()) == list(range(1, 10))
    # 1 trades least with 2: among its three greatest partners it isn't
    assert [r["cycle"] for r in rings.circular(g).collect()] == [["1", "2", "6"]]


@pytest.mark.parametrize("name", ["m01_louvain", "m02_leiden"])
def test_communities_of_the_whole_graph(on, name):
    cliques = [(f"{c}{i}", f"{c}{j}", 1, None) for c in "xy" for i in range(5) for j in range(i)]
    got = {r["node_id"]: r["community"] for r in on(name, [*cliques, ("x0", "y0", 1, None)])}
    assert got == {f"{c}{i}": f"{c}0" for c in "xy" for i in range(5)}


def test_windows_span_all_dates(on):
    dates = ["1995-01-02", "1997-06-30", "2001-11-04", None]
    pairs = [(f"a{i}", f"b{i}", 1, d) for i, d in enumerate(dates)]
    spans = on("w02_windows_all", pairs)
    assert all(any(r["window_start"] <= d <= r["window_end"] for r in spans) for d in dates if d)
    assert spans[0]["window_start"] == "1995-01-02"
    counts = {r["window_id"]: r["edge_count"] for r in on("w01_snapshots_all", pairs)}
    assert len(counts) == len(spans)
    assert sum(n or 0 for n in counts.values()) == sum(r["window_start"] <= d <= r["window_end"] for r in spans for d in dates if d)
    assert len(on("w05_velocity_all", pairs)) == 1
    assert {r["window_id"] for r in on("w03_changes", pairs)} > {1}
    assert [on("w02_windows_all", [("a", "b", 1, d)])[0]["window_start"] for d in ("1980-05-05",)] == ["1980-05-05"]
    assert on("w02_windows_all", [("a", "b", 1, None)]) == []


PATH = [(f"n{i:02}", f"n{i + 1:02}", 1 + i % 3, None) for i in range(12)] + [("n03", "n00", 2, None), ("n12", "n05", 1, None), ("n07", "n02", 1, None), ("n01", "n05", 1, None)]


def dense(pairs):
    import numpy as np

    names = sorted({n for p in pairs for n in p[:2]})
    m = np.zeros((len(names),) * 2)
    for a, b, w, _ in pairs:
        m[names.index(a), names.index(b)] += w
    return names, m


def test_pagerank_settles(on):
    import numpy as np

    names, m = dense(PATH)
    step, x = m / m.sum(1, keepdims=True), np.full(len(names), 1 / len(names))
    for _ in range(1000):
        x = 0.85 * x @ step + 0.15 / len(names)
    got = {r["node_id"]: r["score"] for r in on("c01_pagerank", PATH)}
    assert [got[n] for n in names] == pytest.approx(x, abs=len(names) * 1e-5)


def test_hits_settle(on):
    import numpy as np

    pairs = [("a", "x", 5, None), ("a", "y", 1, None), ("b", "x", 2, None), ("b", "z", 1, None), ("c", "y", 1, None), ("x", "c", 1, None)]
    names, m = dense(pairs)
    h = np.ones(len(names))
    for _ in range(5000):
        a = h @ m
        h = m @ (a / a.sum())
        h /= h.sum()
    got = {r["node_id"]: (r["hub"], r["authority"]) for r in on("c06_hits", pairs)}
    assert [got[n][0] for n in names] == pytest.approx(h, abs=1e-6)
    assert [got[n][1] for n in names] == pytest.approx(a / a.sum(), abs=1e-6)


def test_labels_settle_beyond_three_rounds(on):
    pairs = [(f"n{i:02}", f"n{i + 1:02}", 1, None) for i in range(8)]
    near = {n: [b if a == n else a for a, b, *_ in pairs if n in (a, b)] for n in {x for p in pairs for x in p[:2]}}
    labels, rounds = {n: n for n in near}, 0
    while True:
        votes = {n: [labels[x] for x in [*near[n], n]] for n in near}
        new = {n: min(v, key=lambda x: (-v.count(x), x)) for n, v in votes.items()}
        rounds += 1
        if new == labels:
            break
        labels = new
    assert 4 < rounds <= 10
    assert {r["node_id"]: r["community"] for r in on("m03_label_propagation", pairs)} == labels


def test_shells_see_betweenness(on, monkeypatch, spark):
    # m is on every path from left to right, yet has no more links than the ends of the fan
    pairs = [("a", "m", 1, None), ("b", "m", 1, None), ("m", "c", 1, None), ("c", "d", 1, None), ("c", "e", 1, None)]
    seen = {}
    monkeypatch.setattr(catalogue, "_risky", lambda g: g)
    monkeypatch.setattr(catalogue.H, "score", lambda g, c, *a, **k: seen.update({r[0]: r[1] for r in c.collect()}) or g.nodes.select("node_id", F.lit(0.0).alias("confidence"), F.array().alias("indicators")))
    on("h06_shells", pairs)
    # paths through m: from a and b to c, d, e; through c: from a, b, m to d, e
    want = {"a": (1, 0), "b": (1, 0), "m": (3, 6), "c": (3, 6), "d": (1, 0), "e": (1, 0)}
    assert seen == pytest.approx({n: 0.4 * d / 5 + 0.6 * b / 20 for n, (d, b) in want.items()})


def test_facilitators_rank_bridges_first(on):
    pairs = [("a", "m", 1, None), ("b", "m", 1, None), ("m", "c", 1, None), ("c", "d", 1, None), ("c", "e", 1, None)]
    got = on("c07_facilitators", pairs)
    assert {r["node_id"] for r in got[:2]} == {"m", "c"}
    assert [r["node_id"] for r in got if "high_betweenness" in r["risk_indicators"]] == [r["node_id"] for r in got[:2]]
