"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from ..config import Propagation
from ..functions.normalize import ABBREVIATIONS
from ..sources.declarations import FLAT_SQL

AS_OF = "2001-12-31"


def _address(c: str) -> str:
    c = f"trim(lower({c}))"
    for short, long in ABBREVIATIONS:
        c = f"replace({c}, '{short}', '{long}')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_GRAPH = f"""flat AS ({FLAT_SQL}),
ids AS (
  SELECT *, 'DECL:' || declaration_id AS n_decl, 'IMP:' || imp AS n_imp, 'EXP:' || exp AS n_exp, 'COMM:' || hs_code AS n_comm,
    'ROUTE:' || origin || '-' || destination AS n_route, 'AGENT:' || license_id AS n_agent, {_address("imp_address")} AS a_imp, {_address("exp_address")} AS a_exp,
    'PHONE:' || regexp_replace(phone, '[^0-9+]', '', 'g') AS n_phone, 'BANK:' || substr(sha256(account), 1, 16) AS n_bank
  FROM flat
),
pairs AS (
  SELECT n_imp AS src, n_exp AS dst, 'IMPORTS_FROM' AS edge_type, value, date FROM ids
  UNION ALL SELECT n_imp, n_decl, 'DECLARES', value, date FROM ids
  UNION ALL SELECT n_decl, n_comm, 'TRADES_COMMODITY', value, date FROM ids
  UNION ALL SELECT n_decl, n_route, 'USES_ROUTE', value, date FROM ids
  UNION ALL SELECT n_imp, n_agent, 'REPRESENTED_BY', value, date FROM ids WHERE n_agent IS NOT NULL
  UNION ALL SELECT n_imp, 'ADDR:' || substr(md5(a_imp), 1, 12), 'LOCATED_AT', 0, date FROM ids
  UNION ALL SELECT n_exp, 'ADDR:' || substr(md5(a_exp), 1, 12), 'LOCATED_AT', 0, date FROM ids
  UNION ALL SELECT n_imp, n_phone, 'CONTACTABLE_VIA', 0, date FROM ids WHERE n_phone IS NOT NULL
  UNION ALL SELECT n_imp, n_bank, 'PAYS_THROUGH', value, date FROM ids WHERE n_bank IS NOT NULL
),
bare AS (
  SELECT src, dst, edge_type, count(*) AS transaction_count, CAST(sum(CAST(value AS DECIMAL(28, 4))) AS DOUBLE) AS total_value,
    min(date) AS first_seen, max(date) AS last_seen FROM pairs GROUP BY ALL
),
edges AS (
  SELECT *, 0.4 * least(transaction_count / 10.0, 1) + 0.3 * least(ln(1 + total_value) / 15, 1) + 0.3 *
    CASE WHEN date_diff('day', CAST(last_seen AS DATE), DATE '{AS_OF}') < 0 THEN 1 WHEN date_diff('day', CAST(last_seen AS DATE), DATE '{AS_OF}') > 365 THEN 0
      ELSE 1 - date_diff('day', CAST(last_seen AS DATE), DATE '{AS_OF}') / 365.0 END AS weight
  FROM bare
),
addresses AS (SELECT a_imp AS a, imp_country AS c, ordinal || '0' AS o FROM ids UNION ALL SELECT a_exp, exp_country, ordinal || '1' FROM ids),
nodes AS (
  SELECT n_decl AS node_id, 'DECLARATION' AS node_type, '' AS name, '' AS country, '' AS description, arg_min(value, ordinal) AS value, arg_min(date, ordinal) AS date, NULL AS attribute FROM ids GROUP BY n_decl
  UNION ALL SELECT n_imp, 'IMPORTER', arg_min(imp_name, ordinal), arg_min(imp_country, ordinal), '', NULL, NULL, NULL FROM ids GROUP BY n_imp
  UNION ALL SELECT n_exp, 'EXPORTER', arg_min(exp_name, ordinal), arg_min(exp_country, ordinal), '', NULL, NULL, NULL FROM ids GROUP BY n_exp
  UNION ALL SELECT n_comm, 'COMMODITY', '', '', arg_min(description, ordinal), NULL, NULL, NULL FROM ids GROUP BY n_comm
  UNION ALL SELECT n_route, 'ROUTE', '', '', '', NULL, NULL, NULL FROM ids GROUP BY n_route
  UNION ALL SELECT n_agent, 'AGENT', min(license_id), '', '', NULL, NULL, NULL FROM ids WHERE n_agent IS NOT NULL GROUP BY n_agent
  UNION ALL SELECT 'ADDR:' || substr(md5(a), 1, 12), 'ADDRESS', '', arg_min(c, o), '', NULL, NULL, a FROM addresses GROUP BY a
  UNION ALL SELECT n_phone, 'PHONE', '', '', '', NULL, NULL, substr(n_phone, 7) FROM ids WHERE n_phone IS NOT NULL GROUP BY n_phone
  UNION ALL SELECT n_bank, 'BANK_ACCOUNT', '', '', '', NULL, NULL, substr(n_bank, 6) FROM ids WHERE n_bank IS NOT NULL GROUP BY n_bank
),
ends AS (SELECT src AS node_id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges),
degrees AS (SELECT n.node_id, coalesce(sum(i), 0) AS i, coalesce(sum(o), 0) AS o, coalesce(sum(i + o), 0) AS d FROM nodes n LEFT JOIN ends USING (node_id) GROUP BY n.node_id),
near AS (SELECT src AS node_id, dst AS other FROM edges UNION SELECT dst, src FROM edges),
part AS (SELECT node_id, country AS c FROM nodes WHERE node_type IN ('IMPORTER', 'EXPORTER')),
risk AS (SELECT *, node_type = 'IMPORTER' AND CAST(CASE WHEN node_type = 'IMPORTER' THEN substr(node_id, 5) ELSE '1' END AS BIGINT) % 7 = 0 AS flagged FROM nodes),
simple AS (SELECT src, dst, sum(weight) AS weight FROM edges GROUP BY ALL)"""

_WINDOWS = """spans AS (
  SELECT CAST(i AS INTEGER) AS window_id, CAST(DATE '2001-01-01' + CAST(i * 23 AS INTEGER) AS VARCHAR) AS window_start, CAST(DATE '2001-01-01' + CAST(i * 23 + 29 AS INTEGER) AS VARCHAR) AS window_end
  FROM range(0, 100) t(i) WHERE DATE '2001-01-01' + CAST(i * 23 + 29 AS INTEGER) <= DATE '2001-12-31'
)"""
_SNAPS = f"""{_WINDOWS},
se AS (SELECT window_id, src, dst, edge_type FROM edges JOIN spans ON last_seen BETWEEN window_start AND window_end),
sn AS (SELECT window_id, src AS node_id FROM se UNION SELECT window_id, dst FROM se),
snap AS (
  SELECT s.window_id, window_start, window_end, coalesce(n, 0) AS node_count, coalesce(e, 0) AS edge_count,
    CASE WHEN coalesce(n, 0) > 1 THEN coalesce(e, 0) / (n * (n - 1.0)) ELSE 0 END AS density
  FROM spans s LEFT JOIN (SELECT window_id, count(*) AS n FROM sn GROUP BY ALL) USING (window_id) LEFT JOIN (SELECT window_id, count(*) AS e FROM se GROUP BY ALL) USING (window_id)
)"""


def _pagerank(rounds: int) -> str:
    cte = ["tot AS (SELECT src, sum(weight) AS t FROM simple GROUP BY src)", "sh AS (SELECT s.src, dst, weight / t AS w FROM simple s JOIN tot USING (src))",
           "cnt AS (SELECT count(*) AS n FROM nodes)", "x0 AS MATERIALIZED (SELECT node_id, 1.0 / n AS s FROM nodes, cnt)"]
    for r in range(rounds):
        cte.append(
            f"x{r + 1} AS MATERIALIZED (SELECT x.node_id, 0.85 * (coalesce(f, 0) + (SELECT coalesce(sum(s), 0) FROM x{r} WHERE node_id NOT IN (SELECT src FROM tot)) / n) + 0.15 / n AS s "
            f"FROM x{r} x CROSS JOIN cnt LEFT JOIN (SELECT dst AS node_id, sum(s * w) AS f FROM x{r} JOIN sh ON x{r}.node_id = sh.src GROUP BY dst) USING (node_id))"
        )
    return ", ".join(cte) + f" SELECT node_id, round(s, 9) AS score FROM x{rounds}"


def _min_labels(of: str, pairs: str, rounds: int) -> str:
    """Smallest label reachable in so many hops; more than the longest distance of these tables."""
    cte = [f"lp AS MATERIALIZED ({pairs})", f"l0 AS MATERIALIZED ({of})"]
    for r in range(rounds):
        cte.append(f"l{r + 1} AS MATERIALIZED (SELECT l.node_id, least(l.c, coalesce(m, l.c)) AS c FROM l{r} l LEFT JOIN (SELECT lp.node_id, min(x.c) AS m FROM lp JOIN l{r} x ON x.node_id = lp.other GROUP BY lp.node_id) USING (node_id))")
    return ", ".join([*cte, f"label AS (SELECT node_id, c AS component FROM l{rounds})"])


_COMPONENTS = _min_labels("SELECT node_id, node_id AS c FROM nodes", "SELECT node_id, other FROM near", 12)

_RINGS = (
    "ent AS (SELECT node_id FROM nodes WHERE node_type IN ('IMPORTER', 'EXPORTER', 'AGENT')), "
    "cl AS (SELECT dst, count(DISTINCT src) AS n FROM edges WHERE src IN (SELECT node_id FROM ent) AND dst IN (SELECT node_id FROM nodes WHERE node_type IN ('ADDRESS', 'PHONE', 'BANK_ACCOUNT')) GROUP BY dst HAVING count(DISTINCT src) >= 2), "
    "lk AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT node_id FROM ent) AND dst IN (SELECT dst FROM cl)), "
    + _min_labels("SELECT DISTINCT unnest([src, dst]) AS node_id, node_id AS c FROM lk", "SELECT src AS node_id, dst AS other FROM lk UNION ALL SELECT dst, src FROM lk", 30)
    + ", gr AS (SELECT component, count(*) AS clusters, count(DISTINCT node_type) AS types, max(n) AS largest FROM cl JOIN label ON label.node_id = cl.dst JOIN nodes ON nodes.node_id = cl.dst GROUP BY component HAVING count(*) >= 2), "
    "grp AS (SELECT component, clusters, types, largest, least(least(0.2 * clusters, 0.6) + CASE WHEN types >= 2 THEN 0.2 ELSE 0 END + CASE WHEN largest >= 5 THEN 0.2 WHEN largest >= 3 THEN 0.1 ELSE 0 END, 1) AS confidence FROM gr), "
    "mem AS (SELECT component, count(*) AS entities FROM label WHERE node_id IN (SELECT src FROM lk) GROUP BY component), "
    "sd AS (SELECT date, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM nodes WHERE node_type = 'DECLARATION' GROUP BY date), si AS (SELECT n.date, count(DISTINCT src) AS i FROM nodes n JOIN edges e ON e.dst = n.node_id AND edge_type = 'DECLARES' WHERE node_type = 'DECLARATION' GROUP BY n.date), "
    "rings AS (SELECT 'shared_attribute' AS ring_type, component AS ring_key, entities AS size, confidence FROM grp JOIN mem USING (component) WHERE confidence >= 0.5 "
    "UNION ALL SELECT 'behavioral', date, n + i, 0.6 + 0.1 * least(n - 3, 4) FROM sd JOIN si USING (date) WHERE n >= 3 AND i >= 3 AND std / mean < 0.3)"
)


def _labels(rounds: int) -> str:
    cte = ["a AS MATERIALIZED (SELECT node_id, other FROM near WHERE node_id <> other)", "v0 AS MATERIALIZED (SELECT node_id, node_id AS label FROM nodes)"]
    for r in range(rounds):
        cte.append(f"v{r + 1} AS MATERIALIZED (SELECT node_id, label FROM (SELECT a.node_id, label FROM a JOIN v{r} ON v{r}.node_id = a.other UNION ALL SELECT node_id, label FROM v{r}) GROUP BY node_id, label QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, label) = 1)")
    return ", ".join(cte) + f" SELECT node_id, label AS community FROM v{rounds}"


def _hits(rounds: int) -> str:
    cte = ["sm AS MATERIALIZED (SELECT * FROM simple)", "h0 AS MATERIALIZED (SELECT node_id, 1.0 / (SELECT count(*) FROM nodes) AS h FROM nodes)"]
    for r in range(rounds):
        cte.append(f"p{r} AS MATERIALIZED (SELECT dst AS node_id, sum(h * weight) AS a FROM sm JOIN h{r} ON h{r}.node_id = src GROUP BY dst)")
        cte.append(f"a{r} AS MATERIALIZED (SELECT node_id, a / (SELECT sum(a) FROM p{r}) AS a FROM p{r})")
        cte.append(f"q{r} AS MATERIALIZED (SELECT src AS node_id, sum(a * weight) AS h FROM sm JOIN a{r} ON a{r}.node_id = dst GROUP BY src)")
        cte.append(f"h{r + 1} AS MATERIALIZED (SELECT node_id, h / (SELECT sum(h) FROM q{r}) AS h FROM q{r})")
    return ", ".join(cte) + f" SELECT node_id, round(CAST(coalesce(h, 0) AS DOUBLE), 9) AS hub, round(CAST(coalesce(a, 0) AS DOUBLE), 9) AS authority FROM nodes LEFT JOIN h{rounds} USING (node_id) LEFT JOIN a{rounds - 1} USING (node_id)"


def _propagated(sources: str) -> str:
    """spread: source_node, node_id, risk, depth, path."""
    cfg = Propagation()
    weight = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cfg.type_weights.items()) + f" ELSE {cfg.other_weight} END"
    cte = [
        f"fac AS (SELECT src, dst, edge_type, {cfg.decay} * {weight} * least(coalesce(weight, 1), 1) AS f FROM edges)",
        "step AS MATERIALIZED (SELECT src AS parent, dst AS child, edge_type, f FROM fac UNION ALL SELECT dst, src, edge_type, f FROM fac)",
        f"s0 AS MATERIALIZED (SELECT node_id AS source_node, node_id, CAST(0.9 AS DOUBLE) AS risk, 0 AS depth, node_id AS path FROM nodes WHERE node_id IN ({sources}))",
    ]
    for d in range(1, cfg.max_depth + 1):
        cte.append(
            f"n{d} AS (SELECT source_node, child AS node_id, risk * f AS risk, {d} AS depth, path || '|' || child AS path FROM s{d - 1} s JOIN step ON step.parent = s.node_id "
            f"WHERE depth = {d - 1} AND risk * f >= {cfg.threshold} AND NOT EXISTS (SELECT 1 FROM s{d - 1} k WHERE k.source_node = s.source_node AND k.node_id = child) "
            "QUALIFY row_number() OVER (PARTITION BY source_node, child ORDER BY risk * f DESC, parent, edge_type) = 1)"
        )
        cte.append(f"s{d} AS MATERIALIZED (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM n{d})")
    return ", ".join([*cte, f"spread AS (SELECT * FROM s{cfg.max_depth} WHERE depth > 0)"])


_MANY = _propagated("'IMP:1', 'IMP:2', 'IMP:3'")
_LEVEL = "CASE WHEN {r} >= 0.8 THEN 'CRITICAL' WHEN {r} >= 0.6 THEN 'HIGH' WHEN {r} >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"
_ANOMALIES = (
    "z AS (SELECT c, count(*) AS size, count(*) FILTER (WHERE node_type = 'IMPORTER') AS imp FROM part JOIN nodes USING (node_id) GROUP BY c), "
    "s AS (SELECT c, dst, count(*) AS n FROM edges JOIN part ON node_id = src WHERE dst IN (SELECT node_id FROM nodes WHERE node_type = 'ADDRESS') GROUP BY ALL HAVING count(*) > 1), "
    "odd AS (SELECT z.c, size, count(*) AS shared FROM z JOIN s ON s.c = z.c WHERE size >= 3 AND imp >= 2 GROUP BY ALL)"
)


def _shells(where: str) -> str:
    return (
        "vol AS (SELECT node_id, CAST(sum(CAST(total_value AS DECIMAL(28, 4))) AS DOUBLE) AS v FROM (SELECT src AS node_id, total_value FROM edges UNION ALL SELECT dst, total_value FROM edges) GROUP BY node_id), "
        "fe AS (SELECT DISTINCT src, dst FROM edges), fl AS (SELECT n.node_id, count(*) AS k FROM (SELECT src AS node_id, dst AS other FROM fe UNION ALL SELECT dst, src FROM fe) n JOIN risk r ON r.node_id = n.other WHERE r.flagged GROUP BY n.node_id), "
        "com AS (SELECT n_imp AS node_id, count(DISTINCT n_comm) AS k FROM ids GROUP BY n_imp), "
        "x AS (SELECT node_id, node_type, country, i, o, d, coalesce(v, 0) AS v, coalesce(fl.k, 0) AS fk, coalesce(com.k, 0) AS ck FROM degrees JOIN nodes USING (node_id) LEFT JOIN vol USING (node_id) LEFT JOIN fl USING (node_id) LEFT JOIN com USING (node_id)), "
        "mx AS (SELECT CAST(max(d) AS DOUBLE) AS md, max(v) AS mv FROM x), "
        "y AS (SELECT x.*, CASE WHEN v > 0 THEN (d / md) / (v / mv) WHEN d / md > 0.1 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS ratio FROM x, mx WHERE node_type IN ('IMPORTER', 'EXPORTER')), "
        "w AS (SELECT *, least(1, CASE WHEN ratio > 5 THEN least(ratio / 10, 0.3) ELSE 0 END + CASE WHEN country IN ('AE-FZ', 'SG-FTZ', 'PA-CFZ', 'HK', 'BH-FTZ') THEN 0.2 ELSE 0 END + CASE WHEN fk >= 3 THEN least(fk / 10.0, 0.25) ELSE 0 END "
        "+ CASE WHEN d > 5 AND ck <= 1 THEN 0.1 ELSE 0 END + CASE WHEN i > 0 AND o > 0 AND abs(i - o) / CAST(greatest(i, o) AS DOUBLE) > 0.9 THEN 0.1 ELSE 0 END) AS confidence, "
        "concat_ws('|', CASE WHEN ratio > 5 THEN 'high_centrality_low_volume' END, CASE WHEN country IN ('AE-FZ', 'SG-FTZ', 'PA-CFZ', 'HK', 'BH-FTZ') THEN 'free_trade_zone_registration' END, CASE WHEN fk >= 3 THEN 'many_flagged_connections' END, "
        "CASE WHEN d > 5 AND ck <= 1 THEN 'single_commodity_many_connections' END, CASE WHEN i > 0 AND o > 0 AND abs(i - o) / CAST(greatest(i, o) AS DOUBLE) > 0.9 THEN 'highly_asymmetric_connections' END) AS indicators FROM y) "
        f"SELECT node_id, round(CAST(confidence AS DOUBLE), 6) AS confidence, round(CASE WHEN ratio = CAST('inf' AS DOUBLE) THEN 999.9 ELSE ratio END, 4) AS centrality_volume_ratio, CAST(d AS BIGINT) AS connection_count, fk AS flagged_connection_count, indicators FROM w WHERE {where}"
    )


def oracles() -> dict[str, str]:
    g = lambda sql: f"WITH {_GRAPH}{'' if sql.lstrip().startswith('SELECT') else ', '} {sql}"
    return {
        "top_links": g("SELECT src, dst, transaction_count, round(total_value, 2) AS total_value, round(weight, 6) AS weight FROM edges WHERE edge_type = 'IMPORTS_FROM' ORDER BY total_value DESC, src, dst LIMIT 10"),
        "b03_addresses": g(f"raws AS (SELECT imp_address AS raw FROM flat UNION SELECT exp_address FROM flat) SELECT raw, {_address('raw')} AS normalized, 'ADDR:' || substr(md5({_address('raw')}), 1, 12) AS node_id FROM raws"),
        "b04_phones": g("SELECT DISTINCT phone AS raw, regexp_replace(phone, '[^0-9+]', '', 'g') AS normalized FROM flat WHERE phone IS NOT NULL"),
        "b07_nodes": g("SELECT node_id, node_type, name, country, description FROM nodes"),
        "b08_edges": g("SELECT src, dst, edge_type, transaction_count, round(total_value, 2) AS total_value, first_seen, last_seen FROM edges"),
        "b09_w_frequency": g("SELECT src, dst, edge_type, CAST(transaction_count AS DOUBLE) AS weight FROM edges"),
        "b10_w_volume": g("SELECT src, dst, edge_type, round(ln(1 + total_value), 6) AS weight FROM edges"),
        "b11_w_composite": g("SELECT src, dst, edge_type, round(CAST(weight AS DOUBLE), 6) AS weight FROM edges"),
        "b14_node_types": g("SELECT node_type, count(*) AS count FROM nodes GROUP BY node_type"),
        "b14_edge_types": g("SELECT edge_type, count(*) AS count FROM edges GROUP BY edge_type"),
        "t03_node": g("SELECT node_id, node_type, name, country FROM nodes WHERE node_id = 'IMP:1'"),
        "t04_neighbors_out": g("SELECT node_id, node_type FROM nodes WHERE node_id IN (SELECT dst FROM edges WHERE src = 'IMP:1')"),
        "t04_neighbors_in": g("SELECT node_id, node_type FROM nodes WHERE node_id IN (SELECT src FROM edges WHERE dst = 'EXP:1')"),
        "t04_neighbors_both": g("SELECT node_id, node_type FROM nodes WHERE node_id IN (SELECT other FROM near WHERE node_id = 'EXP:1')"),
        "t05_edges": g("SELECT src, dst, transaction_count FROM edges WHERE src = 'IMP:1' AND edge_type = 'IMPORTS_FROM'"),
        "t07_by_type": g("SELECT DISTINCT n_route AS node_id, origin, destination FROM ids"),
        "t08_subgraph": g("SELECT src, dst, edge_type FROM edges WHERE edge_type = 'REPRESENTED_BY'"),
        "g01_khop": g("h1 AS (SELECT DISTINCT other AS node_id FROM near WHERE node_id = 'IMP:1'), h2 AS (SELECT DISTINCT other AS node_id FROM near JOIN h1 USING (node_id) WHERE other <> 'IMP:1' AND other NOT IN (SELECT node_id FROM h1)) SELECT node_id, CAST(1 AS INTEGER) AS depth FROM h1 UNION ALL SELECT node_id, CAST(2 AS INTEGER) FROM h2"),
        "c01_pagerank_3it": g(_pagerank(3)),
        "c02_betweenness": g("e2 AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), two AS (SELECT p.src AS s, p.dst AS v, q.dst AS t FROM e2 p JOIN e2 q ON q.src = p.dst WHERE q.dst <> p.src AND NOT EXISTS (SELECT 1 FROM e2 x WHERE x.src = p.src AND x.dst = q.dst)), n2 AS (SELECT s, t, count(*) AS k FROM two GROUP BY ALL), b AS (SELECT v, sum(1.0 / k) AS b FROM two JOIN n2 USING (s, t) GROUP BY v) SELECT node_id, round(CAST(coalesce(b, 0) AS DOUBLE), 6) AS score FROM nodes LEFT JOIN b ON v = node_id"),
        "c03_degree": g("SELECT node_id, round(d / ((SELECT count(*) FROM nodes) - 1.0), 9) AS score FROM degrees"),
        "c04_in_degree": g("SELECT node_id, round(i / ((SELECT count(*) FROM nodes) - 1.0), 9) AS score FROM degrees"),
        "c05_out_degree": g("SELECT node_id, round(o / ((SELECT count(*) FROM nodes) - 1.0), 9) AS score FROM degrees"),
        "c08_divergence": g("v AS (SELECT src AS node_id, CAST(sum(CAST(total_value AS DECIMAL(28, 4))) AS DOUBLE) AS v FROM edges GROUP BY src), x AS (SELECT node_id, d, coalesce(v, 0) AS v FROM degrees LEFT JOIN v USING (node_id)), m AS (SELECT max(d) AS md, max(v) AS mv FROM x) SELECT node_id, CASE WHEN v > 0 THEN round((d / CAST(md AS DOUBLE)) / (v / mv), 6) WHEN d > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS divergence FROM x, m"),
        "c09_statistics": g("SELECT round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(CAST(max(d) AS DOUBLE), 6) AS max, round(CAST(min(d) AS DOUBLE), 6) AS min, round(CAST(median(d) AS DOUBLE), 6) AS median FROM degrees"),
        "c10_simple": g("SELECT src, dst, round(CAST(weight AS DOUBLE), 6) AS weight FROM simple"),
        "m05_modularity": g("u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM edges GROUP BY ALL), m AS (SELECT sum(w) AS m FROM u), x AS (SELECT u.w, p.c AS ca, q.c AS cb FROM u JOIN part p ON p.node_id = a JOIN part q ON q.node_id = b), l AS (SELECT ca AS c, sum(w) AS l FROM x WHERE ca = cb GROUP BY ca), d AS (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM x UNION ALL SELECT cb, w FROM x) GROUP BY c) SELECT round(CAST(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)) AS DOUBLE), 6) AS modularity FROM d LEFT JOIN l USING (c), m"),
        "m06_metrics": g("z AS (SELECT c, count(*) AS size FROM part GROUP BY c), e AS (SELECT p.c, count(*) FILTER (WHERE q.c = p.c) AS i, count(*) FILTER (WHERE q.c IS DISTINCT FROM p.c) AS x FROM edges JOIN part p ON p.node_id = src LEFT JOIN part q ON q.node_id = dst GROUP BY p.c) SELECT z.c AS community_id, size, coalesce(i, 0) AS internal_edges, coalesce(x, 0) AS external_edges, round(coalesce(i, 0) / CAST(greatest(size * (size - 1), 1) AS DOUBLE), 6) AS density FROM z LEFT JOIN e ON z.c = e.c"),
        "m09_shared": g("s AS (SELECT c, dst, count(*) AS n FROM edges JOIN part ON node_id = src WHERE edge_type = 'LOCATED_AT' GROUP BY ALL HAVING count(*) > 1) SELECT c AS community_id, count(*) AS shared_addresses FROM s GROUP BY c"),
        "p06_summary": g("SELECT count(*) AS total_nodes, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(max(r), 6) AS max, round(stddev_pop(r), 6) AS std, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE r >= 0.1) AS at_risk, count(*) FILTER (WHERE r < 0.3) AS low, count(*) FILTER (WHERE r >= 0.3 AND r < 0.6) AS medium, count(*) FILTER (WHERE r >= 0.6 AND r < 0.8) AS high, count(*) FILTER (WHERE r >= 0.8) AS critical FROM (SELECT flagged, CASE WHEN flagged THEN CAST(0.9 AS DOUBLE) ELSE 0 END AS r FROM risk)"),
        "w01_snapshots": g(f"{_SNAPS} SELECT window_id, window_start, window_end, node_count, edge_count, round(CAST(density AS DOUBLE), 9) AS density FROM snap"),
        "w02_windows": f"WITH {_WINDOWS} SELECT * FROM spans",
        "w04_evolution": g("q AS (SELECT node_id, right(c, 1) AS c FROM part), ps AS (SELECT c AS p, count(*) AS a FROM part GROUP BY ALL), cs AS (SELECT c, count(*) AS b FROM q GROUP BY ALL), j AS (SELECT q.c, part.c AS p, count(*) AS n FROM q JOIN part USING (node_id) GROUP BY ALL), k AS (SELECT j.c, j.p, a, b, n / CAST(a + b - n AS DOUBLE) AS j FROM j JOIN ps USING (p) JOIN cs USING (c)), best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c ORDER BY j DESC, p) = 1), kept AS (SELECT * FROM best WHERE j > 0.3) SELECT c AS community_id, CASE WHEN j > 0.8 THEN 'stable' WHEN b / CAST(a AS DOUBLE) > 1.3 THEN 'grow' WHEN b / CAST(a AS DOUBLE) < 0.7 THEN 'shrink' ELSE 'evolve' END AS event_type, a AS previous_size, b AS current_size, round(j, 6) AS jaccard_similarity FROM kept UNION ALL SELECT c, 'new', 0, b, 0 FROM cs WHERE c NOT IN (SELECT c FROM kept) UNION ALL SELECT p, 'dissolved', a, 0, 0 FROM ps WHERE p NOT IN (SELECT p FROM kept)"),
        "w04_members": g("q AS (SELECT node_id, right(c, 1) AS c FROM part), ps AS (SELECT c AS p, count(*) AS a FROM part GROUP BY ALL), cs AS (SELECT c, count(*) AS b FROM q GROUP BY ALL), j AS (SELECT q.c, part.c AS p, count(*) AS n FROM q JOIN part USING (node_id) GROUP BY ALL), k AS (SELECT j.c, j.p, a, b, n / CAST(a + b - n AS DOUBLE) AS j FROM j JOIN ps USING (p) JOIN cs USING (c)), best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c ORDER BY j DESC, p) = 1), kept AS (SELECT * FROM best WHERE j > 0.3), pm AS (SELECT node_id, c AS p FROM part) SELECT q.c AS community_id, 'added' AS event, q.node_id FROM q LEFT JOIN kept USING (c) LEFT JOIN pm ON pm.node_id = q.node_id AND pm.p = kept.p WHERE pm.p IS NULL UNION ALL SELECT coalesce(kept.c, pm.p), 'removed', pm.node_id FROM pm LEFT JOIN kept USING (p) LEFT JOIN q ON q.node_id = pm.node_id AND q.c = kept.c WHERE q.c IS NULL"),
        "w03_changed_entities": g(f"""{_SNAPS}, last AS (SELECT max(window_id) AS w FROM spans),
  xe AS (SELECT 'new_edges' AS t, window_id, src, dst, edge_type FROM (FROM se EXCEPT SELECT window_id + 1, src, dst, edge_type FROM se) UNION ALL
    SELECT 'disappeared_edges', * FROM (SELECT window_id + 1 AS window_id, src, dst, edge_type FROM se EXCEPT FROM se)),
  xn AS (SELECT 'new_nodes' AS t, window_id, node_id FROM (FROM sn EXCEPT SELECT window_id + 1, node_id FROM sn) UNION ALL
    SELECT 'disappeared_nodes', * FROM (SELECT window_id + 1 AS window_id, node_id FROM sn EXCEPT FROM sn)),
  n AS (SELECT t, window_id, count(*) AS c FROM xe GROUP BY ALL UNION ALL SELECT t, window_id, count(*) FROM xn GROUP BY ALL),
  ok AS (SELECT t, n.window_id FROM n, last LEFT JOIN snap s ON s.window_id = n.window_id - 1 WHERE n.window_id BETWEEN 1 AND w
    AND least(c / CAST(greatest(coalesce(CASE WHEN t LIKE '%edges' THEN edge_count ELSE node_count END, 0), 1) AS DOUBLE), 1) >= 0.15),
  parts AS (SELECT t, window_id, src AS node_id FROM xe UNION SELECT t, window_id, dst FROM xe UNION SELECT t, window_id, node_id FROM xn)
  SELECT window_id, t AS change_type, node_id FROM parts JOIN ok USING (t, window_id)"""),
        "r02_entities": g("c AS (SELECT dst FROM edges WHERE edge_type IN ('LOCATED_AT', 'CONTACTABLE_VIA', 'PAYS_THROUGH') GROUP BY dst HAVING count(DISTINCT src) >= 2) SELECT DISTINCT dst AS shared_node_id, src AS node_id FROM edges JOIN c USING (dst)"),
        "p06_riskiest": g("SELECT node_id, node_type, CAST(0.9 AS DOUBLE) AS risk_score, 'CRITICAL' AS risk_level FROM risk WHERE flagged ORDER BY node_id LIMIT 10"),
        "m06_node_types": g("SELECT c AS community_id, node_type, count(*) AS count FROM part JOIN nodes USING (node_id) GROUP BY ALL"),
        "w05_velocity": g(f"{_SNAPS}, d AS (SELECT window_id, density, node_count - lag(node_count) OVER (ORDER BY window_id) AS dn, edge_count - lag(edge_count) OVER (ORDER BY window_id) AS de FROM snap), t AS (SELECT window_id, count(*) AS n, count(*) FILTER (WHERE k = 1) AS x FROM (SELECT window_id, node_id, count(*) AS k FROM (SELECT window_id, node_id FROM sn UNION ALL SELECT window_id + 1, node_id FROM sn) GROUP BY ALL) WHERE window_id > 0 AND window_id <= (SELECT max(window_id) FROM spans) GROUP BY window_id) SELECT round(avg(dn), 9) AS node_growth, round(avg(de), 9) AS edge_growth, round(CAST(regr_slope(density, window_id) AS DOUBLE), 9) AS density_trend, (SELECT round(avg(x / CAST(n AS DOUBLE)), 9) FROM t) AS turnover FROM d"),
        "r02_clusters": g("c AS (SELECT dst AS node_id, count(DISTINCT src) AS n FROM edges WHERE edge_type IN ('LOCATED_AT', 'CONTACTABLE_VIA', 'PAYS_THROUGH') GROUP BY dst HAVING count(DISTINCT src) >= 2) SELECT node_id AS shared_node_id, node_type AS shared_node_type, attribute AS attribute_value, n AS entity_count FROM c JOIN nodes USING (node_id)"),
        "r09_synchronized": g("d AS (SELECT date, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM nodes WHERE node_type = 'DECLARATION' GROUP BY date), i AS (SELECT n.date, count(DISTINCT src) AS i FROM nodes n JOIN edges e ON e.dst = n.node_id AND edge_type = 'DECLARES' WHERE node_type = 'DECLARATION' GROUP BY n.date) SELECT date, n AS declarations, i AS importers, round(std / mean, 6) AS cv, round(0.6 + 0.1 * least(n - 3, 4), 6) AS confidence FROM d JOIN i USING (date) WHERE n >= 3 AND i >= 3 AND std / mean < 0.3"),
        "x01_co_occurrence": g("o AS (SELECT n_imp AS a, n_exp AS b, value, date FROM ids UNION ALL SELECT n_imp, n_agent, value, date FROM ids WHERE n_agent IS NOT NULL UNION ALL SELECT n_exp, n_agent, value, date FROM ids WHERE n_agent IS NOT NULL) SELECT least(a, b) AS src, greatest(a, b) AS dst, 'CO_OCCURS_WITH' AS edge_type, count(*) AS transaction_count, round(CAST(sum(CAST(value AS DECIMAL(28, 4))) AS DOUBLE), 2) AS total_value, min(date) AS first_seen, max(date) AS last_seen FROM o GROUP BY least(a, b), greatest(a, b)"),
        "h02_volumes": g("SELECT node_id, round(CAST(sum(CAST(total_value AS DECIMAL(28, 4))) AS DOUBLE), 2) AS volume FROM (SELECT src AS node_id, total_value FROM edges UNION ALL SELECT dst, total_value FROM edges) GROUP BY node_id"),
        "h03_flagged": g("e AS (SELECT DISTINCT src, dst FROM edges), n AS (SELECT src AS node_id, dst AS other FROM e UNION ALL SELECT dst, src FROM e) SELECT n.node_id, count(*) AS flagged_connections FROM n JOIN risk r ON r.node_id = n.other WHERE r.flagged GROUP BY n.node_id"),
        "h04_commodities": g("SELECT n_imp AS node_id, count(DISTINCT n_comm) AS commodities FROM ids GROUP BY n_imp"),
        "e01_entity_signals": g("SELECT 'entity_risk' AS signal_type, 'CRITICAL' AS severity, CAST(0.9 AS DOUBLE) AS confidence, node_id AS entity_ids FROM risk WHERE flagged"),
        "q05_high_risk": g("SELECT node_id, CAST(0.9 AS DOUBLE) AS risk_score, 'CRITICAL' AS risk_level, flagged, 'directly_flagged|critical_risk' || CASE WHEN d > 20 THEN '|high_connectivity' ELSE '' END AS indicators, CAST(d AS BIGINT) AS neighbor_count FROM risk JOIN degrees USING (node_id) WHERE flagged"),
        "t01_upsert_nodes": g("SELECT node_id, node_type, CASE WHEN node_type = 'AGENT' THEN 'renamed' ELSE name END AS name, CASE WHEN node_type = 'AGENT' THEN 'seen' END AS note FROM nodes UNION ALL SELECT 'IMP:new', NULL, 'new', 'seen'"),
        "t02_upsert_edges": g("SELECT src, dst, edge_type, round(CAST(CASE WHEN edge_type = 'REPRESENTED_BY' THEN 2 ELSE weight END AS DOUBLE), 6) AS weight, transaction_count, first_seen FROM edges UNION ALL SELECT 'IMP:1', 'COMM:new', 'TRADES_COMMODITY', 3, NULL, NULL"),
        "g03_components": g(f"{_COMPONENTS} SELECT node_id, component FROM label"),
        "b14_totals": g(f"{_COMPONENTS}, n AS (SELECT count(*) AS n FROM nodes), e AS (SELECT count(*) AS e FROM edges), k AS (SELECT count(DISTINCT component) AS k FROM label) SELECT n AS nodes, e AS edges, round(e / (CAST(n AS DOUBLE) * (n - 1)), 12) AS density, k AS components, k = 1 AS connected FROM n, e, k"),
        "c06_hits_3it": g(_hits(3)),
        "m03_label_propagation_3it": g(_labels(3)),
        "m08_anomalies": g(f"{_ANOMALIES} SELECT c AS community_id, size, 'shared_address' AS anomaly_indicators, shared AS shared_addresses FROM odd"),
        "p01_propagate": g(_propagated("'IMP:1'") + " SELECT node_id, round(risk, 6) AS risk, depth, path FROM spread"),
        "p02_propagate_many": g(f"{_MANY} SELECT node_id, round(max(risk), 6) AS risk FROM spread GROUP BY node_id"),
        "p03_applied": g(f"{_MANY}, m AS (SELECT node_id, max(risk) AS r FROM spread GROUP BY node_id), f AS (SELECT node_id, CASE WHEN node_id IN ('IMP:1', 'IMP:2', 'IMP:3') THEN 0.9 ELSE r END AS r FROM nodes LEFT JOIN m USING (node_id)) SELECT node_id, round(CAST(r AS DOUBLE), 6) AS risk_score, {_LEVEL.format(r='r')} AS risk_level, node_id IN ('IMP:1', 'IMP:2', 'IMP:3') AS flagged FROM f WHERE r > 0"),
        "p08_totals": g(f"{_MANY} SELECT source_node, count(*) AS affected, max(depth) AS max_depth, round(sum(risk), 6) AS total_risk FROM spread GROUP BY source_node"),
        "w01_node_types": g(f"{_SNAPS} SELECT window_id, node_type, count(*) AS count FROM sn JOIN nodes USING (node_id) GROUP BY ALL"),
        "r06_groups": g(f"{_RINGS} SELECT component, clusters, types, largest, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM grp"),
        "r10_rings": g(f"{_RINGS} SELECT ring_type, ring_key, size, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM rings"),
        "e02_community_signals": g(f"{_ANOMALIES} SELECT 'community_alert' AS signal_type, 'LOW' AS severity, CAST(0 AS DOUBLE) AS confidence, c AS entity_ids FROM odd"),
        "e03_ring_signals": g(f"{_RINGS} SELECT 'fraud_ring_alert' AS signal_type, CASE WHEN confidence >= 0.8 THEN 'CRITICAL' WHEN confidence >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(CAST(confidence AS DOUBLE), 6) AS confidence, ring_key AS entity_ids FROM rings"),
        "e05_propagation_signals": g(f"{_MANY} SELECT 'entity_risk' AS signal_type, {_LEVEL.format(r='risk')} AS severity, round(risk, 6) AS confidence, node_id AS entity_ids FROM spread WHERE risk >= 0.2"),
        "h06_shells_by_degree": g(_shells("confidence >= 0.3")),
        "h07_score_one": g(_shells("node_id = 'IMP:7'")),
    }
