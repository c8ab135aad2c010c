"""Declarations to a typed, weighted property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EdgeWeights
from ..functions import normalize as N
from ..plans.tables import stored
from .graph import TradeGraph

REQUIRED = {"importer": ("tax_id",), "exporter": ("tax_id",), "commodity": ("hs_code",), "route": ("origin", "destination")}


def validated(declarations: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid declarations, and rejects with their reasons; strict: ValueError if there are any."""
    missing = [F.when(F.col("declaration_id").isNull(), "missing required fields: declaration_id")]
    for part, keys in REQUIRED.items():
        missing.append(F.when(F.col(part).isNull(), f"missing required fields: {part}"))
        missing += [F.when(F.col(part).isNotNull() & F.col(f"{part}.{k}").isNull(), f"missing required keys: {part}.{k}") for k in keys]
    marked = declarations.withColumn("reasons", F.array_compact(F.array(*missing)))
    rejects = marked.where(F.size("reasons") > 0)
    if strict and (first := rejects.select("reasons").first()):
        raise ValueError("declaration is " + "; ".join(first["reasons"]))
    return marked.where(F.size("reasons") == 0).drop("reasons"), rejects


def prepared(declarations: DataFrame, as_of: str) -> DataFrame:
    """Declarations with defaults and the ids of all entities they name."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    present = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    tagged = lambda tag, c: F.concat(F.lit(f"{tag}:"), F.col(c))
    return declarations.select(
        "declaration_id", "importer", "exporter", "commodity", "route", "agent", "phone", "bank_account", "ordinal",
        F.coalesce("value", F.lit(0.0)).alias("value"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("date", F.lit(as_of)).alias("date"),
        tagged("DECL", "declaration_id").alias("decl"),
        tagged("IMP", "importer.tax_id").alias("imp"),
        tagged("EXP", "exporter.tax_id").alias("exp"),
        tagged("COMM", "commodity.hs_code").alias("comm"),
        F.concat(F.lit("ROUTE:"), text("route.origin"), F.lit("-"), text("route.destination")).alias("rt"),
        F.when(F.col("agent").isNotNull(), F.concat(F.lit("AGENT:"), text("agent.license_id"))).alias("agt"),
        F.when(present("importer.address"), N.address_id(F.col("importer.address"))).alias("imp_addr"),
        F.when(present("exporter.address"), N.address_id(F.col("exporter.address"))).alias("exp_addr"),
        F.when(present("phone"), F.concat(F.lit("PHONE:"), N.phone(F.col("phone")))).alias("ph"),
        F.when(F.col("bank_account").isNotNull(), F.concat(F.lit("BANK:"), N.account_hash(F.col("bank_account.account_number")))).alias("bank"),
    )


def _kinds() -> list[tuple[str, str, dict[str, Column]]]:
    c = F.col
    return [
        ("DECLARATION", "decl", {"declaration_id": c("declaration_id"), "date": c("date"), "value": c("value"), "weight": c("weight")}),
        ("IMPORTER", "imp", {"tax_id": c("importer.tax_id"), "name": c("importer.name"), "country": c("importer.country"), "address": c("importer.address"), "registration_date": c("importer.registration_date")}),
        ("EXPORTER", "exp", {"tax_id": c("exporter.tax_id"), "name": c("exporter.name"), "country": c("exporter.country"), "address": c("exporter.address")}),
        ("COMMODITY", "comm", {"hs_code": c("commodity.hs_code"), "description": c("commodity.description")}),
        ("ROUTE", "rt", {"origin": c("route.origin"), "destination": c("route.destination"), "transit_points": c("route.transit")}),
        ("AGENT", "agt", {"license_id": c("agent.license_id"), "name": c("agent.name"), "agent_type": F.coalesce(c("agent.type"), F.lit("broker"))}),
        ("PHONE", "ph", {"normalized_number": N.phone(c("phone"))}),
        ("BANK_ACCOUNT", "bank", {"bank_name": c("bank_account.bank_name"), "account_hash": N.account_hash(c("bank_account.account_number"))}),
    ]


def merged(rows: DataFrame, by: str, attributes: list[str]) -> DataFrame:
    """One row for each key; an attribute's first truthy value by ordinal wins, else the falsy default."""
    kinds = dict(rows.dtypes)
    firsts = [F.min_by(a, F.when(N.truthy(F.col(a), kinds[a]), F.col("ordinal"))).alias(a) for a in attributes]
    out = rows.groupBy(by).agg(*firsts)
    default = lambda k: F.expr("cast(array() as array<string>)") if k.startswith("array") else F.lit(0.0) if k == "double" else F.lit("")
    return out.select(by, *[F.coalesce(a, default(kinds[a])).alias(a) for a in attributes])


def node_rows(p: DataFrame) -> DataFrame:
    """All nodes of prepared declarations, merged."""
    parts = []
    for kind, key, attributes in _kinds():
        rows = p.where(F.col(key).isNotNull()).select(F.col(key).alias("node_id"), "ordinal", *[v.alias(k) for k, v in attributes.items()])
        parts.append(merged(rows, "node_id", list(attributes)).withColumn("node_type", F.lit(kind)))
    both = [p.where(F.col(k).isNotNull()).select(F.col(k).alias("node_id"), F.concat("ordinal", F.lit(o)).alias("ordinal"), N.address(F.col(f"{of}.address")).alias("normalized_address"), F.col(f"{of}.country").alias("country")) for k, of, o in (("imp_addr", "importer", "0"), ("exp_addr", "exporter", "1"))]
    parts.append(merged(both[0].unionByName(both[1]), "node_id", ["normalized_address", "country"]).withColumn("node_type", F.lit("ADDRESS")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.withColumns({"risk_score": F.lit(0.0), "risk_level": F.lit("LOW"), "flagged": F.lit(False), "community_id": F.lit(None).cast("bigint")})


def edge_rows(p: DataFrame) -> DataFrame:
    """Edges of prepared declarations by (src, dst, edge_type): count, value, first and last date."""
    e = lambda s, d, t, valued=True: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(t).alias("edge_type"), (F.col("value") if valued else F.lit(0.0)).alias("value"))
    all_ = F.array(
        e("imp", "exp", "IMPORTS_FROM"), e("imp", "decl", "DECLARES"), e("decl", "comm", "TRADES_COMMODITY"), e("decl", "rt", "USES_ROUTE"),
        e("imp", "agt", "REPRESENTED_BY"), e("imp", "imp_addr", "LOCATED_AT", False), e("exp", "exp_addr", "LOCATED_AT", False),
        e("imp", "ph", "CONTACTABLE_VIA", False), e("imp", "bank", "PAYS_THROUGH"),
    )
    rows = p.select("date", F.explode(all_).alias("e")).select("date", "e.*").where("dst is not null")
    return rows.groupBy("src", "dst", "edge_type").agg(
        F.count("*").alias("transaction_count"), N.money(F.col("value")).alias("total_value"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )


def weight(method: str, cfg: EdgeWeights, as_of: str) -> Column:
    """frequency, volume, or (any other name) composite."""
    n, v = F.col("transaction_count").cast("double"), F.col("total_value")
    if method == "frequency":
        return n
    if method == "volume":
        return F.log1p(v)
    return (
        cfg.frequency * F.least(n / 10, F.lit(1.0)) + cfg.volume * F.least(F.log1p(v) / 15, F.lit(1.0))
        + cfg.recency * N.recency(F.col("last_seen"), as_of)
    )


def weighted(edges: DataFrame, as_of: str, cfg: EdgeWeights = EdgeWeights()) -> DataFrame:
    return edges.withColumn("weight", weight(cfg.method, cfg, as_of))


def build(declarations: DataFrame, as_of: str, cfg: EdgeWeights = EdgeWeights(), strict: bool = False) -> TradeGraph:
    """The graph of the valid declarations; edges carry weights as of a date."""
    valid, _ = validated(declarations, strict)
    p = stored(prepared(valid, as_of))  # read once for each kind of node and once for all edges
    return TradeGraph(node_rows(p), weighted(edge_rows(p), as_of, cfg))
