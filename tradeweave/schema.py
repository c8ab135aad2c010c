"""Types of nodes and edges, and the schemas of declarations and graphs."""

from __future__ import annotations

# fixed values: node types, edge types, risk levels
NODE_TYPES = ("IMPORTER", "EXPORTER", "COMMODITY", "ROUTE", "AGENT", "ADDRESS", "PHONE", "BANK_ACCOUNT", "DECLARATION")
EDGE_TYPES = (
    "IMPORTS_FROM", "DECLARES", "TRADES_COMMODITY", "USES_ROUTE", "REPRESENTED_BY",
    "LOCATED_AT", "CONTACTABLE_VIA", "PAYS_THROUGH", "CO_OCCURS_WITH",
)
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Node types whose members may share attributes, and the attribute types.
ENTITY_TYPES = ("IMPORTER", "EXPORTER", "AGENT")
ATTRIBUTE_TYPES = ("ADDRESS", "PHONE", "BANK_ACCOUNT")

#: Allowed endpoints of each edge type; None: any.
ENDPOINTS = {
    "IMPORTS_FROM": (("IMPORTER",), ("EXPORTER",)),
    "DECLARES": (("IMPORTER",), ("DECLARATION",)),
    "TRADES_COMMODITY": (("DECLARATION",), ("COMMODITY",)),
    "USES_ROUTE": (("DECLARATION",), ("ROUTE",)),
    "REPRESENTED_BY": (("IMPORTER",), ("AGENT",)),
    "LOCATED_AT": (("IMPORTER", "EXPORTER"), ("ADDRESS",)),
    "CONTACTABLE_VIA": (("IMPORTER", "EXPORTER"), ("PHONE",)),
    "PAYS_THROUGH": (("IMPORTER", "EXPORTER"), ("BANK_ACCOUNT",)),
    "CO_OCCURS_WITH": (None, None),
}

DECLARATIONS = (
    "declaration_id string,"
    " importer struct<tax_id:string,name:string,country:string,address:string,registration_date:string>,"
    " exporter struct<tax_id:string,name:string,country:string,address:string>,"
    " commodity struct<hs_code:string,description:string>,"
    " route struct<origin:string,destination:string,transit:array<string>>,"
    " agent struct<license_id:string,name:string,type:string>,"
    " phone string, bank_account struct<bank_name:string,account_number:string>,"
    " value double, weight double, date string, ordinal string"
)
NODES = (
    "node_id string, node_type string, name string, country string, tax_id string, address string,"
    " registration_date string, hs_code string, description string, origin string, destination string,"
    " transit_points array<string>, license_id string, agent_type string, normalized_address string,"
    " normalized_number string, bank_name string, account_hash string, declaration_id string, date string,"
    " value double, weight double, risk_score double, risk_level string, flagged boolean, community_id bigint"
)
EDGES = (
    "src string, dst string, edge_type string, weight double, transaction_count bigint, total_value double,"
    " first_seen string, last_seen string"
)
