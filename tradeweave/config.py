"""Settings, passed explicitly to every operator. Explicit zeros are honoured."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field
from typing import Any

# fixed values: default weights and country lists
EDGE_TYPE_WEIGHTS = {
    "IMPORTS_FROM": 1.0,
    "PAYS_THROUGH": 0.9,
    "REPRESENTED_BY": 0.8,
    "LOCATED_AT": 0.6,
    "CONTACTABLE_VIA": 0.5,
    "CO_OCCURS_WITH": 0.3,
}
FREE_TRADE_ZONES = ("AE-FZ", "SG-FTZ", "PA-CFZ", "HK", "BH-FTZ")
VAT_COUNTRIES = ("GB", "DE", "FR", "IT", "ES", "NL", "BE", "PL")


@dataclass(frozen=True)
class EdgeWeights:
    method: str = "composite"
    frequency: float = 0.4
    volume: float = 0.3
    recency: float = 0.3


@dataclass(frozen=True)
class EntityResolution:
    similarity: float = 0.85
    fields: tuple[str, ...] = ("name", "tax_id", "address", "phone")


@dataclass(frozen=True)
class Community:
    algorithm: str = "louvain"
    resolution: float = 1.0
    min_size: int = 3
    seed: int = 42


@dataclass(frozen=True)
class Centrality:
    alpha: float = 0.85
    max_iter: int = 100
    tol: float = 1e-6
    normalized: bool = True
    k: int | None = None
    degree_normalized: bool = True


@dataclass(frozen=True)
class Temporal:
    window_days: int = 30
    overlap_days: int = 7
    threshold: float = 0.15


@dataclass(frozen=True)
class Propagation:
    max_depth: int = 4
    decay: float = 0.5
    threshold: float = 0.1
    type_weights: dict[str, float] = field(default_factory=lambda: dict(EDGE_TYPE_WEIGHTS))
    other_weight: float = 0.3


@dataclass(frozen=True)
class Rings:
    max_cycle_length: int = 6
    min_shared: int = 2


@dataclass(frozen=True)
class Shell:
    ratio: float = 5.0
    flagged: int = 3
    zones: tuple[str, ...] = FREE_TRADE_ZONES


@dataclass(frozen=True)
class Carousel:
    min_value: float = 50_000.0
    max_days: int = 90
    vat_countries: tuple[str, ...] = VAT_COUNTRIES


@dataclass(frozen=True)
class Signals:
    batch_size: int = 100
    source_system: str = "tradeweave"
    endpoint: str = "http://localhost:8080/api/v1/signals"
    retry_attempts: int = 3
    retry_delay: int = 5


# fixed values: names in nested settings files, and the knobs they set here
NESTED = {
    "graph.entity_resolution.similarity_threshold": "entity_resolution.similarity",
    "graph.entity_resolution.match_fields": "entity_resolution.fields",
    "graph.edge_weights.method": "edge_weights.method",
    "graph.edge_weights.components.frequency": "edge_weights.frequency",
    "graph.edge_weights.components.volume": "edge_weights.volume",
    "graph.edge_weights.components.recency": "edge_weights.recency",
    "analysis.community.algorithm": "community.algorithm",
    "analysis.community.resolution": "community.resolution",
    "analysis.community.min_community_size": "community.min_size",
    "analysis.community.random_seed": "community.seed",
    "analysis.centrality.pagerank.alpha": "centrality.alpha",
    "analysis.centrality.pagerank.max_iter": "centrality.max_iter",
    "analysis.centrality.pagerank.tol": "centrality.tol",
    "analysis.centrality.betweenness.normalized": "centrality.normalized",
    "analysis.centrality.betweenness.k": "centrality.k",
    "analysis.centrality.degree.normalized": "centrality.degree_normalized",
    "analysis.temporal.window_size": "temporal.window_days",
    "analysis.temporal.window_overlap": "temporal.overlap_days",
    "analysis.temporal.structural_change_threshold": "temporal.threshold",
    "analysis.propagation.max_depth": "propagation.max_depth",
    "analysis.propagation.decay_factor": "propagation.decay",
    "analysis.propagation.min_propagation_threshold": "propagation.threshold",
    "analysis.propagation.edge_type_weights": "propagation.type_weights",
    "detection.rings.max_cycle_length": "rings.max_cycle_length",
    "detection.rings.min_shared_attributes": "rings.min_shared",
    "detection.shell_company.centrality_volume_ratio": "shell.ratio",
    "detection.shell_company.min_flagged_connections": "shell.flagged",
    "detection.shell_company.free_trade_zones": "shell.zones",
    "detection.carousel.min_cycle_value": "carousel.min_value",
    "detection.carousel.max_cycle_days": "carousel.max_days",
    "detection.carousel.vat_countries": "carousel.vat_countries",
    "export.signals.endpoint": "signals.endpoint",
    "export.signals.batch_size": "signals.batch_size",
    "export.signals.retry_attempts": "signals.retry_attempts",
    "export.signals.retry_delay": "signals.retry_delay",
}


@dataclass(frozen=True)
class Settings:
    edge_weights: EdgeWeights = EdgeWeights()
    entity_resolution: EntityResolution = EntityResolution()
    community: Community = Community()
    centrality: Centrality = Centrality()
    temporal: Temporal = Temporal()
    propagation: Propagation = field(default_factory=Propagation)
    rings: Rings = Rings()
    shell: Shell = Shell()
    carousel: Carousel = Carousel()
    signals: Signals = Signals()

    @classmethod
    def from_dict(cls, tree: dict[str, Any]) -> Settings:
        """Sections and knobs by name; unknown ones raise ValueError.

        Nested trees (graph, analysis, detection, export) are read too; their
        server and database sections (api, neo4j) and graph.backend have no use here.
        """
        if set(tree or {}) & {"graph", "analysis", "detection", "export", "api", "neo4j"}:
            tree = _unnested({k: v for k, v in tree.items() if k not in ("api", "neo4j")})
        sections = {}
        for name, values in (tree or {}).items():
            f = next((x for x in dataclasses.fields(cls) if x.name == name), None)
            if f is None:
                raise ValueError(f"unknown section {name}")
            kind = type(getattr(cls(), name))
            known = {x.name for x in dataclasses.fields(kind)}
            if extra := set(values or {}) - known:
                raise ValueError(f"unknown settings in {name}: {sorted(extra)}")
            sections[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in (values or {}).items()})
        return cls(**sections)

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        """A YAML file; values that are wholly ``${NAME}`` come from the environment, or stay."""
        import yaml

        with open(path) as f:
            return cls.from_dict(_substituted(yaml.safe_load(f) or {}))


def _unnested(tree: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}

    def walk(x: dict[str, Any], path: str) -> None:
        for name, value in x.items():
            at = f"{path}{name}"
            if at in NESTED:
                section, knob = NESTED[at].split(".")
                out.setdefault(section, {})[knob] = value
            elif isinstance(value, dict):
                walk(value, f"{at}.")
            elif at != "graph.backend" and value is not None:
                raise ValueError(f"unknown setting {at}")

    walk(tree, "")
    return out


def _substituted(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _substituted(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_substituted(v) for v in x]
    if isinstance(x, str) and (m := re.fullmatch(r"\$\{(\w+)\}", x)):
        return os.environ.get(m[1], x)
    return x
