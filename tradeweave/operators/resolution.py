"""Extensions: entities under nearly the same name, and edges of parties that occur together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..schema import ENTITY_TYPES
from .build import merged
from .graph import TradeGraph
from .traversal import label_components


def plain_name(c: Column) -> Column:
    """Lower case, other than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def near_names(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """a, b: pairs of ids of names whose 1 - levenshtein / longer length is at least the threshold.

    names has id, block, name, with distinct (block, name); pairs are of one
    block. No pair is lost: a name of length n is cut into one more segment than
    the edits that a partner of the greatest length may need, so some segment is
    left whole in the partner, at most as far from its place as there are edits.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above 0.5 and at most 1")
    longest = f"cast(floor(n / {threshold!r} + 1e-9) as int)"
    edits = lambda n: f"cast(floor((1 - {threshold!r}) * {n} + 1e-9) as int)"
    x = names.select("id", "block", "name", F.length("name").alias("n")).where("n > 0")
    cuts = x.withColumn("k", F.expr(f"least({edits(longest)}, n - 1)"))
    cuts = cuts.select("id", "block", "name", "n", "k", F.explode(F.expr("sequence(0, k)")).alias("i"))
    cuts = cuts.withColumn("at", F.expr("cast(floor(i * n / (k + 1)) as int)")).withColumn("to", F.expr("cast(floor((i + 1) * n / (k + 1)) as int)"))
    cuts = cuts.select("block", "n", "i", F.expr("substring(name, at + 1, to - at)").alias("part"), F.col("id").alias("a"), F.col("name").alias("a_name"))
    # the longer partner looks for the cuts of every length it may be near to
    shortest = f"cast(ceil(n * {threshold!r} - 1e-9) as int)"
    probes = x.select("id", "block", "name", F.col("n").alias("own"), F.explode(F.expr(f"sequence(greatest(1, {shortest}), n)")).alias("n"))
    probes = probes.withColumn("k", F.expr(f"least({edits(longest)}, n - 1)")).withColumn("d", F.expr(edits("own")))
    probes = probes.select("*", F.explode(F.expr("sequence(0, k)")).alias("i"))
    probes = probes.withColumn("at", F.expr("cast(floor(i * n / (k + 1)) as int)")).withColumn("size", F.expr("cast(floor((i + 1) * n / (k + 1)) as int) - at"))
    probes = probes.select("*", F.explode(F.expr("sequence(greatest(0, at - d), greatest(0, at - d, least(own - size, at + d)))")).alias("p"))
    probes = probes.select("block", "n", "i", F.expr("substring(name, p + 1, size)").alias("part"), F.col("id").alias("b"), F.col("name").alias("b_name"), "own").distinct()
    pairs = cuts.join(probes, ["block", "n", "i", "part"]).where((F.col("n") < F.col("own")) | (F.col("a") < F.col("b")))
    pairs = pairs.where(F.col("a") != F.col("b")).select("a", "b", "a_name", "b_name", "own").distinct()
    return pairs.where(F.levenshtein("a_name", "b_name") <= F.expr(edits("own"))).select("a", "b")


def resolve(graph: TradeGraph, threshold: float = 0.85, node_types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """node_id, canonical_id (smallest id of its class) of named entities.

    Entities of one type and country are linked where their names are equal or
    near; classes are the connected components. Repeated names are compared once.
    """
    n = graph.nodes.where(F.col("node_type").isin(*node_types))
    n = n.select("node_id", F.concat_ws("|", "node_type", F.coalesce("country", F.lit(""))).alias("block"), plain_name(F.col("name")).alias("name")).where("name <> ''")
    distinct = n.groupBy("block", "name").agg(F.min("node_id").alias("id"))
    classes = label_components(near_names(distinct, threshold), "a", "b").toDF("id", "canonical_id")
    found = distinct.join(classes, "id", "left").select("block", "name", F.coalesce("canonical_id", "id").alias("canonical_id"))
    return n.join(found, ["block", "name"]).select("node_id", "canonical_id")


def unified(graph: TradeGraph, resolved: DataFrame) -> TradeGraph:
    """The graph with each class as its canonical node; parallel edges are added up.

    The first truthy attribute wins, the canonical node's own before others by
    id; the risk is the class's greatest. Weights are to be computed anew.
    """
    other = resolved.where("node_id <> canonical_id")
    to = lambda e, c: e.join(other.toDF(c, "_to"), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    e = to(to(graph.edges, "src"), "dst").where("src <> dst")
    e = e.groupBy("src", "dst", "edge_type").agg(F.sum("transaction_count").alias("transaction_count"), N.money(F.col("total_value")).alias("total_value"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    hit = resolved.groupBy("canonical_id").agg(F.count("*").alias("k")).where("k > 1").select("canonical_id")
    part = resolved.join(hit, "canonical_id", "left_semi")
    rows = graph.nodes.join(part, "node_id").withColumn("ordinal", F.concat(F.when(F.col("node_id") == F.col("canonical_id"), "0").otherwise("1"), "node_id"))
    risk = rows.groupBy(F.col("canonical_id").alias("node_id")).agg(F.max("risk_score").alias("risk_score"), F.bool_or("flagged").alias("flagged"))
    kept = [c for c in graph.nodes.columns if c not in ("node_id", "risk_score", "risk_level", "flagged", "community_id")]
    one = merged(rows.drop("node_id").withColumnRenamed("canonical_id", "node_id"), "node_id", kept).join(risk, "node_id")
    one = one.withColumn("risk_level", N.risk_level(F.col("risk_score")))
    rest = graph.nodes.join(part.select("node_id"), "node_id", "left_anti")
    return TradeGraph(rest.unionByName(one, allowMissingColumns=True), e)


def co_occurrence(parties: DataFrame) -> DataFrame:
    """CO_OCCURS_WITH edges of the parties of a declaration, in the form of other edges.

    parties has imp, exp, agt (null where there is none), value, date; a
    declaration gives at most three pairs, so the work follows their number.
    """
    pair = lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("both"))
    rows = parties.select("value", "date", F.explode(F.array(pair("imp", "exp"), pair("imp", "agt"), pair("exp", "agt"))).alias("p")).where("p.both").select("p.src", "p.dst", "value", "date")
    return rows.groupBy("src", "dst", F.lit("CO_OCCURS_WITH").alias("edge_type")).agg(
        F.count("*").alias("transaction_count"), N.money(F.col("value")).alias("total_value"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )


__all__ = ["co_occurrence", "near_names", "plain_name", "resolve", "unified"]
