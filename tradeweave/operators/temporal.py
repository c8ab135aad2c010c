"""Windowed snapshots, structural changes, community evolution, velocity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import TradeGraph
from .traversal import label_components


def windows(spark: SparkSession, start: str, end: str, days: int = 30, overlap: int = 7) -> DataFrame:
    """window_id, window_start, window_end: whole windows only, both ends inclusive."""
    if overlap >= days:
        raise ValueError("the overlap must be shorter than the window")
    step = days - overlap
    last = f"date_add(date'{end}', {1 - days})"
    s = spark.sql(f"SELECT explode_outer(if({last} >= date'{start}', sequence(date'{start}', {last}, interval {step} days), array())) AS s").where("s is not null")
    n = F.floor(F.datediff("s", F.lit(start).cast("date")) / step).cast("int")
    return s.select(n.alias("window_id"), F.col("s").cast("string").alias("window_start"), F.date_add("s", days - 1).cast("string").alias("window_end"))


def snapshot_edges(edges: DataFrame, spans: DataFrame, date: str = "last_seen") -> DataFrame:
    """window_id, src, dst, edge_type of the edges whose date is in the window; one scan for all windows."""
    day = F.try_to_date(F.substring(date, 1, 10))
    e = edges.select("src", "dst", "edge_type", day.alias("day")).where("day is not null")
    inside = (F.col("day") >= F.col("window_start").cast("date")) & (F.col("day") <= F.col("window_end").cast("date"))
    return e.join(F.broadcast(spans), inside).select("window_id", "src", "dst", "edge_type").distinct()  # spans: a row per window


def snapshot_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("window_id", F.col("src").alias("node_id")).union(edges.select("window_id", "dst")).distinct()


def snapshot_node_types(graph: TradeGraph, edges: DataFrame) -> DataFrame:
    """window_id, node_type, count of the nodes in each window. edges: those of ``snapshot_edges``."""
    types = graph.nodes.select("node_id", "node_type")
    return snapshot_nodes(edges).join(types, "node_id").groupBy("window_id", "node_type").agg(F.count("*").alias("count"))


def snapshots(edges: DataFrame, spans: DataFrame, with_components: bool = True) -> DataFrame:
    """window_id, window_start, window_end, node_count, edge_count, density, components."""
    e = edges.groupBy("window_id").agg(F.count("*").alias("edge_count"))
    n = snapshot_nodes(edges).groupBy("window_id").agg(F.count("*").alias("node_count"))
    x = spans.join(n, "window_id", "left").join(e, "window_id", "left")
    if with_components:
        key = lambda c: F.concat_ws("|", F.lpad(F.col("window_id").cast("string"), 8, "0"), F.col(c))
        c = label_components(edges.select(key("src").alias("a"), key("dst").alias("b")), "a", "b")
        c = c.where("node = component").groupBy(F.substring("node", 1, 8).cast("int").alias("window_id")).agg(F.count("*").alias("components"))
        x = x.join(c, "window_id", "left")
    else:
        x = x.withColumn("components", F.lit(0).cast("bigint"))
    x = x.fillna(0, ["node_count", "edge_count", "components"])
    pairs = F.col("node_count").cast("double") * (F.col("node_count") - 1)
    return x.withColumn("density", F.when(F.col("node_count") > 1, F.col("edge_count") / pairs).otherwise(0.0))


def _moves(rows: DataFrame) -> list[tuple[str, DataFrame]]:
    """change_type and the rows that a window has and the one before hasn't, or the other way; rows are those of snapshots."""
    what = "nodes" if "node_id" in rows.columns else "edges"
    before = rows.withColumn("window_id", F.col("window_id") + 1)
    return [(f"{kind}_{what}", a.join(b, rows.columns, "left_anti")) for kind, a, b in (("new", rows, before), ("disappeared", before, rows))]


def changed_entities(edges: DataFrame, found: DataFrame) -> DataFrame:
    """window_id, change_type, node_id: nodes, and ends of edges, that came or went, a row each.

    found: rows of ``changes``; those of density and components have no entities.
    """
    parts = [x.select("window_id", F.lit(kind).alias("change_type"), F.explode(F.array("src", "dst")).alias("node_id")).distinct() for kind, x in _moves(edges)]
    parts += [x.select("window_id", F.lit(kind).alias("change_type"), "node_id") for kind, x in _moves(snapshot_nodes(edges))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.join(found.select("window_id", "change_type"), ["window_id", "change_type"], "left_semi")


def changes(edges: DataFrame, metrics: DataFrame, threshold: float = 0.15) -> DataFrame:
    """window_id, change_type, severity, previous, current, count for each window against the one before."""
    spans = metrics.select("window_id")

    def moved(rows: DataFrame) -> list[DataFrame]:
        size = rows.groupBy("window_id").agg(F.count("*").alias("size"))
        base = spans.join(size.select((F.col("window_id") + 1).alias("window_id"), F.col("size").alias("previous")), "window_id", "left").join(size.withColumnRenamed("size", "current"), "window_id", "left").fillna(0)
        out = []
        for kind, x in _moves(rows):
            n = x.groupBy("window_id").agg(F.count("*").alias("count"))
            out.append(base.join(n, "window_id").select("window_id", F.lit(kind).alias("change_type"), F.least(F.col("count") / F.greatest("previous", F.lit(1)), F.lit(1.0)).alias("severity"), F.col("previous").cast("double").alias("previous"), F.col("current").cast("double").alias("current"), "count"))
        return out

    w = Window.orderBy("window_id")  # a row per window
    m = metrics.select("window_id", "density", "components", F.lag("density").over(w).alias("pd"), F.lag("components").over(w).alias("pc")).where("pd is not null")
    parts = [*moved(edges), *moved(snapshot_nodes(edges))]
    one = F.lit(1).cast("bigint").alias("count")
    parts.append(m.select("window_id", F.lit("density_change").alias("change_type"), F.least(F.abs(F.col("density") - F.col("pd")) / F.greatest("pd", F.lit(0.01)), F.lit(1.0)).alias("severity"), F.col("pd").alias("previous"), F.col("density").alias("current"), one))
    kind = F.when(F.col("components") > F.col("pc"), "component_fragmentation").otherwise("component_consolidation")
    parts.append(m.where("components <> pc").select("window_id", kind.alias("change_type"), F.least(F.abs(F.col("components") - F.col("pc")) / F.greatest("pc", F.lit(1)), F.lit(1.0)).alias("severity"), F.col("pc").cast("double").alias("previous"), F.col("components").cast("double").alias("current"), one))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    first = F.broadcast(spans.agg(F.min("window_id").alias("first")))
    return out.crossJoin(first).where("window_id > first").drop("first").where(F.col("severity") >= threshold)


def _sizes(p: DataFrame) -> DataFrame:
    return p.groupBy("community_id").agg(F.count("*").alias("size"))


def _matched(previous: DataFrame, current: DataFrame) -> DataFrame:
    """c, p, previous_size, current_size, j: for each current community the previous one most like it, if like enough."""
    ps, cs = _sizes(previous).toDF("p", "previous_size"), _sizes(current).toDF("c", "current_size")
    both = current.select("node_id", F.col("community_id").alias("c")).join(previous.select("node_id", F.col("community_id").alias("p")), "node_id").groupBy("c", "p").agg(F.count("*").alias("n"))
    j = both.join(ps, "p").join(cs, "c").withColumn("j", F.col("n") / (F.col("previous_size") + F.col("current_size") - F.col("n")))
    return j.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("j"), "p"))).where("r = 1 and j > 0.3")


def evolution_members(previous: DataFrame, current: DataFrame) -> DataFrame:
    """community_id, event, node_id: the nodes that each community of ``evolution`` gained (added) or lost (removed).

    New communities gained all their nodes, dissolved ones, named by their previous id, lost all.
    """
    pair = _matched(previous, current).select("c", "p")
    now, old = current.select("node_id", F.col("community_id").alias("c")), previous.select("node_id", F.col("community_id").alias("p"))
    added = now.join(pair, "c", "left").join(old, ["node_id", "p"], "left_anti").select(F.col("c").alias("community_id"), F.lit("added").alias("event"), "node_id")
    removed = old.join(pair, "p", "left").join(now, ["node_id", "c"], "left_anti")
    return added.unionByName(removed.select(F.coalesce("c", "p").alias("community_id"), F.lit("removed").alias("event"), "node_id"))


def evolution(previous: DataFrame, current: DataFrame) -> DataFrame:
    """community_id, event_type, previous_size, current_size, jaccard_similarity; both: node_id, community_id."""
    ps, cs = _sizes(previous).toDF("p", "previous_size"), _sizes(current).toDF("c", "current_size")
    best = _matched(previous, current)
    ratio = F.col("current_size") / F.col("previous_size")
    kind = F.when(F.col("j") > 0.8, "stable").when(ratio > 1.3, "grow").when(ratio < 0.7, "shrink").otherwise("evolve")
    kept = best.select(F.col("c").alias("community_id"), kind.alias("event_type"), "previous_size", "current_size", F.col("j").alias("jaccard_similarity"))
    new = cs.join(best, "c", "left_anti").select(F.col("c").alias("community_id"), F.lit("new").alias("event_type"), F.lit(0).cast("bigint").alias("previous_size"), "current_size", F.lit(0.0).alias("jaccard_similarity"))
    gone = ps.join(best, "p", "left_anti").select(F.col("p").alias("community_id"), F.lit("dissolved").alias("event_type"), "previous_size", F.lit(0).cast("bigint").alias("current_size"), F.lit(0.0).alias("jaccard_similarity"))
    return kept.unionByName(new).unionByName(gone)


def velocity(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """node_growth, edge_growth, density_trend, turnover; one row."""
    w = Window.orderBy("window_id")  # a row per window
    m = metrics.select("window_id", "density", (F.col("node_count") - F.lag("node_count").over(w)).alias("dn"), (F.col("edge_count") - F.lag("edge_count").over(w)).alias("de"))
    grown = m.agg(F.coalesce(F.avg("dn"), F.lit(0.0)).alias("node_growth"), F.coalesce(F.avg("de"), F.lit(0.0)).alias("edge_growth"), F.coalesce(F.regr_slope("density", "window_id"), F.lit(0.0)).alias("density_trend"), F.max("window_id").alias("last"))
    n = snapshot_nodes(edges).select("window_id", "node_id", F.lit(1).alias("now"))
    old = n.select((F.col("window_id") + 1).alias("window_id"), "node_id", F.lit(1).alias("before"))
    pair = n.join(old, ["window_id", "node_id"], "full_outer").crossJoin(F.broadcast(metrics.agg(F.min("window_id").alias("lo"), F.max("window_id").alias("hi")))).where("window_id > lo and window_id <= hi")
    t = pair.groupBy("window_id").agg((F.count_if(F.col("now").isNull() | F.col("before").isNull()) / F.count("*")).alias("t")).agg(F.coalesce(F.avg("t"), F.lit(0.0)).alias("turnover"))
    return grown.drop("last").crossJoin(t)
