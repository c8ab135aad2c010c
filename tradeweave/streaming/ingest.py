"""Extension: declarations as a stream, into a graph that is read at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EdgeWeights
from ..operators.build import edge_rows, node_rows, prepared, validated, weighted
from ..operators.graph import TradeGraph
from ..schema import DECLARATIONS


def declarations(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the JSON files, one declaration a line, that arrive in a folder."""
    return spark.readStream.schema(DECLARATIONS).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(stream: DataFrame, path: str, as_of: str) -> StreamingQuery:
    """Writes each batch to a folder of its own, valid declarations with their ids and rejects.

    A batch that runs again after a failure overwrites its own folder, so each
    declaration counts once. A missing ordinal orders rows by batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        place = F.concat(F.lit(f"{number:012d}"), F.format_string("%020d", F.monotonically_increasing_id()))
        valid, rejects = validated(batch.withColumn("ordinal", F.coalesce("ordinal", place)))
        prepared(valid, as_of).write.mode("overwrite").parquet(f"{path}/declarations/batch={number}")
        rejects.write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str, as_of: str, cfg: EdgeWeights = EdgeWeights()) -> TradeGraph:
    """The graph of all batches so far."""
    p = spark.read.parquet(f"{path}/declarations").drop("batch")
    return TradeGraph(node_rows(p), weighted(edge_rows(p), as_of, cfg))


def link_windows(stream: DataFrame, length: str = "30 days", step: str = "7 days", late: str = "30 days") -> DataFrame:
    """window_start, imp, exp, declarations, total_value in sliding windows of the declarations'
    dates; rows later than the watermark are left out. Runs on streams and on tables."""
    at = F.to_timestamp(F.substring("date", 1, 10))
    rows = stream.select(at.alias("at"), F.col("importer.tax_id").alias("imp"), F.col("exporter.tax_id").alias("exp"), F.coalesce("value", F.lit(0.0)).alias("value"))
    w = rows.withWatermark("at", late).groupBy(F.window("at", length, step).alias("w"), "imp", "exp")
    return w.agg(F.count("*").alias("declarations"), F.sum("value").alias("total_value")).select(F.col("w.start").alias("window_start"), "imp", "exp", "declarations", "total_value")
