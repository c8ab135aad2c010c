"""The documents pipeline: quality, toxicity, near-duplicates, benchmarks, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.llm import decontaminate, mixing, quality, simhash, toxicity
from tradeweave.llm.common import fresh, read, stored

#: The classifiers' own thresholds: documents below the one, or at or above the other, are rejected.
QUALITY = 0.5
TOXIC = 0.3


def _scored(docs: DataFrame, model, keep: str) -> DataFrame:
    """Rows of docs whose score the condition keeps; scores are made where the rows lie, and nothing is shuffled."""
    score = fresh("score", docs.columns)
    return docs.withColumn(score, model.column("text")).where(f"`{score}` {keep}").drop(score)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the key of each row, a 64-bit hash of its doc_id and text, as doc_id; the name of a column with the id.

    Rows of null or repeated ids thus go by verdicts of their own; rows with the
    same id and text are alike in every verdict.
    """
    own = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.col("text").isNull(), F.col("text").cast("string"))
    held = fresh("doc_id_", docs.columns)
    return docs.withColumn(held, F.col("doc_id")).withColumn("doc_id", own), held


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least QUALITY; null and empty texts score as the calibration's bias does."""
    return _scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")), f">= {QUALITY}")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below TOXIC; null and empty texts score as texts without n-grams."""
    return _scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")), f"< {TOXIC}")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, Jaccard 0.8 or more) one row stays.

    It is the one with the smallest doc_id, null ids last, then with the
    smallest key. Null and wordless texts are one class. Rows outside any class
    all stay, whatever their ids.
    """
    keyed, held = _keyed(docs)
    found = stored(simhash.similar(keyed)).join(keyed.select("doc_id", F.col(held).alias("id")).distinct(), "doc_id")
    first = found.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("first"))
    # rows with one key are exact copies, of which one stays
    kept = keyed.join(first.select(F.col("first.doc_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.withColumn("doc_id", F.col(held)).drop(held)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage; null and wordless texts have none."""
    keyed, held = _keyed(docs)
    hit = decontaminate.contamination(keyed, read(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return keyed.join(hit, "doc_id", "left_anti").withColumn("doc_id", F.col(held)).drop(held)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the calibrated sample selects; null and wordless texts are never selected."""
    mix = fresh("mix", docs.columns)
    return mixing.mixed(docs).where(f"`{mix}`.selected").drop(mix)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifiers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents that all stages keep, with the columns they had; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
