"""Declarations from JSON, from records, and from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DECLARATIONS


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of declarations, or one per line; the order within a file gives the ordinal where it is missing."""
    df = spark.read.schema(DECLARATIONS).option("multiLine", True).json(path)
    return df.withColumn("ordinal", F.coalesce("ordinal", F.format_string("%020d", F.monotonically_increasing_id())))


def from_records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([r | {"ordinal": r.get("ordinal") or f"{i:020d}"} for i, r in enumerate(rows)], DECLARATIONS)


def sample(spark: SparkSession, n: int = 20, importers: int = 5, exporters: int = 3, brokers: int = 2) -> DataFrame:
    """n synthetic declarations by modular arithmetic."""
    pick = lambda values, m: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % m + 1).cast("int"))
    return spark.range(n).select(
        F.format_string("DEC-TEST-%04d", "id").alias("declaration_id"),
        F.struct(
            F.format_string("IMP%03d", F.col("id") % importers).alias("tax_id"), F.format_string("Test Importer %d", F.col("id") % importers).alias("name"),
            pick(["US", "GB", "DE"], 3).alias("country"), pick(["123 Trade St", "456 Commerce Ave"], 2).alias("address"), F.lit(None).cast("string").alias("registration_date"),
        ).alias("importer"),
        F.struct(
            F.format_string("EXP%03d", F.col("id") % exporters).alias("tax_id"), F.format_string("Test Exporter %d", F.col("id") % exporters).alias("name"),
            pick(["CN", "VN", "IN"], 3).alias("country"), F.format_string("Export Zone %d", F.col("id") % 3).alias("address"),
        ).alias("exporter"),
        F.struct(pick(["8471.30", "6403.99"], 2).alias("hs_code"), pick(["Portable computers", "Footwear"], 2).alias("description")).alias("commodity"),
        F.struct(
            pick(["CN", "VN", "IN"], 3).alias("origin"), pick(["US", "GB", "DE"], 3).alias("destination"),
            F.when(F.col("id") % 3 == 0, F.array(F.lit("HK"))).when(F.col("id") % 3 == 1, F.array(F.lit("SG"))).otherwise(F.expr("cast(array() as array<string>)")).alias("transit"),
        ).alias("route"),
        F.struct(F.format_string("BRK-%03d", F.col("id") % brokers).alias("license_id"), F.format_string("Test Broker %d", F.col("id") % brokers).alias("name"), F.lit(None).cast("string").alias("type")).alias("agent"),
        F.lit(None).cast("string").alias("phone"),
        F.expr("cast(null as struct<bank_name:string,account_number:string>)").alias("bank_account"),
        (100000.0 + 5000 * F.col("id")).alias("value"),
        (500.0 + 25 * F.col("id")).alias("weight"),
        F.format_string("2025-01-%02d", F.col("id") % 28 + 1).alias("date"),
        F.format_string("%020d", "id").alias("ordinal"),
    )


#: One declaration per line item; runs in Spark SQL and in DuckDB.
FLAT_SQL = """
SELECT
  concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS declaration_id,
  concat(CAST(CAST(l_shipdate AS DATE) AS STRING), lpad(CAST(l_orderkey AS STRING), 14, '0'), lpad(CAST(l_linenumber AS STRING), 4, '0'),
    lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0'), lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), 16, '0')) AS ordinal,
  CAST(c_custkey AS STRING) AS imp, c_name AS imp_name, cn.n_name AS imp_country,
  CASE WHEN c_custkey % 3 < 2 THEN concat(CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING), ' Trade St.') ELSE concat(CAST(c_custkey AS STRING), ' Solo Ave.') END AS imp_address,
  CAST(DATE '1994-01-01' + CAST((c_custkey * 7) % 2500 AS INTEGER) AS STRING) AS imp_registered,
  CAST(s_suppkey AS STRING) AS exp, s_name AS exp_name, sn.n_name AS exp_country,
  CASE WHEN s_suppkey % 4 <> 0 THEN concat(sn.n_name, ' Export Rd. ', CAST(s_suppkey AS STRING))
       WHEN s_suppkey % 3 < 2 THEN concat(CAST(CAST(floor(s_suppkey / 3) AS BIGINT) AS STRING), ' Trade St.') ELSE concat(CAST(s_suppkey AS STRING), ' Solo Ave.') END AS exp_address,
  concat(p_brand, '.', p_type) AS hs_code, p_name AS description,
  sn.n_name AS origin, cn.n_name AS destination, CASE WHEN s_suppkey % 3 = 0 THEN r_name END AS transit,
  CASE WHEN o_orderpriority <> '5-LOW' THEN concat('BRK-', lpad(CAST(o_custkey % 25 AS STRING), 3, '0')) END AS license_id,
  CASE WHEN c_custkey % 7 < 2 THEN concat('+1 (555) ', lpad(CAST(CAST(floor(c_custkey / 7) AS BIGINT) AS STRING), 7, '0')) END AS phone,
  CASE WHEN c_custkey % 11 < 2 THEN concat('ACC', CAST(CAST(floor(c_custkey / 11) AS BIGINT) AS STRING)) END AS account,
  CASE WHEN c_custkey % 11 < 2 THEN concat('BANK', CAST(CAST(floor(c_custkey / 11) AS BIGINT) % 7 AS STRING)) END AS bank_name,
  l_extendedprice AS value, l_quantity AS weight, CAST(CAST(l_shipdate AS DATE) AS STRING) AS date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region ON sn.n_regionkey = r_regionkey
"""


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(FLAT_SQL)


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations made of the star-schema tables."""
    f = flat(spark, sf_dir)
    return f.select(
        "declaration_id",
        F.struct(F.col("imp").alias("tax_id"), F.col("imp_name").alias("name"), F.col("imp_country").alias("country"), F.col("imp_address").alias("address"), F.col("imp_registered").alias("registration_date")).alias("importer"),
        F.struct(F.col("exp").alias("tax_id"), F.col("exp_name").alias("name"), F.col("exp_country").alias("country"), F.col("exp_address").alias("address")).alias("exporter"),
        F.struct("hs_code", "description").alias("commodity"),
        F.struct("origin", "destination", F.array_compact(F.array("transit")).alias("transit")).alias("route"),
        F.when(F.col("license_id").isNotNull(), F.struct("license_id", F.col("license_id").alias("name"), F.lit(None).cast("string").alias("type"))).alias("agent"),
        "phone",
        F.when(F.col("account").isNotNull(), F.struct("bank_name", F.col("account").alias("account_number"))).alias("bank_account"),
        "value", "weight", "date", "ordinal",
    )
