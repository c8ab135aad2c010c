"""Column functions of the builder and the risk ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: abbreviations, replaced in this order
ABBREVIATIONS = (
    (" st.", " street"),
    (" st ", " street "),
    (" rd.", " road"),
    (" rd ", " road "),
    (" ave.", " avenue"),
    (" ave ", " avenue "),
    (" blvd.", " boulevard"),
    (" blvd ", " boulevard "),
    (" ste.", " suite"),
    (" ste ", " suite "),
    (" apt.", " apartment"),
    (" apt ", " apartment "),
)


def address(c: Column) -> Column:
    c = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    for short, long in ABBREVIATIONS:
        c = F.replace(c, F.lit(short), F.lit(long))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def phone(c: Column) -> Column:
    """Digits and plus signs."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9+]", "")


def address_id(c: Column) -> Column:
    return F.concat(F.lit("ADDR:"), F.substring(F.md5(address(c)), 1, 12))


def account_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 16)


def recency(last_seen: Column, as_of: str) -> Column:
    """1 on the day or after, falling to 0 in a year; 0 without a date."""
    d = F.datediff(F.lit(as_of).cast("date"), F.try_to_date(F.substring(last_seen, 1, 10)))
    return F.when(d.isNull(), 0.0).when(d < 0, 1.0).when(d > 365, 0.0).otherwise(1 - d / F.lit(365.0))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")


def money(c: Column) -> Column:
    """An order-free sum: exact decimals inside, double outside."""
    return F.sum(c.cast("decimal(28,4)")).cast("double")


def truthy(c: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.size(c) > 0
    if kind in ("double", "bigint", "int"):
        return c != 0
    return c != ""
