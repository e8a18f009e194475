"""Data-quality audit over the cleaned and scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cleaning import percent
from ..functions.scoring import STATUSES

_COVERAGE = (
    "valid_coords", "with_capability_array", "with_specialties", "with_equipment_array",
    "with_citations", "with_year_established",
)


def overview(facilities: DataFrame) -> DataFrame:
    """Coverage counts in one pass, with percentages."""
    filled = lambda c: F.count_if(F.size(c) > 0)
    counts = facilities.agg(
        F.count("*").alias("total"),
        F.count_if("has_valid_coords").alias("valid_coords"),
        F.count_if(~F.col("has_valid_coords") & F.col("latitude").isNotNull()).alias("bad_coords_dropped"),
        filled("capabilities").alias("with_capability_array"),
        filled("specialties").alias("with_specialties"),
        filled("equipment").alias("with_equipment_array"),
        filled("source_urls").alias("with_citations"),
        F.count("year_established").alias("with_year_established"),
        F.count("capacity").alias("with_capacity"),
    )
    return counts.select(
        "*", *[percent(F.col(c), F.col("total")).alias(f"{c}_pct") for c in _COVERAGE]
    )


def group_counts(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), key)


def state_sources(facilities: DataFrame) -> DataFrame:
    return group_counts(facilities, "state_source", "facilities")


def claims_by_capability(claims: DataFrame) -> DataFrame:
    return group_counts(claims.select(F.col("claim_value").alias("capability")), "capability", "claims")


def status_by_capability(trust: DataFrame) -> DataFrame:
    return (
        trust.groupBy("capability", "status")
        .agg(F.count("*").alias("facilities"), F.round(F.avg("trust_score"), 3).alias("avg_trust"))
        .orderBy("capability", "status")
    )


def status_pivot(trust: DataFrame) -> DataFrame:
    """Capability by status, zero where a status does not occur."""
    return (
        trust.groupBy("capability").pivot("status", list(STATUSES)).count().na.fill(0)
        .orderBy("capability")
    )


def correction_examples(facilities: DataFrame, limit: int = 10) -> DataFrame:
    """Entities whose raw state the postcode lookup replaced."""
    return (
        facilities.filter(
            (F.col("state_source") == "pincode") & (F.col("state_raw") != F.col("state"))
        )
        .orderBy("facility_id")
        .limit(limit)
        .select("name", "state_raw", F.col("state").alias("state_resolved"), "district", "pincode")
    )
