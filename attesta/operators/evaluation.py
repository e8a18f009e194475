"""Scoring the pipeline against hand labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import STATUSES

PREDICTED = (*STATUSES, "absent")


def labelled(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """The entities that a label names, taken before any text of the others is looked at."""
    return entities.join(labels.select("facility_id").distinct().hint("shuffle_hash"), "facility_id", "left_semi")


def predictions(labels: DataFrame, trust: DataFrame, fixtures: DataFrame | None = None) -> DataFrame:
    """Every label with the status found for its pair, ``absent`` without a claim.

    Labels whose facility is not among ``fixtures`` are left out; ``missing_fixtures``
    lists them.
    """
    if fixtures is not None:
        labels = labels.join(fixtures.select("facility_id"), "facility_id", "left_semi")
    t = trust.select(
        "facility_id", F.col("capability").alias("claim_value"),
        "status", "trust_score", "supporting_evidence_count", "contradicting_evidence_count",
        "claim_count",
    )
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return labels.join(t, ["facility_id", "claim_value"], "left").select(
        *labels.columns,
        F.coalesce("status", F.lit("absent")).alias("predicted_status"),
        F.round(F.coalesce("trust_score", F.lit(0.0)), 2).alias("trust"),
        zero("supporting_evidence_count", "supports"),
        zero("contradicting_evidence_count", "contradicts"),
        zero("claim_count", "claim_count"),
    )


def missing_fixtures(labels: DataFrame, fixtures: DataFrame) -> DataFrame:
    return labels.join(fixtures.select("facility_id"), "facility_id", "left_anti")


def metrics(predicted: DataFrame) -> DataFrame:
    """Accuracy, and precision and recall of the contradicted class (1.0 when undefined)."""
    hit = F.col("predicted_status") == F.col("expected_status")
    flagged = F.col("predicted_status") == "contradicted"
    truly = F.col("expected_status") == "contradicted"
    ratio = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / F.nullif(b, F.lit(0)))
    counts = predicted.agg(
        F.count("*").alias("total"),
        F.count_if(hit).alias("passed"),
        F.count_if(flagged & truly).alias("tp"),
        F.count_if(flagged & ~truly).alias("fp"),
        F.count_if(~flagged & truly).alias("fn"),
    )
    c = F.col
    return counts.select(
        "total", "passed",
        F.round(c("passed") / F.nullif("total", F.lit(0)), 6).alias("accuracy"),
        F.round(ratio(c("tp"), c("tp") + c("fp")), 6).alias("contradiction_precision"),
        F.round(ratio(c("tp"), c("tp") + c("fn")), 6).alias("contradiction_recall"),
    )


def confusion_matrix(predicted: DataFrame) -> DataFrame:
    """Expected by predicted, the full grid with zeros, in one aggregate pass."""
    cell = lambda e, p: F.count_if(
        (F.col("expected_status") == e) & (F.col("predicted_status") == p)
    )
    grid = predicted.agg(
        F.array(
            *[
                F.struct(F.lit(e).alias("expected"), *[cell(e, p).alias(p) for p in PREDICTED])
                for e in STATUSES
            ]
        ).alias("grid")
    )
    return grid.select(F.inline("grid"))


def misses(predicted: DataFrame) -> DataFrame:
    return predicted.filter(F.col("predicted_status") != F.col("expected_status"))
