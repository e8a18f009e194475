"""Trust score and status label."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STATUSES = ("verified", "unclear", "contradicted")

# Weights, caps and thresholds of the score.
SINGLE_HIT_DISCOUNT = 0.20
SUPPORT_STEP, SUPPORT_CAP = 0.08, 0.30
CONTRADICTION_STEP, CONTRADICTION_CAP = 0.30, 0.80
VERIFIED_TRUST, VERIFIED_SUPPORTS = 0.75, 2


def trust_score(claims: Column, supports: Column, contradicts: Column, confidence: Column) -> Column:
    base = F.greatest(F.lit(0.0), confidence - F.lit(SINGLE_HIT_DISCOUNT))
    boost = F.least(F.lit(SUPPORT_CAP), F.lit(SUPPORT_STEP) * supports)
    penalty = F.least(F.lit(CONTRADICTION_CAP), F.lit(CONTRADICTION_STEP) * contradicts)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + boost - penalty))
    return F.when(claims == 0, F.lit(0.0)).otherwise(score)


def status_label(trust: Column, supports: Column, contradicts: Column) -> Column:
    return (
        F.when((contradicts >= 1) & (supports <= contradicts), F.lit("contradicted"))
        .when(contradicts >= 1, F.lit("unclear"))
        .when((trust >= VERIFIED_TRUST) & (supports >= VERIFIED_SUPPORTS), F.lit("verified"))
        .otherwise(F.lit("unclear"))
    )


def status_rank(status: Column) -> Column:
    return F.when(status == "verified", 0).when(status == "unclear", 1).otherwise(2)


def rollup_status(verified: Column, contradicted: Column) -> Column:
    return (
        F.when((contradicted > 0) & (verified == 0), F.lit("contradicted"))
        .when(verified >= 1, F.lit("verified"))
        .otherwise(F.lit("unclear"))
    )
