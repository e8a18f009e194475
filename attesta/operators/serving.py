"""Ranked, filtered and counted views over the cleaned and scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cleaning import cut, in_bbox, prefix_match
from ..functions.scoring import STATUSES, rollup_status, status_rank

PLACE_COLUMNS = ("state", "city")
BROADCAST_ROWS = 10_000


def in_place(entities: DataFrame, place: str | None) -> DataFrame:
    if not place:
        return entities
    return entities.filter(prefix_match(place, *[F.col(c) for c in PLACE_COLUMNS]))


def status_counts(statuses: DataFrame) -> DataFrame:
    """total, verified, unclear, contradicted over the whole input."""
    return statuses.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
    )


def _triaged(
    trust: DataFrame, entities: DataFrame, capability: str, place: str | None, min_trust: float
) -> DataFrame:
    asked = trust.filter((F.col("capability") == capability) & (F.col("trust_score") >= min_trust))
    return asked.join(in_place(entities, place), "facility_id")


TRIAGE_COLUMNS = (
    "facility_id", "name", "city", "state", "pincode", "latitude", "longitude", "claim_count",
    "supporting_evidence_count", "contradicting_evidence_count", "trust_score", "status",
    "official_phone", "official_website", "source_urls", "capabilities", "procedures",
    "equipment", "description",
)


def triage(
    trust: DataFrame, entities: DataFrame, capability: str, place: str | None = None,
    min_trust: float = 0.0, limit: int = 200, wide: DataFrame | None = None,
) -> DataFrame:
    """Entities that claim a capability, best status and trust first; ties by id.

    Ids and scores are joined, ranked and cut first; texts and lists are then fetched for the
    survivors, from ``wide`` if given, as when ``entities`` is a filter that is dear to work out twice.
    """
    wide = entities if wide is None else wide
    columns = [c for c in TRIAGE_COLUMNS if c in wide.columns or c in trust.columns]
    ranked = (status_rank(F.col("status")), F.col("trust_score").desc(), F.col("facility_id"))
    scores = [c for c in trust.columns if c in columns]
    narrow = entities.select("facility_id", *PLACE_COLUMNS)
    top = (
        _triaged(trust, narrow, capability, place, min_trust)
        .select(*scores).distinct().orderBy(*ranked).limit(limit)
    )
    # At most ``limit`` rows of ids and numbers; beyond the bound the planner decides by what it measures.
    few = F.broadcast(top) if limit <= BROADCAST_ROWS else top
    return wide.join(few, "facility_id").orderBy(*ranked).limit(limit).select(*columns)


def triage_counts(
    trust: DataFrame, entities: DataFrame, capability: str, place: str | None = None,
    min_trust: float = 0.0,
) -> DataFrame:
    return status_counts(_triaged(trust, entities, capability, place, min_trust))


def entity_rollup(trust: DataFrame) -> DataFrame:
    """Best trust, status counts and verified capabilities per entity.

    The set is bounded by the taxonomy, whatever the number of rows.
    """
    return trust.groupBy("facility_id").agg(
        F.max("trust_score").alias("best_trust"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_caps") for s in STATUSES],
        F.sort_array(
            F.collect_set(F.when(F.col("status") == "verified", F.col("capability")))
        ).alias("verified_capabilities"),
    )


def browsed(trust: DataFrame, entities: DataFrame, place: str | None = None) -> DataFrame:
    """Every entity of a place with its roll-up, also those without any claim."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        in_place(entities, place)
        .join(entity_rollup(trust), "facility_id", "left")
        .withColumn("trust_score", F.coalesce("best_trust", F.lit(0.0)))
        .withColumn("status", rollup_status(zero("verified_caps"), zero("contradicted_caps")))
        .withColumns({f"{s}_caps": zero(f"{s}_caps") for s in STATUSES})
    )


BROWSE_COLUMNS = (
    "facility_id", "name", "city", "state", "pincode", "latitude", "longitude", "trust_score",
    "verified_caps", "unclear_caps", "contradicted_caps", "verified_capabilities", "status",
    "official_phone", "official_website", "source_urls",
)


def browse(
    trust: DataFrame, entities: DataFrame, place: str | None = None, limit: int = 200
) -> DataFrame:
    rows = browsed(trust, entities, place)
    return (
        rows.orderBy(
            status_rank(F.col("status")), F.col("best_trust").desc_nulls_last(), "name", "facility_id"
        )
        .limit(limit)
        .select(*[c for c in BROWSE_COLUMNS if c in rows.columns])
    )


def browse_counts(trust: DataFrame, entities: DataFrame, place: str | None = None) -> DataFrame:
    return status_counts(browsed(trust, entities.select("facility_id", *PLACE_COLUMNS), place))


def entity_detail(entities: DataFrame, facility_id: str) -> DataFrame:
    return entities.filter(F.col("facility_id") == facility_id)


def _of(df: DataFrame, facility_id: str | None) -> DataFrame:
    return df if facility_id is None else entity_detail(df, facility_id)


def claims_with_evidence(
    claims: DataFrame, trust: DataFrame, facility_id: str | None = None
) -> DataFrame:
    """Claims with the score of their pair; those of one entity come best trust first.

    All entities together, the default, stay unordered, as a total sort would move every row.
    """
    t = _of(trust, facility_id).select(
        "facility_id", F.col("capability").alias("claim_value"), "trust_score", "status",
        "supporting_evidence_count", "contradicting_evidence_count",
    )
    joined = (
        _of(claims, facility_id)
        .join(t, ["facility_id", "claim_value"], "left")
        .select(
            "facility_id", "claim_id", "claim_type", "claim_value", "claim_raw", "source_field",
            "source_text_span", "extraction_confidence", "llm_model", "trust_score", "status",
            "supporting_evidence_count", "contradicting_evidence_count", "claim_ord",
        )
    )
    if facility_id is None:
        return joined
    return joined.orderBy(F.col("trust_score").desc_nulls_last(), "claim_ord")


# Fixed value: how much of a claim's wording its group lists (None: all).
LISTED_LENGTH = 160


def claim_groups(joined: DataFrame, listed_length: int | None = LISTED_LENGTH) -> DataFrame:
    """Header per (entity, capability): status, counts, the claim that actions refer to, and
    where the capability is claimed, in the order of the claims."""
    place = F.struct("claim_ord", "source_field", cut(F.col("claim_raw"), listed_length).alias("claim_raw"))
    return (
        joined.groupBy("facility_id", F.col("claim_value").alias("capability"))
        .agg(
            F.min(F.struct("claim_ord", "claim_id", "claim_raw")).alias("first"),
            F.count("*").alias("claims"),
            F.sort_array(F.collect_list(place)).alias("places"),
            F.max("trust_score").alias("trust_score"),
            F.max("status").alias("status"),
            F.max("supporting_evidence_count").alias("supporting_evidence_count"),
            F.max("contradicting_evidence_count").alias("contradicting_evidence_count"),
        )
        .select(
            "facility_id", "capability", F.col("first.claim_id").alias("claim_id"),
            F.col("first.claim_raw").alias("claim_raw"), "claims",
            F.transform(
                "places", lambda p: F.struct(p["source_field"].alias("source_field"), p["claim_raw"].alias("claim_raw"))
            ).alias("claimed_in"),
            F.coalesce("trust_score", F.lit(0.0)).alias("trust_score"),
            F.coalesce("status", F.lit("unclear")).alias("status"),
            F.coalesce("supporting_evidence_count", F.lit(0)).alias("supporting_evidence_count"),
            F.coalesce("contradicting_evidence_count", F.lit(0)).alias("contradicting_evidence_count"),
        )
    )


EVIDENCE_COLUMNS = (
    "facility_id", "claim_id", "evidence_id", "snippet", "source_field", "polarity", "retrieval_score",
)


def entity_evidence(
    evidence: DataFrame, claims: DataFrame, facility_id: str | None = None
) -> DataFrame:
    """Evidence of claims, supports first for one entity; unordered for all entities together."""
    joined = (
        _of(evidence, facility_id)
        .join(_of(claims, facility_id).select("facility_id", "claim_id"), ["facility_id", "claim_id"])
        .select(*EVIDENCE_COLUMNS)
    )
    if facility_id is None:
        return joined
    return joined.orderBy(F.col("polarity").desc(), F.col("retrieval_score").desc(), "evidence_id")


def evidence_for_capability(evidence: DataFrame, claims: DataFrame, capability: str) -> DataFrame:
    """Evidence whose claim belongs to one capability."""
    of = claims.filter(F.col("claim_value") == capability).select("facility_id", "claim_id")
    return evidence.join(of, ["facility_id", "claim_id"], "left_semi").select(*EVIDENCE_COLUMNS)


DISTRICT_INDICATORS = (
    "women_age_15_49_who_are_literate_pct", "hh_member_covered_health_insurance_pct",
    "institutional_birth_5y_pct", "births_delivered_by_csection_5y_pct",
)


def district_context(
    districts: DataFrame, state: str, district: str | None = None, limit: int = 50
) -> DataFrame:
    """Indicators of a state's districts, least literate first; sorted before the cut."""
    rows = districts.filter(F.col("state") == state)
    if district:
        rows = rows.filter(F.col("district") == district)
    return (
        rows.select("district", "state", *DISTRICT_INDICATORS)
        .orderBy(F.col(DISTRICT_INDICATORS[0]).asc_nulls_last(), "district")
        .limit(limit)
    )


def lowest_k(rows: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).orderBy(value, *ties).limit(k)


def status_examples(
    trust: DataFrame, entities: DataFrame, capability: str, status: str, limit: int
) -> DataFrame:
    """Entities of one capability and status for inspection, best trust first."""
    wanted = trust.filter((F.col("capability") == capability) & (F.col("status") == status))
    return (
        wanted.join(entities.select("facility_id", "name", "state", "city"), "facility_id")
        .orderBy(F.col("trust_score").desc(), "facility_id")
        .limit(limit)
        .select(
            "facility_id", "name", "state", "city", "claim_count", "supporting_evidence_count",
            "contradicting_evidence_count", "trust_score", "status",
        )
    )


def map_points(entities: DataFrame) -> DataFrame:
    """Points inside the accepted coordinate range."""
    return entities.filter(in_bbox(F.col("latitude"), F.col("longitude"))).select(
        "facility_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )


def map_summary(entities: DataFrame) -> DataFrame:
    ok = in_bbox(F.col("latitude"), F.col("longitude"))
    return entities.agg(
        F.count_if(ok).alias("shown"),
        (F.count("latitude") - F.count_if(ok)).alias("hidden"),
    )

