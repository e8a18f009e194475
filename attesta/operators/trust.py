"""Trust per (entity, capability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scoring import status_label, trust_score
from ..functions.matching import quote
from ..packs import RulePack
from .claims import terms, with_claims
from .evidence import (
    SNIPPET_KEY_LENGTH, evidence_id, haystacks, hit_order, polarity, row_primary, scan,
)

_FACT = (
    "array<struct<rule_ord:int,claim_id:string,window:string,confidence:double>>"
)


def scored(counts: DataFrame) -> DataFrame:
    """Counts and top confidence per pair to the trust table."""
    s, c = F.col("supporting_evidence_count"), F.col("contradicting_evidence_count")
    score = trust_score(F.col("claim_count"), s, c, F.col("top_confidence"))
    return counts.withColumn("trust_score", score).select(
        "facility_id", "capability", "claim_count", s, c, "trust_score",
        status_label(F.col("trust_score"), s, c).alias("status"),
    )


def trust_from_tables(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Trust from written claim and evidence tables.

    Evidence is counted per claim id first, so the join meets at most one row per claim
    on either side, and a claim with a great many hits is folded before the shuffle.
    """
    per_claim = evidence.groupBy("facility_id", "claim_id").agg(
        F.count_if(F.col("polarity") == "supports").alias("s"),
        F.count_if(F.col("polarity") == "contradicts").alias("c"),
    )
    joined = claims.select("facility_id", "claim_id", "claim_value", "extraction_confidence").join(
        per_claim, ["facility_id", "claim_id"], "left"
    )
    return scored(
        joined.groupBy("facility_id", F.col("claim_value").alias("capability")).agg(
            F.count("*").alias("claim_count"),
            F.coalesce(F.sum("s"), F.lit(0)).alias("supporting_evidence_count"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("contradicting_evidence_count"),
            F.max("extraction_confidence").alias("top_confidence"),
        )
    )


def _claim_facts(claims: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(
        claims,
        lambda c: F.struct(c["rule_ord"], c["claim_id"], none, c["extraction_confidence"]),
    ).cast(_FACT)


def _evidence_facts(pack: RulePack) -> Column:
    none = F.lit(None).cast("double")
    hits = scan(F.col("text"), F.col("claimed"), pack)
    return F.transform(
        hits, lambda m: F.struct(m["rule_ord"], m["claim_id"], m["window"], none)
    ).cast(_FACT)


def trust_facts(
    entities: DataFrame, pack: RulePack, key_length: int | None = SNIPPET_KEY_LENGTH
) -> DataFrame:
    """One row per claim and per evidence hit, from a single pass over the text.

    A row that carries the entity's claims rides along with its texts, so claims and
    evidence need neither two scans nor a join. Only ids and numbers leave this stage.
    """
    items = "array<struct<source_field:string,text:string,claims:{}>>".format(_FACT)
    own = F.array(
        F.struct(
            F.lit("").alias("source_field"), F.lit(None).cast("string").alias("text"),
            _claim_facts(F.col("claims")).alias("claims"),
        )
    ).cast(items)
    texts = F.transform(
        haystacks(),
        lambda h: F.struct(
            h["source_field"].alias("source_field"), h["text"].alias("text"),
            F.lit(None).cast(_FACT).alias("claims"),
        ),
    ).cast(items)
    base = with_claims(entities, pack).withColumn(
        "claimed", row_primary(F.col("claims"), pack)
    )
    per_item = (
        base.select(
            "facility_id", "claimed",
            F.posexplode_outer(F.when(F.col("claimed").isNotNull(), F.concat(own, texts)))
            .alias("hay_ord", "h"),
        )
        .select("facility_id", "claimed", "hay_ord", "h.*")
        .filter(F.col("claims").isNotNull() | F.col("text").isNotNull())
    )
    facts = F.when(F.col("claims").isNotNull(), F.col("claims")).otherwise(_evidence_facts(pack))
    per_fact = (
        per_item.select("facility_id", "hay_ord", F.posexplode_outer(facts).alias("hit_ord", "f"))
        .filter(F.col("f").isNotNull())
        .select("facility_id", "hay_ord", "hit_ord", "f.*")
    )
    is_hit = F.col("window").isNotNull()
    denied = polarity(F.col("window"), pack) == "contradicts"
    return per_fact.select(
        "facility_id", F.get(terms(pack), F.col("rule_ord")).alias("capability"),
        "claim_id", "confidence",
        F.when(is_hit, evidence_id(F.col("claim_id"), quote(F.col("window")), key_length)).alias("evidence_id"),
        # scan position with the polarity in the lowest bit: the least value is the first hit
        F.when(
            is_hit, F.shiftleft(hit_order(F.col("hay_ord"), F.col("hit_ord")), 1) + denied.cast("int")
        ).alias("first_hit"),
    )


def gold_trust(
    entities: DataFrame, pack: RulePack, key_length: int | None = SNIPPET_KEY_LENGTH
) -> DataFrame:
    """Entities to the trust table in one lazy plan.

    The first aggregate removes repeated claim and evidence ids, the second counts
    them. Both fold on the map side, and the first is keyed by id rather than by
    entity, so one entity holding a large share of the rows is spread out.
    """
    distinct_facts = (
        trust_facts(entities, pack, key_length)
        .groupBy("facility_id", "capability", "claim_id", "evidence_id")
        .agg(F.max("confidence").alias("confidence"), F.min("first_hit").alias("first_hit"))
    )
    is_hit = F.col("evidence_id").isNotNull()
    denied = F.col("first_hit").bitwiseAND(F.lit(1)) == 1
    return scored(
        distinct_facts.groupBy("facility_id", "capability").agg(
            F.count_if(~is_hit).alias("claim_count"),
            F.count_if(is_hit & ~denied).alias("supporting_evidence_count"),
            F.count_if(is_hit & denied).alias("contradicting_evidence_count"),
            F.max("confidence").alias("top_confidence"),
        )
    )
