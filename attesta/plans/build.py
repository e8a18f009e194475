"""The build: source tables to bronze, silver, claims, evidence and trust tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Tables
from ..operators.entity import build_facility
from ..operators.evidence import find_evidence_for
from ..operators.facts import claims_of, evidence_of, write_facts
from ..operators.inference import classify_with_model
from ..operators.reference import build_district_health, build_pincode
from ..operators.trust import trust_from_tables
from ..packs import CARE_PACK, RulePack
from ..sources.tables import bronze_copy, create_namespace, overwrite_table


def run_bronze(spark: SparkSession, names: Tables) -> DataFrame:
    return bronze_copy(
        spark, spark.table(names.source_facilities), names.fq(names.bronze_facility)
    )


def run_silver(spark: SparkSession, names: Tables) -> DataFrame:
    """Postcodes first: facilities are resolved against them."""
    pincodes = overwrite_table(
        build_pincode(spark.table(names.source_postcodes)), names.fq(names.silver_pincode)
    )
    overwrite_table(
        build_district_health(spark.table(names.source_districts)),
        names.fq(names.silver_district_health),
    )
    return overwrite_table(
        build_facility(spark.table(names.fq(names.bronze_facility)), pincodes),
        names.fq(names.silver_facility),
    )


def run_trust(
    spark: SparkSession,
    names: Tables,
    pack: RulePack = CARE_PACK,
    model: Callable[[list[str]], list[str | None]] | None = None,
    model_name: str = "model",
) -> DataFrame:
    """Claims and evidence are written, and trust is counted from the written tables.

    Without a model one pass over the text finds claims and evidence. With one, claims come first,
    as a model's claims decide what evidence is looked for; its answers are kept in the cache table,
    so a second run asks only for what is new or failed.
    """
    entities = spark.table(names.fq(names.silver_facility))
    facts = write_facts(entities, pack) if model is None else None
    found = (
        classify_with_model(
            entities, pack, model, cache_table=names.fq(names.model_answers), model_name=model_name
        )
        if facts is None
        else claims_of(facts)
    )
    claims = overwrite_table(
        found.withColumn("extracted_at", F.current_timestamp()), names.fq(names.silver_claim)
    )
    snippets = find_evidence_for(entities, claims, pack) if facts is None else evidence_of(facts)
    evidence = overwrite_table(snippets, names.fq(names.silver_evidence))
    return overwrite_table(
        trust_from_tables(claims, evidence).withColumn("last_computed_at", F.current_timestamp()),
        names.fq(names.gold_facility_trust),
    )


def run_all(spark: SparkSession, names: Tables | None = None, pack: RulePack = CARE_PACK) -> DataFrame:
    names = names or Tables()
    create_namespace(spark, names)
    run_bronze(spark, names)
    run_silver(spark, names)
    return run_trust(spark, names, pack)
