"""Claims and evidence from one pass over the text, written once and tagged by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.matching import quote
from ..packs import RulePack
from ..sources.tables import fresh_path
from .claims import QUOTE_LENGTH, claim_rows, keep_first_claim, with_claims
from .evidence import (
    SNIPPET_KEY_LENGTH, haystacks, hit_order, keep_first_evidence, polarity, row_primary, scan,
)

CLAIM, EVIDENCE = "claim", "evidence"


def found_facts(entities: DataFrame, pack: RulePack) -> DataFrame:
    """One row per found claim and per evidence hit; columns of the other kind are NULL.

    The entity's claims ride along with its texts as one more item, so one scan finds both.
    """
    base = with_claims(entities, pack, spans=True).withColumn(
        "claimed", row_primary(F.col("claims"), pack)
    )
    none = F.lit(None)
    claim_type = base.schema["claims"].dataType
    own = F.array(
        F.struct(
            F.lit("").alias("source_field"), none.cast("string").alias("text"), F.col("claims").alias("claims")
        )
    )
    texts = F.transform(
        haystacks(),
        lambda h: F.struct(
            h["source_field"].alias("source_field"), h["text"].alias("text"), none.cast(claim_type).alias("claims")
        ),
    )
    items = F.when(F.col("claimed").isNotNull(), F.concat(own, texts))
    per_item = base.select(
        "facility_id", "claimed", F.posexplode_outer(items).alias("hay_ord", "h")
    ).select("facility_id", "claimed", "hay_ord", "h.*").filter(
        F.col("claims").isNotNull() | F.col("text").isNotNull()
    )
    hit_type = "struct<rule_ord:int,claim_id:string,window:string>"
    as_claims = F.transform(
        "claims", lambda c: F.struct(c.alias("c"), none.cast(hit_type).alias("m"))
    )
    as_hits = F.transform(
        scan(F.col("text"), F.col("claimed"), pack),
        lambda m: F.struct(none.cast(claim_type.elementType).alias("c"), m.cast(hit_type).alias("m")),
    )
    facts = F.when(F.col("claims").isNotNull(), as_claims).otherwise(as_hits)
    per_fact = per_item.select(
        "facility_id", "hay_ord", "source_field", F.posexplode_outer(facts).alias("hit_ord", "f")
    ).filter(F.col("f").isNotNull())
    hit = F.col("f.m").isNotNull()
    tagged = per_fact.select(
        "facility_id", "source_field", "hay_ord", "hit_ord", F.col("f.c").alias("c"), F.col("f.m").alias("m"),
        F.when(hit, EVIDENCE).otherwise(CLAIM).alias("kind"),
    )
    window = F.col("m.window")
    evidence = F.struct(
        F.col("m.claim_id").alias("claim_id"), F.col("source_field").alias("source_field"),
        hit_order(F.col("hay_ord"), F.col("hit_ord")).alias("scan_ord"),
        polarity(window, pack).alias("polarity"), quote(window).alias("snippet"),
    )
    return tagged.select("kind", "facility_id", "c", F.when(F.col("m").isNotNull(), evidence).alias("e"))


def write_facts(entities: DataFrame, pack: RulePack) -> DataFrame:
    """The facts, written once, one folder per kind, and read back."""
    spark = entities.sparkSession
    found, path = found_facts(entities, pack), fresh_path(spark, "facts")
    found.write.partitionBy("kind").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def claims_of(facts: DataFrame, quote_length: int | None = QUOTE_LENGTH) -> DataFrame:
    """The claim table of written facts."""
    rows = facts.filter(F.col("kind") == CLAIM).select("facility_id", "c")
    return keep_first_claim(claim_rows(rows, quote_length))


def evidence_of(facts: DataFrame, key_length: int | None = SNIPPET_KEY_LENGTH) -> DataFrame:
    """The evidence table of written facts."""
    rows = facts.filter(F.col("kind") == EVIDENCE).select("facility_id", "e.*")
    return keep_first_evidence(rows, key_length)
