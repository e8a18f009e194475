"""The text of an entity as ordered elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Claim emission order; prose never yields a claim.
CLAIM_FIELDS = ("capabilities", "specialties", "procedures", "equipment")
TEXT_FIELDS = ("capabilities", "procedures", "equipment")
CLAIM_TYPE = {
    "capabilities": "capability",
    "specialties": "specialty",
    "procedures": "procedure",
    "equipment": "equipment",
}

_ELEMENTS = "array<struct<source_field:string,field_ord:int,elem_ord:int,text:string>>"


def field_elements(field: str, field_ord: int) -> Column:
    """One array column as element structs; positions are those of the source array."""
    return F.transform(
        F.coalesce(F.col(field), F.array().cast("array<string>")),
        lambda t, i: F.struct(
            F.lit(field).alias("source_field"),
            F.lit(field_ord).alias("field_ord"),
            i.cast("int").alias("elem_ord"),
            t.alias("text"),
        ),
    ).cast(_ELEMENTS)


def non_empty(elements: Column) -> Column:
    return F.filter(elements, lambda e: e["text"].isNotNull() & (e["text"] != ""))


def explode_elements(entities: DataFrame) -> DataFrame:
    """(facility_id, source_field, field_ord, elem_ord, element), empty elements skipped."""
    fields = [field_elements(f, i) for i, f in enumerate(CLAIM_FIELDS)]
    return (
        entities.select("facility_id", F.explode_outer(F.concat(*fields)).alias("e"))
        .filter(F.col("e.text").isNotNull() & (F.col("e.text") != ""))
        .select(
            "facility_id", "e.source_field", "e.field_ord", "e.elem_ord",
            F.col("e.text").alias("element"),
        )
    )
