"""One fixed schema per table; nothing is inferred from the rows."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
_TEXTS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FACILITY_SOURCE = _struct(
    unique_id=_S, name=_S, description=_S, organization_type=_S, facilityTypeId=_S, operatorTypeId=_S,
    specialties=_S, procedure=_S, equipment=_S, capability=_S, source_urls=_S,
    capacity=_S, yearEstablished=_S, numberDoctors=_S,
    address_line1=_S, address_line2=_S, address_line3=_S, address_city=_S, address_stateOrRegion=_S,
    address_zipOrPostcode=_S, address_country=_S, address_countryCode=_S,
    latitude=_D, longitude=_D, recency_of_page_update=_S,
    distinct_social_media_presence_count=_S, affiliated_staff_presence=_S, custom_logo_presence=_S,
    number_of_facts_about_the_organization=_S, officialPhone=_S, email=_S, officialWebsite=_S,
    source_content_id=_S, cluster_id=_S,
)

POSTCODE_SOURCE = _struct(
    circlename=_S, regionname=_S, divisionname=_S, officename=_S, pincode=_L, officetype=_S,
    delivery=_S, district=_S, statename=_S, latitude=_S, longitude=_S,
)

PINCODE = _struct(
    pincode=_S, officename=_S, officetype=_S, district=_S, statename=_S, latitude=_D, longitude=_D,
)

CLAIM = _struct(
    facility_id=_S, claim_id=_S, claim_type=_S, claim_value=_S, claim_raw=_S, source_field=_S,
    source_text_span=_S, extraction_confidence=_D, extraction_method=_S, llm_model=_S, claim_ord=_L,
)

EVIDENCE = _struct(
    facility_id=_S, evidence_id=_S, claim_id=_S, snippet=_S, source_field=_S, polarity=_S,
    retrieval_score=_D,
)

TRUST = _struct(
    facility_id=_S, capability=_S, claim_count=_L, supporting_evidence_count=_L,
    contradicting_evidence_count=_L, trust_score=_D, status=_S,
)

SCENARIO = _struct(
    id=_I, stratum=_S, facility_id=_S, name=_S, claim_type=_S, claim_value=_S, expected_status=_S,
    rationale=_S, source_quote=_S,
)

FIXTURE = _struct(
    facility_id=_S, capabilities=_TEXTS, procedures=_TEXTS, equipment=_TEXTS, specialties=_TEXTS,
    description=_S,
)

VERIFICATION = _struct(
    facility_id=_S, claim_id=_S, planner_id=_S, status=_S, reason=_S, notes=_S,
    created_at=T.TimestampType(), seq=_L,
)

ANNOTATION = _struct(facility_id=_S, planner_id=_S, note=_S, created_at=T.TimestampType(), seq=_L)

MODEL_RESPONSE = _struct(prompt_key=_S, response=_S, error=_S)

MODEL_CACHE = _struct(prompt_key=_S, response=_S)

MODEL_FAILURE = _struct(prompt_key=_S, error=_S, asked_at=T.TimestampType())
