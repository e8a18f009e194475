"""Raw facility rows to cleaned facility rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cleaning import (
    blank_to_null, clean_category, in_bbox, normalize_name, parse_json_array, safe_int, text_bool,
)
from .reference import resolve_with_provenance

# Column order of the cleaned table.
SILVER_COLUMNS = (
    "facility_id", "name", "organization_type", "facility_type", "operator_type", "description",
    "specialties", "procedures", "equipment", "capabilities", "source_urls", "capacity",
    "year_established", "number_doctors", "state_raw", "district_raw", "state", "district",
    "state_source", "city", "pincode", "address_line1", "address_line2", "address_line3",
    "address_country", "address_country_code", "latitude", "longitude", "has_valid_coords",
    "recency_of_page_update", "social_media_presence_count", "has_affiliated_staff",
    "has_custom_logo", "facts_count", "official_phone", "email", "official_website",
    "source_content_id", "cluster_id",
)


def clean_facility(source: DataFrame) -> DataFrame:
    """Rename, trim, cast and parse; one narrow pass without a shuffle."""
    c = F.col
    return source.select(
        c("unique_id").alias("facility_id"),
        F.trim("name").alias("name"),
        clean_category(c("organization_type")).alias("organization_type"),
        clean_category(c("facilityTypeId")).alias("facility_type"),
        clean_category(c("operatorTypeId")).alias("operator_type"),
        "description",
        parse_json_array(c("specialties")).alias("specialties"),
        parse_json_array(c("procedure")).alias("procedures"),
        parse_json_array(c("equipment")).alias("equipment"),
        parse_json_array(c("capability")).alias("capabilities"),
        parse_json_array(c("source_urls")).alias("source_urls"),
        safe_int(c("capacity")).alias("capacity"),
        safe_int(c("yearEstablished")).alias("year_established"),
        safe_int(c("numberDoctors")).alias("number_doctors"),
        normalize_name(c("address_stateOrRegion")).alias("state_raw"),
        normalize_name(c("address_city")).alias("city"),
        blank_to_null(c("address_zipOrPostcode")).alias("pincode"),
        "address_line1", "address_line2", "address_line3", "address_country",
        c("address_countryCode").alias("address_country_code"),
        "latitude", "longitude",
        in_bbox(c("latitude"), c("longitude")).alias("has_valid_coords"),
        "recency_of_page_update",
        safe_int(c("distinct_social_media_presence_count")).alias("social_media_presence_count"),
        text_bool(c("affiliated_staff_presence")).alias("has_affiliated_staff"),
        text_bool(c("custom_logo_presence")).alias("has_custom_logo"),
        safe_int(c("number_of_facts_about_the_organization")).alias("facts_count"),
        c("officialPhone").alias("official_phone"),
        "email",
        c("officialWebsite").alias("official_website"),
        "source_content_id", "cluster_id",
    )


def build_facility(
    source: DataFrame, pincodes: DataFrame, canonical: DataFrame | None = None
) -> DataFrame:
    resolved = resolve_with_provenance(clean_facility(source), pincodes, canonical)
    return resolved.select(*SILVER_COLUMNS)
