"""Names of the tables that a build reads and writes."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Tables:
    """Source tables are read by full name, targets live in one namespace."""

    catalog: str = os.getenv("ATTESTA_CATALOG", "spark_catalog")
    schema: str = os.getenv("ATTESTA_SCHEMA", "attesta")

    source_facilities: str = "source_facilities"
    source_postcodes: str = "source_postcodes"
    source_districts: str = "source_districts"

    bronze_facility: str = "bronze_facility"
    silver_facility: str = "silver_facility"
    silver_pincode: str = "silver_pincode"
    silver_district_health: str = "silver_district_health"
    silver_claim: str = "silver_claim"
    silver_evidence: str = "silver_evidence"
    gold_facility_trust: str = "gold_facility_trust"
    verifications: str = "verifications"
    annotations: str = "annotations"
    model_answers: str = "model_answers"

    def fq(self, table: str) -> str:
        return f"{self.catalog}.{self.schema}.{table}"
