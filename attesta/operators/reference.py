"""Reference data: one row per key, and lookups with recorded provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import figure_low_sample, figure_value, normalize_name, sentinel_double, title
from ..packs import CANONICAL_STATES

# Office kinds from most to least preferred.
OFFICE_PRIORITY = ("HO", "PO", "BO")


def priority_rank(kind: Column, order: tuple[str, ...]) -> Column:
    """1-based place of a kind in ``order``; anything else ranks after all of them."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.upper(kind))
    return F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(len(order) + 1)


def dedupe_by_priority(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One whole row per key: the least by ``order``, then by every other column.

    A minimum folds on the map side, so a key with a large share of the rows sends one
    row per task through the shuffle where a ranking window would sort all of them in
    one place.
    """
    rest = [c for c in rows.columns if c != key]
    ranked = F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row")
    )
    return rows.groupBy(key).agg(F.min(ranked).alias("m")).select(key, "m.row.*")


def build_pincode(source: DataFrame) -> DataFrame:
    """Postcode directory, one row per postcode: office kind, then coordinates, then name."""
    has_coords = F.col("latitude").isNotNull() & (F.col("latitude") != "NA")
    chosen = dedupe_by_priority(
        source.select(
            "pincode", "officename", "officetype", "district", "statename", "latitude", "longitude"
        ),
        "pincode",
        [
            priority_rank(F.col("officetype"), OFFICE_PRIORITY),
            F.when(has_coords, 0).otherwise(1),
            F.col("officename"),
        ],
    )
    return chosen.select(
        F.col("pincode").cast("string").alias("pincode"),
        "officename",
        "officetype",
        title(F.col("district")).alias("district"),
        title(F.col("statename")).alias("statename"),
        sentinel_double(F.col("latitude")).alias("latitude"),
        sentinel_double(F.col("longitude")).alias("longitude"),
    )


def build_district_health(source: DataFrame) -> DataFrame:
    """Normalised district and state in front of the unchanged source columns."""
    return source.select(
        normalize_name(F.col("district_name")).alias("district"),
        normalize_name(F.col("state_ut")).alias("state"),
        "*",
    )


def with_lookup(rows: DataFrame, directory: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left lookup on a unique key.

    Rows without a key cannot match; each gets a key of its own, so that they do not
    all meet in one task. No broadcast is forced: the planner takes one when it measures
    the directory small enough, and splits a key with very many rows otherwise.
    """
    own = F.concat(F.lit("\x00"), F.col(row_id))
    keyed = rows.withColumn("_key", F.coalesce(F.col(key), own))
    return keyed.join(directory.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def resolve_with_provenance(
    entities: DataFrame, pincodes: DataFrame, canonical: DataFrame | None = None
) -> DataFrame:
    """Add state, district and where the state came from.

    The postcode wins; else the raw state if it is a canonical name; else nothing.
    ``canonical`` replaces the fixed list by a table with one ``state`` column.
    """
    directory = pincodes.select(
        "pincode",
        F.col("statename").alias("pincode_state"),
        F.col("district").alias("pincode_district"),
    )
    looked_up = with_lookup(entities, directory, "pincode", "facility_id")
    if canonical is None:
        known = F.col("state_raw").isin(*CANONICAL_STATES)
    else:
        names = canonical.select(F.col("state").alias("state_raw")).distinct()
        known_names = names.withColumn("known_state", F.col("state_raw"))
        looked_up = with_lookup(looked_up, known_names, "state_raw", "facility_id")
        known = F.col("known_state").isNotNull()
    return (
        looked_up.withColumn("district_raw", F.col("pincode_district"))
        .withColumn("state", F.coalesce(F.col("pincode_state"), F.when(known, F.col("state_raw"))))
        .withColumn("district", F.col("pincode_district"))
        .withColumn(
            "state_source",
            F.when(F.col("pincode_state").isNotNull(), F.lit("pincode"))
            .when(known, F.lit("source"))
            .otherwise(F.lit("unresolved")),
        )
        .drop("pincode_state", "pincode_district", "known_state")
    )


def attach_district(entities: DataFrame, pincodes: DataFrame) -> DataFrame:
    """Fallback: keep a known state, else the postcode's; district by postcode."""
    p = pincodes.select("pincode", "statename", "district")
    rows = entities.select("facility_id", "state", "pincode")
    return with_lookup(rows, p, "pincode", "facility_id").select(
        "facility_id",
        F.coalesce("state", "statename").alias("state_resolved"),
        F.col("district").alias("district_resolved"),
        F.lit("pincode").alias("district_source"),
    )


def typed_indicators(districts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Published figures as numbers under their names, each with a flag for few cases in ``<name>_low_sample``."""
    typed = {c: figure_value(F.col(c)) for c in columns}
    flags = {f"{c}_low_sample": figure_low_sample(F.col(c)) for c in columns}
    return districts.select(
        *[typed[c].alias(c) if c in typed else F.col(c) for c in districts.columns], *[x.alias(n) for n, x in flags.items()]
    )
