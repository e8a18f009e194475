"""Where care is missing: verified coverage against burden, by district, state and country.

A district's gap for a capability is its burden times the share of its facilities that are not verified for it. Counts come
from grouping sets in one pass each, folded before the shuffle, so a district with a third of all facilities costs
a few rows per task. Score quantiles come from a mergeable sketch: with ``accuracy`` n its rank is off by at most
1/n of the group, so groups of up to n scores are exact. Places are ranked among those of their level; these windows hold one
row per place, never facilities.

Defined cases: a facility counts once, in the least of its places; a facility without a state or district has NULL as
its place, which is a place like others. Repeated scores of a pair count once, by the best status. Places without any claim of
a capability are listed with no verified facility. A place without a burden has no gap and no rank; above the districts the
burden is the mean of the districts that have one. Districts without facilities have a coverage of NULL and the full gap.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Grouping ids of the grouping sets below.
LEVELS = {0: "district", 1: "state", 3: "country"}
KEYS = ["level", "state", "district"]
STATUS_RANK = ("contradicted", "unclear", "verified")


def _rolled(rows: DataFrame, more: Sequence[str], *aggregates) -> DataFrame:
    """Aggregates by district, state and country, with the level's name."""
    sets = [[*more, "state", "district"], [*more, "state"], [*more]]
    rolled = rows.groupingSets(sets, *more, "state", "district").agg(F.grouping_id().alias("id"), *aggregates)
    level = F.coalesce(*[F.when(F.col("id") == i, F.lit(name)) for i, name in LEVELS.items()])
    return rolled.withColumn("level", level).drop("id")


def _same_place(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def district_gaps(
    trust: DataFrame, facilities: DataFrame, burdens: DataFrame, capabilities: Sequence[str], accuracy: int = 10_000
) -> DataFrame:
    """(level, state, district, capability, n_facilities, n_claiming, n_verified, median_score, coverage, burden, gap, gap_rank,
    gap_percent).

    ``trust`` has facility_id, capability, trust_score and status; ``facilities`` facility_id, state and district; ``burdens``
    state, district and burden, repeated rows of a district by their mean. ``gap_rank`` is 1 for the largest gap, and
    ``gap_percent`` 1 for it.
    """
    place = facilities.groupBy("facility_id").agg(F.min(F.struct("state", "district")).alias("place"))
    place = place.select("facility_id", "place.*")
    burden = burdens.groupBy("state", "district").agg(F.avg("burden").alias("burden"))

    # Only levels whose rows really are there: an empty table still has a total.
    totals = _rolled(place, (), F.count("*").alias("n_facilities")).filter("n_facilities > 0")
    means = _rolled(burden, (), F.avg("burden").alias("burden"), F.count("*").alias("n")).filter("n > 0").drop("n")
    places = totals.alias("t").join(means.alias("m"), _same_place(totals, means, KEYS), "full").select(
        *[F.coalesce(f"t.{k}", f"m.{k}").alias(k) for k in KEYS], F.coalesce("n_facilities", F.lit(0)).alias("n_facilities"),
        F.round("burden", 6).alias("burden"),
    )
    asked = places.withColumn("capability", F.explode(F.array(*map(F.lit, dict.fromkeys(capabilities)))))

    best = F.array(*map(F.lit, STATUS_RANK))
    scored = trust.groupBy("facility_id", "capability").agg(
        F.max(F.array_position(best, F.col("status"))).alias("rank"), F.max("trust_score").alias("score")
    )
    counts = _rolled(
        scored.join(place, "facility_id"), ("capability",), F.count("*").alias("n_claiming"),
        F.count_if(F.col("rank") == len(STATUS_RANK)).alias("n_verified"),
        F.percentile_approx("score", 0.5, accuracy).alias("median_score"),
    )
    keys = [*KEYS, "capability"]
    met = asked.alias("a").join(counts.alias("c"), _same_place(asked, counts, keys), "left").select(
        *[F.col(f"a.{k}") for k in keys], "n_facilities", F.coalesce("n_claiming", F.lit(0)).alias("n_claiming"),
        F.coalesce("n_verified", F.lit(0)).alias("n_verified"), "median_score", "burden",
    )
    coverage = F.when(F.col("n_facilities") > 0, F.col("n_verified") / F.col("n_facilities"))
    gapped = met.withColumn("coverage", F.round(coverage, 6)).withColumn(
        "gap", F.round(F.col("burden") * (1 - F.coalesce(coverage, F.lit(0.0))), 6)
    )
    known = F.col("gap").isNotNull()
    peers = Window.partitionBy("level", "capability", known)
    return gapped.select(
        *keys, "n_facilities", "n_claiming", "n_verified", "median_score", "coverage", "burden", "gap",
        F.when(known, F.rank().over(peers.orderBy(F.desc("gap"))).cast("long")).alias("gap_rank"),
        F.when(known, F.round(F.percent_rank().over(peers.orderBy("gap")), 6)).alias("gap_percent"),
    )
