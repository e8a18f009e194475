"""Versioned snapshots: an append-only log of changes, read as of a time, and the flips between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import append_table, materialise

TRUST_KEY = ("facility_id", "capability")
TRUST_VALUES = ("status", "trust_score")
# From better to worse: a flip to the right is an alert of the higher kind.
ORDER = ("verified", "unclear", "contradicted")


def snapshot_diff(before: DataFrame, after: DataFrame, key: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """(key, old struct, new struct, change) of all rows that appeared, vanished or changed, by a full outer join.

    NULL values are values; keys are unique and not NULL (a row with a NULL in its key is taken as a row apart
    and neither appears nor vanishes twice: NULL keys match each other).
    """
    old = before.select(*[F.col(k).alias(f"o_{k}") for k in key], F.struct(*values).alias("old"))
    new = after.select(*[F.col(k).alias(f"n_{k}") for k in key], F.struct(*values).alias("new"))
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in key]
    change = (
        F.when(F.col("old").isNull(), "appeared").when(F.col("new").isNull(), "vanished")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    both = old.join(new, on, "full").withColumn("change", change).filter("change IS NOT NULL")
    return both.select(*[F.coalesce(f"n_{k}", f"o_{k}").alias(k) for k in key], "old", "new", "change")


def as_of(log: DataFrame, at, key: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """The rows that were valid at a time, from the log of changes; a maximum per key folds before the shuffle."""
    newest = F.max_by(F.struct("change", "value"), "valid_from").alias("n")
    return (
        log.filter(F.col("valid_from") <= F.lit(at))
        .groupBy(*key)
        .agg(newest)
        .filter("n.change != 'vanished'")
        .select(*key, *[F.col(f"n.value.{v}").alias(v) for v in values])
    )


def intervals(log: DataFrame, key: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """(key, values, valid_from, valid_to): when each version of a row held; an open end is NULL."""
    changes = F.sort_array(F.collect_list(F.struct("valid_from", "change", "value")))
    versions = log.groupBy(*key).agg(changes.alias("c"))
    closed = F.transform(
        "c",
        lambda x, i: F.struct(
            x["valid_from"].alias("valid_from"), F.get("c", i + 1)["valid_from"].alias("valid_to"),
            x["change"].alias("change"), x["value"].alias("value"),
        ),
    )
    rows = versions.select(*key, F.inline(closed)).filter("change != 'vanished'")
    return rows.select(*key, *[F.col(f"value.{v}").alias(v) for v in values], "valid_from", "valid_to")


def _log_rows(diff: DataFrame, at: Column, key: tuple[str, ...]) -> DataFrame:
    value = F.coalesce("new", "old").alias("value")
    return diff.select(*key, "change", value, at.alias("valid_from"))


def load_snapshot(
    spark: SparkSession, log_table: str, snapshot: DataFrame, at,
    key: tuple[str, ...] = TRUST_KEY, values: tuple[str, ...] = TRUST_VALUES,
) -> None:
    """Add a snapshot taken at a time to the log: only what differs from the snapshot before is appended.

    One append, so a failure leaves the log as it was, and a load repeated, at once or after later failures, changes nothing.
    Snapshots come in the order of their times: one from before the last change of the log is refused.
    Keys are unique within a snapshot. The log is made by the first load. Further columns are ignored.
    """
    moment = F.lit(at).cast("timestamp")
    narrow = snapshot.select(*key, *values)
    if not spark.catalog.tableExists(log_table):
        diff = snapshot_diff(narrow.limit(0), narrow, key, values)
    else:
        log = spark.table(log_table)
        last = log.agg(F.max("valid_from").alias("last")).filter(F.col("last") > moment)
        if not last.isEmpty():
            raise ValueError(f"the log has changes from after {at}")
        diff = snapshot_diff(as_of(log, moment, key, values), narrow, key, values)
    changes = materialise(_log_rows(diff, moment, key), "changes")
    if not spark.catalog.tableExists(log_table) or not changes.isEmpty():
        append_table(changes, log_table)


def flips(before: DataFrame, after: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Alerts between two trust snapshots, one per pair that appeared, vanished or changed its status.

    (facility_id, capability, change, old_status, new_status, old_score, new_score, alert); ``alert`` is ``worse``,
    ``better``, ``new`` or ``gone``. Pairs whose score alone moved are no alert.
    """
    diff = snapshot_diff(before, after, TRUST_KEY, TRUST_VALUES)
    rank = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    alert = (
        F.when(F.col("change") == "appeared", "new").when(F.col("change") == "vanished", "gone")
        .when(rank("new.status") > rank("old.status"), "worse").otherwise("better")
    )
    moved = (F.col("change") != "changed") | ~F.col("old.status").eqNullSafe(F.col("new.status"))
    return diff.filter(moved).select(
        *TRUST_KEY, "change", F.col("old.status").alias("old_status"), F.col("new.status").alias("new_status"),
        F.col("old.trust_score").alias("old_score"), F.col("new.trust_score").alias("new_score"), alert.alias("alert"),
    )
