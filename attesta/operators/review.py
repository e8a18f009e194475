"""The queue of claims that wait for a reviewer: leases by running sums of capacity over priority.

Waiting claims are numbered by priority, the free places of all reviewers are numbered in turns, and a claim
goes to the place with its number. So nobody gets more than their capacity, no claim goes out twice, and two runs over
the same rows give the same leases. A lease holds its claim and a place until it expires or the claim is decided; then the
claim waits again and the place is free. Both numberings are exact and spread over tasks.

Defined cases: a claim without an id or capability cannot be leased and is left out; of repeated rows of
a claim the least score counts; a claim without a score comes first. Reviewers without a name, capacity or lease time get
nothing; of repeated rows of a reviewer the largest capacity and the longest lease count. A lease without an end never holds.
Empty tables give no leases. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import materialise

KEYS = ["facility_id", "capability"]
# The place of a row in its task, below the number of the task, in a monotonically increasing id.
TASK_SHIFT = 33


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with their place in the order, from 1, in ``position``; runs the sort.

    Rows are sorted over all tasks and written. Only the numbers of rows of the tasks, one row a task, are summed in one task.
    """
    sorted_rows = rows.orderBy(*order).withColumn("position", F.monotonically_increasing_id())
    written = materialise(sorted_rows, "positions").withColumn("task", F.shiftright("position", TASK_SHIFT))
    place = F.col("position").bitwiseAND(F.lit((1 << TASK_SHIFT) - 1))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written.groupBy("task").agg(F.count("*").alias("n")).select(
        "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    return written.join(F.broadcast(counts), "task").withColumn("position", F.col("before") + place + 1).drop("task", "before")


def open_claims(pairs: DataFrame, verdicts: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(facility_id, capability, trust_score) of the scored pairs without a verdict; ``on`` says what a verdict decides."""
    named = pairs.filter(F.col("facility_id").isNotNull() & F.col("capability").isNotNull())
    # A claim without a score would be lost in a minimum beside rows with one.
    least = F.when(F.count("trust_score") == F.count("*"), F.min("trust_score"))
    scored = named.groupBy(KEYS).agg(least.alias("trust_score"))
    on = on or KEYS
    return scored.join(verdicts.select(*on).distinct(), on, "left_anti")


def live_leases(leases: DataFrame, waiting: DataFrame, at: Column) -> DataFrame:
    """The leases that hold at a time: not expired, and their claim is still open."""
    return leases.filter(F.col("expires_at") > at).join(waiting.select(KEYS), KEYS, "left_semi")


def free_places(reviewers: DataFrame, live: DataFrame) -> DataFrame:
    """(planner_id, lease_days, turn): one row for each claim that a reviewer can still take."""
    held = live.groupBy("planner_id").agg(F.count("*").alias("held"))
    known = reviewers.filter("planner_id IS NOT NULL AND capacity > 0 AND lease_days > 0").groupBy("planner_id").agg(
        F.max("capacity").cast("long").alias("capacity"), F.max("lease_days").cast("int").alias("lease_days")
    )
    free = known.join(held, "planner_id", "left").withColumn("free", F.col("capacity") - F.coalesce("held", F.lit(0)))
    turns = F.explode(F.sequence(F.lit(1).cast("long"), F.col("free"))).alias("turn")
    return free.filter("free > 0").select("planner_id", "lease_days", turns)


def lease_claims(waiting: DataFrame, reviewers: DataFrame, leases: DataFrame, at: Column) -> DataFrame:
    """New leases (facility_id, capability, trust_score, planner_id, position, leased_at, expires_at) at a time.

    Runs two sorts. Places are dealt in turns: everybody's first place comes before anybody's second.
    """
    live = live_leases(leases, waiting, at)
    queue = positions(waiting.join(live.select(KEYS), KEYS, "left_anti"), "trust_score", *KEYS)
    places = positions(free_places(reviewers, live), "turn", "planner_id").drop("turn")
    return queue.join(places, "position").select(
        *KEYS, "trust_score", "planner_id", "position", at.alias("leased_at"),
        (at + F.make_dt_interval(days=F.col("lease_days"))).alias("expires_at"),
    )


def no_leases(waiting: DataFrame) -> DataFrame:
    """An empty table of leases."""
    text, time = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    return waiting.limit(0).select(
        *KEYS, "trust_score", text.alias("planner_id"), F.lit(None).cast("long").alias("position"),
        time.alias("leased_at"), time.alias("expires_at"),
    )


def lease_rounds(waiting: DataFrame, reviewers: DataFrame, times: list[str]) -> DataFrame:
    """The leases of several rounds, one at each time; each is written before the next one reads it."""
    waiting = materialise(waiting, "open-claims")
    log = no_leases(waiting)
    for time in times:
        new = lease_claims(waiting, reviewers, log, F.lit(time).cast("timestamp_ntz"))
        log = log.unionByName(materialise(new, "leases"))
    return log
