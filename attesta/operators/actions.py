"""Reviewer verdicts and notes as an append-only log with a latest-wins view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import append_table, materialise

VERDICTS = ("verified", "rejected", "needs_info")
VERDICT_KEY = ("facility_id", "claim_id", "planner_id")
NOTE_REQUIRED = ("facility_id", "planner_id", "note")
UPDATED = ("status", "reason", "notes")


def _broken(checks: dict[str, Column]) -> Column:
    """The names of the constraints that a row breaks; an undecided check counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    )


def verdict_checks() -> dict[str, Column]:
    present = {f"null_{c}": F.col(c).isNotNull() for c in (*VERDICT_KEY, "status")}
    domain = F.col("status").isNull() | F.col("status").isin(*VERDICTS)
    return {**present, "status_outside_domain": domain}


def note_checks() -> dict[str, Column]:
    present = {f"null_{c}": F.col(c).isNotNull() for c in NOTE_REQUIRED}
    return {**present, "blank_note": F.col("note").isNull() | (F.trim("note") != "")}


def checked(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows with ``broken``, the constraints that each of them breaks; empty for a good row."""
    return rows.withColumn("broken", _broken(checks))


def accepted(checked_rows: DataFrame) -> DataFrame:
    return checked_rows.filter(F.size("broken") == 0).drop("broken")


def rejected(checked_rows: DataFrame) -> DataFrame:
    """The rows that break a constraint, with the names of those they break."""
    return checked_rows.filter(F.size("broken") > 0)


def valid_verdicts(log: DataFrame) -> DataFrame:
    """Rows that meet the constraints: keys and status present, status in the domain."""
    return accepted(checked(log, verdict_checks()))


def stamped(rows: DataFrame) -> DataFrame:
    """The rows with the time of writing wherever they bring none."""
    now = F.current_timestamp()
    if "created_at" not in rows.columns:
        return rows.withColumn("created_at", now)
    kind = rows.schema["created_at"].dataType
    return rows.withColumn("created_at", F.coalesce("created_at", now.cast(kind)))


def latest_verdicts(log: DataFrame) -> DataFrame:
    """The newest valid verdict per (facility, claim, planner); ties by sequence.

    A maximum folds before the shuffle, so one busy key costs one row per task.
    """
    newest = F.max(F.struct("created_at", "seq", *UPDATED))
    return (
        valid_verdicts(log)
        .groupBy(*VERDICT_KEY)
        .agg(newest.alias("n"))
        .select(*VERDICT_KEY, *[f"n.{c}" for c in (*UPDATED, "created_at", "seq")])
    )


def validate_actions(log: DataFrame) -> DataFrame:
    """(check, violations): rows that break a constraint, and keys that occur again."""
    checks = {f"null_{c}": F.col(c).isNull() for c in (*VERDICT_KEY, "status")}
    checks["status_outside_domain"] = ~F.col("status").isin(*VERDICTS)
    entry = lambda name, n: F.struct(F.lit(name).alias("check"), n.alias("violations"))
    broken = log.agg(
        F.array(*[entry(name, F.count_if(broke)) for name, broke in checks.items()]).alias("r")
    )
    repeated = valid_verdicts(log).groupBy(*VERDICT_KEY).count().agg(
        F.array(entry("repeated_key", F.count_if(F.col("count") > 1))).alias("r")
    )
    return broken.unionByName(repeated).select(F.inline("r"))


def valid_notes(log: DataFrame) -> DataFrame:
    return accepted(checked(log, note_checks()))


def _record(rows: DataFrame, checks: dict[str, Column], log_table: str, reject_table: str | None) -> None:
    """Append good rows, stamped, to the log and the others, with what they break, to the reject table.

    Nothing is lost: the judged rows are written once, and both appends read what was written, so a row is in one of the
    two even if the input changes meanwhile.
    """
    judged = materialise(checked(rows, checks), "judged")
    append_table(stamped(accepted(judged)), log_table)
    append_table(
        rejected(judged).withColumn("rejected_at", F.current_timestamp()),
        reject_table or f"{log_table}_rejected",
    )


def record_verdicts(verdicts: DataFrame, log_table: str, reject_table: str | None = None) -> None:
    """Append verdicts; the latest-wins view makes a repeated key an update.

    Rows that break a constraint go to ``reject_table``, by default ``<log_table>_rejected``.
    """
    _record(verdicts, verdict_checks(), log_table, reject_table)


def add_notes(notes: DataFrame, log_table: str, reject_table: str | None = None) -> None:
    _record(notes, note_checks(), log_table, reject_table)


def planner_history(rows: DataFrame, planner_id: str) -> DataFrame:
    """One reviewer's rows of one log, newest first."""
    return rows.filter(F.col("planner_id") == planner_id).orderBy(
        F.col("created_at").desc(), F.col("seq").desc()
    )


def planner_work(verdicts: DataFrame, notes: DataFrame, planner_id: str) -> DataFrame:
    """One reviewer's verdicts and notes together, newest first."""
    none = F.lit(None).cast("string")
    shared = ("planner_id", "facility_id")
    told = verdicts.select(
        F.lit("verdict").alias("kind"), *shared, "claim_id", "status", "reason",
        F.col("notes").alias("note"), "created_at", "seq",
    )
    noted = notes.select(
        F.lit("note").alias("kind"), *shared, none.alias("claim_id"), none.alias("status"),
        none.alias("reason"), "note", "created_at", "seq",
    )
    return planner_history(told.unionByName(noted), planner_id)
