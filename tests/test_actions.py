import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.operators.actions import (
    add_notes, latest_verdicts, planner_history, planner_work, record_verdicts, valid_notes, validate_actions,
)
from attesta.schemas import ANNOTATION, VERIFICATION
from attesta.streaming.verdicts import (
    append_judged, append_rejected, append_valid, current, judged_log, keep_latest, kept_latest,
)

T0 = dt.datetime(2024, 1, 1)


def _v(f, c, p, status, minute, seq, note=None):
    return (f, c, p, status, None, note, T0 + dt.timedelta(minutes=minute), seq)


ROWS = [
    _v("f", "c", "p", "verified", 0, 1), _v("f", "c", "p", "rejected", 5, 2, "x"), _v("f", "c", "p", "needs_info", 3, 3),
    _v("f", "d", "p", "verified", 7, 4), _v("f", "d", "p", "rejected", 7, 5),
    _v("f", "c", "q", "clicked", 9, 6), _v(None, "c", "p", "verified", 9, 7), _v("f", "c", "r", None, 9, 8),
]


def _latest(df):
    return {(r.facility_id, r.claim_id, r.planner_id): (r.status, r.notes) for r in latest_verdicts(df).collect()}


WANT = {("f", "c", "p"): ("rejected", "x"), ("f", "d", "p"): ("rejected", None)}


def test_latest_wins_in_any_order(spark):
    df = spark.createDataFrame(ROWS, VERIFICATION)
    assert _latest(df) == WANT
    assert _latest(df.repartition(5).orderBy(F.rand(3))) == WANT
    history = planner_history(latest_verdicts(df), "p").collect()
    assert [r.claim_id for r in history] == ["d", "c"]


def test_validation(spark):
    got = {r["check"]: r.violations for r in validate_actions(spark.createDataFrame(ROWS, VERIFICATION)).collect()}
    assert got == {
        "null_facility_id": 1, "null_claim_id": 0, "null_planner_id": 0, "null_status": 1,
        "status_outside_domain": 1, "repeated_key": 2,
    }


def test_notes(spark):
    rows = [("f", "p", "hello", T0, 1), ("f", "p", "  ", T0, 2), ("f", None, "x", T0, 3), ("f", "p", None, T0, 4)]
    assert valid_notes(spark.createDataFrame(rows, ANNOTATION)).count() == 1


def test_log_tables_upsert_by_appending(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS log_test")
    for row in ROWS:
        record_verdicts(spark.createDataFrame([row], VERIFICATION), "log_test.verifications")
    log = spark.table("log_test.verifications")
    assert log.count() == 5 and _latest(log) == WANT
    refused = spark.table("log_test.verifications_rejected")
    assert sorted((r.seq, r.broken) for r in refused.collect()) == [
        (6, ["status_outside_domain"]), (7, ["null_facility_id"]), (8, ["null_status"])
    ]
    unstamped = spark.createDataFrame([ROWS[0]], VERIFICATION).drop("created_at")
    record_verdicts(unstamped.withColumn("created_at", F.lit(None).cast("timestamp")), "log_test.stamped")
    assert spark.table("log_test.stamped").first().created_at is not None
    notes = [("f", "p", "old", T0, 1), ("f", "p", " ", T0, 2), ("g", "p", "new", T0 + dt.timedelta(1), 3)]
    add_notes(spark.createDataFrame(notes, ANNOTATION), "log_test.annotations")
    history = planner_history(spark.table("log_test.annotations"), "p")
    assert [r.note for r in history.collect()] == ["new", "old"]
    assert [r.broken for r in spark.table("log_test.annotations_rejected").collect()] == [["blank_note"]]
    work = planner_work(latest_verdicts(log), spark.table("log_test.annotations"), "p").collect()
    assert [(r.kind, r.note or r.status) for r in work] == [
        ("note", "new"), ("verdict", "rejected"), ("verdict", "x"), ("note", "old")
    ]


def test_stream_equals_batch_and_appends_once(spark, tmp_path):
    inbox, log, checkpoint = (str(tmp_path / n) for n in ("inbox", "log", "checkpoint"))
    for part in (ROWS[:3], ROWS[3:]):
        spark.createDataFrame(part, VERIFICATION).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(VERIFICATION).parquet(inbox)
        append_valid(stream, log, checkpoint).awaitTermination()
    assert spark.read.parquet(log).count() == 5
    rejects = append_rejected(spark.readStream.schema(VERIFICATION).parquet(inbox), f"{log}-no", f"{checkpoint}-no")
    rejects.awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"{log}-no").collect()) == [6, 7, 8]
    got = current(spark, log, spark.read.schema(VERIFICATION).parquet(inbox))
    assert {(r.facility_id, r.claim_id, r.planner_id): (r.status, r.notes) for r in got.collect()} == WANT


def _inbox(spark, path, rows):
    spark.createDataFrame(rows, VERIFICATION).coalesce(1).write.mode("append").parquet(path)


def _failing(stream, seq):
    """The stream with a row that cannot be read."""
    lost = F.when(F.col("seq") == seq, F.raise_error(F.lit("lost"))).otherwise(F.col("notes"))
    return stream.withColumn("notes", lost.cast("string"))


def test_one_stream_writes_log_and_rejects_once_also_after_a_failure(spark, tmp_path):
    inbox, path, checkpoint = (str(tmp_path / n) for n in ("inbox", "judged", "checkpoint"))
    read = lambda: spark.readStream.schema(VERIFICATION).option("maxFilesPerTrigger", 1).parquet(inbox)
    _inbox(spark, inbox, ROWS[:3])
    append_judged(read(), path, checkpoint).awaitTermination()
    _inbox(spark, inbox, ROWS[3:6])
    with pytest.raises(Exception, match="lost"):
        append_judged(_failing(read(), 6), path, checkpoint).awaitTermination()
    _inbox(spark, inbox, ROWS[6:])
    for _ in range(2):
        append_judged(read(), path, checkpoint).awaitTermination()
    judged = judged_log(spark, path, read())
    assert sorted((r.seq, r.refused) for r in judged.collect()) == [(i, i > 5) for i in range(1, 9)]
    assert {tuple(r.broken) for r in judged.filter("refused").collect()} == {
        ("status_outside_domain",), ("null_facility_id",), ("null_status",)}
    assert _latest(judged.filter("NOT refused").drop("broken", "refused")) == WANT


def test_state_equals_batch_with_late_rows_and_restarts(spark, tmp_path):
    """The newest verdicts come first, so all later files are late; one micro-batch fails and runs again."""
    inbox, path, checkpoint = (str(tmp_path / n) for n in ("inbox", "state", "checkpoint"))
    read = lambda: spark.readStream.schema(VERIFICATION).option("maxFilesPerTrigger", 1).parquet(inbox)
    spark.createDataFrame([], VERIFICATION).write.parquet(inbox)
    keep_latest(read(), path, checkpoint).awaitTermination()
    assert kept_latest(spark, path).count() == 0
    for rows in ([ROWS[1], ROWS[4]], [ROWS[0], ROWS[2], ROWS[1]]):
        _inbox(spark, inbox, rows)
        keep_latest(read(), path, checkpoint).awaitTermination()
    _inbox(spark, inbox, ROWS[3:])
    with pytest.raises(Exception, match="lost"):
        keep_latest(_failing(read(), 4), path, checkpoint).awaitTermination()
    keep_latest(read(), path, checkpoint).awaitTermination()
    assert {(r.facility_id, r.claim_id, r.planner_id): (r.status, r.notes) for r in kept_latest(spark, path).collect()} == WANT
