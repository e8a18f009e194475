"""The verdict log as a stream: valid rows are appended once, the newest one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..operators.actions import (
    UPDATED, VERDICT_KEY, accepted, checked, latest_verdicts, rejected, stamped, valid_verdicts, verdict_checks,
)
from ..sources.tables import fresh_path


def _append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_valid(stream: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append each valid verdict to the log exactly once, stamped; stops when the input is read.

    The same log and checkpoint given again, it goes on where it stopped.
    """
    return _append(stamped(accepted(checked(stream, verdict_checks()))), log_path, checkpoint)


def append_rejected(stream: DataFrame, reject_path: str, checkpoint: str) -> StreamingQuery:
    """Append each verdict that breaks a constraint, with what it breaks, exactly once."""
    return _append(rejected(checked(stream, verdict_checks())), reject_path, checkpoint)


def current(spark: SparkSession, log_path: str, like: DataFrame) -> DataFrame:
    """Latest verdicts of the log written so far."""
    return latest_verdicts(spark.read.schema(like.schema).parquet(log_path))


def latest_from_stream(
    stream: DataFrame, log_path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Drain a stream into a log and return its latest verdicts.

    With a log and a checkpoint of earlier calls only what is new is read; without, both are made anew.
    """
    spark = stream.sparkSession
    log_path = log_path or fresh_path(spark, "verdict-log")
    checkpoint = checkpoint or fresh_path(spark, "verdict-checkpoint")
    append_valid(stream, log_path, checkpoint).awaitTermination()
    return current(spark, log_path, stream)


def append_judged(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every verdict exactly once with the constraints that it breaks: log and rejects in one stream.

    ``refused`` parts the files, so reading one kind opens no file of the other. One sink commits both kinds of a
    micro-batch at once, so a failure or a restart loses neither and repeats neither.
    """
    judged = checked(stamped(stream), verdict_checks())
    return (
        judged.withColumn("refused", F.size("broken") > 0)
        .writeStream.format("parquet")
        .partitionBy("refused")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def judged_log(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What ``append_judged`` has written: the stream's columns, ``broken`` and ``refused``."""
    added = [StructField("broken", ArrayType(StringType())), StructField("refused", BooleanType())]
    return spark.read.schema(StructType([*like.schema.fields, *added])).parquet(path)


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest valid verdict of every key as state; each micro-batch writes the keys that it changed.

    State holds one row per key, and late or repeated rows leave the maximum as it has to be, so there is no
    watermark: it would drop late verdicts that the batch view keeps. A micro-batch writes a folder of its own and
    replaces it when it runs again after a failure. A stream without rows leaves an empty table.
    """
    newest = (
        valid_verdicts(stream).groupBy(*VERDICT_KEY).agg(F.max(F.struct("created_at", "seq", *UPDATED)).alias("n"))
    )
    spark = stream.sparkSession
    spark.createDataFrame([], newest.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        newest.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def kept_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest verdicts of the state written so far, as ``latest_verdicts`` gives them."""
    newest = spark.read.parquet(path).groupBy(*VERDICT_KEY).agg(F.max("n").alias("n"))
    return newest.select(*VERDICT_KEY, *[f"n.{c}" for c in (*UPDATED, "created_at", "seq")])
