"""Reading and writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..config import Tables
from ..schemas import FIXTURE, SCENARIO
from ..session import shared_dir


def read_parquet(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A table as its files are split, or dealt over a number of partitions that the caller names.

    Dealing moves all columns once; it suits a small table in one file with costly work behind it.
    """
    df = spark.read.parquet(path)
    return df if partitions is None else df.repartition(partitions)


def describe_sources(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal, data_type, nullable) from the schemas alone; reads no data."""
    rows = [
        (name, f.name, i, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, ordinal int, data_type string, nullable boolean"
    )


def profile_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, row_count, filled_count) for every column.

    One aggregate pass per table; the widest intermediate is one row.
    """
    profiles = []
    for name, df in tables.items():
        filled = df.agg(
            F.count("*").alias("row_count"),
            F.array(
                *[
                    F.struct(
                        F.lit(f.name).alias("column_name"),
                        F.lit(f.dataType.simpleString()).alias("data_type"),
                        F.count(F.col(f"`{f.name}`")).alias("filled_count"),
                    )
                    for f in df.schema.fields
                ]
            ).alias("columns"),
        )
        profiles.append(
            filled.select(F.lit(name).alias("table_name"), "row_count", F.inline("columns"))
        )
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out


def sample_rows(df: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The first ``n`` rows by key, so that two runs show the same rows."""
    return df.orderBy(key).limit(n)


def recover_table(spark: SparkSession, name: str) -> None:
    """Finish or undo a rewrite that a failure has cut off; nothing to do otherwise.

    The old table is set aside only when the new one is complete, so where the name is missing and the old table stands
    aside, the new one takes the name, or the old one again if there is no new one.
    """
    after, before = f"{name}__next", f"{name}__old"
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(before):
        _rename(spark, after if spark.catalog.tableExists(after) else before, name)
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE IF EXISTS {before}")
    spark.sql(f"DROP TABLE IF EXISTS {after}")


def _rename(spark: SparkSession, name: str, to: str) -> None:
    spark.sql(f"ALTER TABLE {name} RENAME TO {'.'.join(to.split('.')[-2:])}")


def overwrite_table(df: DataFrame, name: str) -> DataFrame:
    """Idempotent full rewrite that may change the schema, read back from storage.

    The rows are written aside; when they are complete the old table steps aside, the new one takes the name, and the
    old one goes. A table may be rewritten from itself. A failure at any step loses nothing: the next
    rewrite, or ``recover_table``, first brings the name back.
    """
    spark = df.sparkSession
    after, before = f"{name}__next", f"{name}__old"
    recover_table(spark, name)
    df.write.saveAsTable(after)
    if spark.catalog.tableExists(name):
        _rename(spark, name, before)
    _rename(spark, after, name)
    spark.sql(f"DROP TABLE IF EXISTS {before}")
    return spark.table(name)


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate under the shared folder and read it back.

    The written copy outlives lost executors, so what follows never recomputes it. It is
    deleted when the session ends. Most of it is hashes and codes, which zstd makes smaller than the default codec.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write an intermediate in buckets of a key and read it back: joins on the key then move the other side only.

    There are as many buckets as shuffle partitions, each one sorted file. The files go when the session ends.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    out = df.repartition(n, key).write.option("path", fresh_path(spark, name)).option("compression", "zstd")
    out.bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses; it goes when the session ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def scratch_table(spark: SparkSession, like: DataFrame, name: str) -> str:
    """An empty table with the columns of ``like`` in a folder that goes when the session ends."""
    table = f"{name}_{uuid.uuid4().hex}"
    like.limit(0).write.option("path", fresh_path(spark, name)).saveAsTable(table)
    return table


def create_namespace(spark: SparkSession, names: Tables) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {names.catalog}.{names.schema}")


def query(
    spark: SparkSession, sql: str, params: dict | None = None, **tables: DataFrame
) -> DataFrame:
    """SQL with ``:name`` values, which never enter the text, and ``{name}`` tables."""
    return spark.sql(sql, args=params or {}, **tables)


def bronze_copy(spark: SparkSession, source: DataFrame, name: str) -> DataFrame:
    """The source as it is, rewritten in full."""
    return overwrite_table(source, name)


def _json_array(spark: SparkSession, path: str, schema: StructType, field: str | None) -> DataFrame:
    ddl = f"array<{schema.simpleString()}>"
    whole = spark.read.text(path, wholetext=True)
    body = F.get_json_object("value", f"$.{field}") if field else F.col("value")
    return whole.select(F.inline(F.from_json(body, ddl)))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Hand labels: a JSON file with a ``scenarios`` list."""
    return _json_array(spark, path, SCENARIO, "scenarios")


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Hand labels, one JSON object a line: files are read in splits, however many labels they hold.

    Fields that a line lacks are NULL; a line that is no object gives a row of NULLs.
    """
    return spark.read.schema(SCENARIO).json(path)


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Labelled facilities: a JSON object from facility id to its texts."""
    fields = [f for f in FIXTURE.fields if f.name != "facility_id"]
    ddl = f"map<string,{StructType(fields).simpleString()}>"
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", ddl)).alias("facility_id", "f"))
    return entries.select("facility_id", "f.*")
