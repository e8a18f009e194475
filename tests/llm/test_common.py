import pytest
from pyspark.sql import functions as F

from attesta.llm.common import RESERVED, ROW, numbered, sheltered, texts
from attesta.llm.decontaminate import drop_contaminated, leaks
from attesta.llm.line_dedup import drop_repeated_lines
from attesta.llm.packing import pack_documents
from attesta.llm.simhash import keep_one

from .conftest import edge_texts


def keys(df):
    return sorted((r[ROW], r["text"]) for r in texts(numbered(df), "doc_id", "text", ROW).collect())


def test_row_keys_do_not_depend_on_splits(spark, docs_of):
    docs = docs_of(edge_texts() * 3, clashing=True)
    path = docs.inputFiles()[0].rsplit("/", 1)[0]
    whole = keys(docs)
    assert len({k for k, _ in whole}) == docs.count() == len(whole)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    small = keys(spark.read.parquet(path))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = spark.read.parquet(path)
        assert split.rdd.getNumPartitions() > 1 and small == whole
        assert keys(split) == whole
        some = keys(split.filter("doc_id > 3"))
        assert some and set(some) < set(whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_that_are_no_files_are_written_first(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "concat('t', id) AS text").repartition(5)
    assert len({k for k, _ in keys(df)}) == 50


@pytest.mark.parametrize("shape", ["explode", "join", "union", "limit", "group", "scan"])
def test_every_row_has_a_key_of_its_own_under_any_plan(spark, docs_of, shape):
    docs = docs_of(edge_texts(), clashing=True)
    df = {
        "explode": docs.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))),
        "join": docs.join(spark.range(2).withColumnRenamed("id", "other"), F.lit(True)),
        "union": docs.unionByName(docs),
        "limit": docs.limit(11),
        "group": docs.groupBy("doc_id", "text").count(),
        "scan": docs.filter("doc_id > 3").withColumn("extra", F.lit(1)),
    }[shape]
    rows = numbered(df)
    assert rows.select(ROW).distinct().count() == rows.count() == df.count()


def test_exploded_rows_are_rows(spark, docs_of):
    """Each row twice by a plan gives what the same rows give when they are written first."""
    docs = docs_of(edge_texts())
    twice = docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    written = docs_of(edge_texts() * 2)
    assert keep_one(twice).count() == keep_one(written).count()
    left = lambda df: sum(len(r.text or "") for r in drop_repeated_lines(df).collect())
    assert left(twice) == left(written)


def test_columns_of_any_name_pass_through(spark, docs_of):
    rows = edge_texts()
    names = [*sorted(RESERVED), "__ROW_own", "removed_lines", "removed_chunks"]
    docs = docs_of(rows).selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    items = spark.createDataFrame([(1, "no such item is here at all in any of these texts")], "item_id long, text string")
    for kept in (keep_one(docs), drop_contaminated(docs, items), drop_repeated_lines(docs)):
        assert kept.columns == docs.columns
        for r in kept.collect():
            assert [r[n] for n in names] == list(range(len(names)))
    counted = drop_repeated_lines(docs, counts=True)
    assert counted.columns == [*docs.columns[:-2], "removed_chunks", "removed_lines"]
    assert counted.count() == len(rows) and leaks(docs, items).count() == 0
    assert pack_documents(docs).count() >= len(rows)
    plain, restored = sheltered(docs)
    assert not RESERVED & set(plain.columns) and restored(plain).columns == docs.columns
