"""The shape of the physical plans, and the build end to end."""

import pytest
from pyspark.sql import functions as F

from attesta.config import Tables
from attesta.operators.claims import classify
from attesta.operators.evidence import find_evidence
from attesta.operators.facts import claims_of, evidence_of, found_facts, write_facts
from attesta.operators.trust import gold_trust, trust_from_tables
from attesta.packs import CARE_PACK, NOTICE_PACK, Rule, RulePack
from attesta.plans.bindings import (
    PARTITIONS_SETTING, district_source, document_entities, facility_source, postcode_source,
)
from attesta.plans.build import run_all
from attesta.plans.catalogue import QUERIES
from attesta.sources.tables import overwrite_table, read_parquet

SF = "/root/testdata/sf0.001"

# Queries that only look at a plan would still write tables or run a stream.
WRITES = {
    "bronze_copy", "gold_trust_tables", "model_claims", "model_trust", "recorded_notes", "recorded_verdicts",
    "verifications_stream", "snapshot_intervals", "snapshot_as_of", "similar_claims", "similar_claims_exact",
    "similar_claims_recall", "source_quality", "page_quality", "verdict_stream_log", "verifications_state", "label_lines",
}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_pairing_of_all_rows_and_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in plan


def test_flagship_shuffles_only_ids(spark):
    plan = _plan(QUERIES["gold_trust"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert "RoundRobin" not in plan
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert all("text" not in e and "description" not in e for e in exchanges)
    assert plan.count("HashAggregate") == 4 and "SortAggregate" not in plan
    assert "html" not in plan


@pytest.mark.parametrize("name", ["classify_claims", "classify_codes", "gold_trust", "indicator_filter"])
def test_no_sort_and_the_same_plan_at_any_core_count(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "SortAggregate" not in plan and "RoundRobin" not in plan and "rangepartitioning" not in plan


def test_triage_ranks_before_it_fetches_texts(spark):
    plan = QUERIES["triage"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan.split("GlobalLimit 200")[2].splitlines()
    folded = next(line for line in ranked if "Aggregate [" in line)
    assert "trust_score" in folded and "description" not in folded and "capabilities" not in folded
    assert "rightHint=(strategy=broadcast)" in plan


def test_one_scan_finds_claims_and_evidence(spark):
    found = found_facts(document_entities(spark, SF), NOTICE_PACK)
    plan = _plan(found)
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan
    facts = write_facts(document_entities(spark, SF), NOTICE_PACK)
    assert {tuple(r) for r in claims_of(facts).collect()} == {
        tuple(r) for r in classify(document_entities(spark, SF), NOTICE_PACK).collect()
    }
    assert {tuple(r) for r in evidence_of(facts).collect()} == {
        tuple(r) for r in find_evidence(document_entities(spark, SF), NOTICE_PACK).collect()
    }


def test_labels_come_before_the_scoring(spark):
    plan = QUERIES["eval_predictions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") > plan.index("Generate")


def test_readers_deal_only_when_told(spark, tmp_path):
    assert read_parquet(spark, f"{SF}/documents.parquet").rdd.getNumPartitions() == 1
    assert read_parquet(spark, f"{SF}/documents.parquet", 6).rdd.getNumPartitions() == 6


def test_a_rewrite_that_fails_leaves_the_table(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS src")
    overwrite_table(spark.range(4), "src.kept")
    with pytest.raises(Exception, match="wrong|raise"):
        overwrite_table(spark.range(2).select(F.raise_error(F.lit("wrong")).alias("id")), "src.kept")
    assert spark.table("src.kept").count() == 4
    assert overwrite_table(spark.table("src.kept").filter("id > 1"), "src.kept").count() == 2


def test_scans_are_pruned_and_filtered(spark):
    plan = _plan(QUERIES["parameterised_sql"](spark, SF))
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<lang:string,source:string,n_chars:bigint>" in plan
    assert "Window" not in _plan(QUERIES["dedupe_by_priority"](spark, SF))


def _raw_facilities(spark):
    """Customers plus documents, whose texts hold claims, as raw rows with JSON arrays."""
    docs = document_entities(spark, SF)
    text_rows = docs.select(
        F.concat(F.lit("doc"), "facility_id").alias("unique_id"), "name", "description",
        F.to_json("capabilities").alias("capability"), F.to_json("procedures").alias("procedure"),
        F.to_json("equipment").alias("equipment"), F.to_json("specialties").alias("specialties"),
    )
    return facility_source(spark, SF).unionByName(text_rows, allowMissingColumns=True)


def test_build_writes_every_table(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS src")
    _raw_facilities(spark).write.mode("overwrite").saveAsTable("src.facilities")
    postcode_source(spark, SF).write.mode("overwrite").saveAsTable("src.postcodes")
    district_source(spark, SF).write.mode("overwrite").saveAsTable("src.districts")
    names = Tables(
        schema="trust_test", source_facilities="src.facilities", source_postcodes="src.postcodes",
        source_districts="src.districts",
    )
    for _ in range(2):
        gold = run_all(spark, names, CARE_PACK)
    for t in ("bronze_facility", "silver_facility", "silver_pincode", "silver_district_health",
              "silver_claim", "silver_evidence", "gold_facility_trust"):
        assert spark.catalog.tableExists(names.fq(getattr(names, t)))
    assert spark.table(names.fq("silver_facility")).count() == 350
    entities = spark.table(names.fq("silver_facility"))
    expect = {tuple(r) for r in gold_trust(entities, CARE_PACK).collect()}
    assert len(expect) > 50
    assert {tuple(r) for r in gold.drop("last_computed_at").collect()} == expect
    claims, evidence = (spark.table(names.fq(t)) for t in ("silver_claim", "silver_evidence"))
    assert {tuple(r) for r in trust_from_tables(claims, evidence).collect()} == expect


def test_packs_are_bounded():
    rules = tuple(Rule(f"r{i}", ("x",)) for i in range(4097))
    with pytest.raises(ValueError, match="4096"):
        RulePack(rules, "a", "b")


def test_overwrite_may_change_the_schema(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS src")
    assert overwrite_table(spark.range(5), "src.evolving").columns == ["id"]
    again = overwrite_table(spark.range(3).selectExpr("id", "'x' AS kind"), "src.evolving")
    assert again.columns == ["id", "kind"] and again.count() == 3


@pytest.mark.parametrize("step", range(6))
def test_a_rewrite_cut_off_at_any_step_is_taken_up_again(spark, monkeypatch, step):
    """The statement number ``step`` of a rewrite fails; the old or the new table is there after recovery."""
    from attesta.sources import tables

    spark.sql("CREATE SCHEMA IF NOT EXISTS src")
    name = f"src.cut_off_{step}"
    overwrite_table(spark.range(4), name)
    plain, said = type(spark).sql, []

    def sql(self, text, *args, **named):
        said.append(text)
        if len(said) == step + 1:
            raise RuntimeError("cut off")
        return plain(self, text, *args, **named)

    with monkeypatch.context() as m:
        m.setattr(type(spark), "sql", sql)
        try:
            overwrite_table(spark.range(7), name)
        except RuntimeError:
            pass
    tables.recover_table(spark, name)
    assert spark.table(name).count() in (4, 7)
    assert not spark.catalog.tableExists(f"{name}__old") and not spark.catalog.tableExists(f"{name}__next")
    assert overwrite_table(spark.table(name).limit(2), name).count() == 2


@pytest.mark.parametrize("name", ["indicator_filter", "triage_filtered"])
def test_costly_filters_run_behind_the_dealing(spark, name):
    spark.conf.set(PARTITIONS_SETTING, "6")
    try:
        plan = _plan(QUERIES[name](spark, SF))
    finally:
        spark.conf.unset(PARTITIONS_SETTING)
    assert "RoundRobinPartitioning" in plan
    for below in plan.split("RoundRobinPartitioning")[1:]:
        first = below.split("FileScan")[0]
        assert "rlike" not in first.lower()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from attesta.session import shared_dir

    conf = {"spark.sql.warehouse.dir": "/w"}
    for master in ("local[2]", "yarn"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)
        if master == "yarn":
            with pytest.raises(RuntimeError, match="shared|share"):
                shared_dir(session)
        else:
            assert shared_dir(session) == "/w/_intermediates"


def test_triage_leaves_large_limits_to_the_planner(spark):
    docs = document_entities(spark, SF)
    from attesta.operators.serving import triage

    for limit, hinted in ((200, True), (1_000_000, False)):
        found = triage(gold_trust(docs, NOTICE_PACK), docs, "common", limit=limit)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == hinted
