"""The pipeline against plain Python versions of its stages, on the smallest tables."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from attesta.llm.common import table
from attesta.llm.packing import CAPACITY
from attesta.llm.toxicity import toxicity

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The written output of every stage, as the driver runs them."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_order_and_columns(spark, stages):
    assert [n for n, _ in pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing",
    ]
    columns = table(spark, SF, "documents").dtypes
    assert all(stages[n].dtypes == columns for n, _ in pipeline.STAGES[:-1])


def test_stages_equal_brute_force(spark, stages):
    docs = table(spark, SF, "documents")
    judged = toxicity(docs, pipeline.label_columns(table(spark, SF, "labels")), pipeline.CATEGORIES)
    kept = {r["doc_id"] for r in judged.collect() if not r["toxic"]}
    assert {d for d, _ in pairs(stages["toxicity"])} == kept
    before = pairs(stages["toxicity"])
    lines = dict(zip((d for d, _ in before), brute.line_dedup(before), strict=True))
    assert dict(pairs(stages["line_dedup"])) == lines
    first = {(c if c is not None else d) for d, _, c in brute.simhash(list(lines.items()))}
    assert {d for d, _ in pairs(stages["simhash_dedup"])} == first
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaked = {d for d, _, _ in brute.leaks([(d, lines[d]) for d in first], items)}
    assert {d for d, _ in pairs(stages["decontamination"])} == first - leaked
    last = stages["decontamination"].collect()
    assert sum(r["n_chars"] for r in last) == sum(len(r["text"]) for r in last)
    rows = []
    for r in last:
        plain = " ".join(brute.WORD.findall(r["text"])).lower()
        rows.append((r["doc_id"], r["source"], plain or None, len(brute.WORD.findall(r["text"]))))
    want = brute.best_fit(rows, CAPACITY)
    got = Counter(r["bin_id"] for r in stages["packing"].collect() if r["bin_id"] and "-f" not in r["bin_id"])
    assert sorted(got.values()) == sorted(len(b["docs"]) for b in want)


def test_run_equals_the_stages(spark, stages):
    key = lambda rows: sorted(map(str, rows))
    assert key(pipeline.run(spark, SF).collect()) == key(stages["packing"].collect())


def test_edges_pass_through_all_stages(spark, edges, no_docs, tmp_path):
    for name, docs in (("edges", edges.select(*no_docs.columns)), ("none", no_docs)):
        for stage_name, stage in pipeline.STAGES:
            path = str(tmp_path / f"{name}-{stage_name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if stage_name != "packing":
                assert docs.columns == no_docs.columns
        assert (docs.count() > 0) == (name == "edges")
