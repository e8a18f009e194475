import random

import pytest

import attesta.llm.decontaminate as decontaminate
from attesta.llm.decontaminate import drop_contaminated, leaks

from . import brute
from .conftest import edge_texts, sentence

ITEMS = [
    (1, "A train leaves the station at 14 km from Paris and goes for 3 hours with 120 km/h, "
        "so how far is it from the station at the end of the trip?"),
    (2, "If Mary buys 12 apples and gives 5 of them to John, how many apples does Mary still have?"),
    (3, "short item here"), (4, None), (5, ""), (6, "12 34 56 78"),
    (7, "If Mary buys 12 apples and gives 5 of them to John, how many apples does Mary still have?"),
]


def rows():
    rng = random.Random(12)
    a, b = ITEMS[0][1], ITEMS[1][1]
    wrap = lambda t: f"{sentence(rng, 40)} {t}\n{sentence(rng, 30)}"
    return [
        (1, wrap(a)), (2, wrap(a.replace("14", "90").replace("120", "75.5").replace("3 hours", "8 hours"))),
        (3, wrap(b.replace("Mary", "Anna").replace("John", "Peter").replace("12", "40"))),
        (4, wrap(b.replace("Mary", "Anna", 1))), (5, wrap(" ".join(b.split()[:7]))), (6, wrap("nothing")),
        (7, wrap(b) + wrap(b)), (7, wrap(a)), (None, wrap(b)), (8, "short item here"), (9, b.replace("5 of", "5kg of")),
        (10, wrap(" ".join(a.split()[4:26]))),
    ] + edge_texts()


def bench(spark):
    return spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, hash string")


def test_equals_brute_force(spark, docs_of):
    got = sorted(str((r["doc_id"], r["item_id"], r["matched"])) for r in leaks(docs_of(rows(), True), bench(spark)).collect())
    assert got == sorted(map(str, brute.leaks(rows(), ITEMS)))


def test_parameters_may_change_but_only_consistently(spark, docs_of):
    got = {(r["doc_id"], r["item_id"]): r["changed_slots"] for r in leaks(docs_of(rows()), bench(spark)).collect()}
    assert got[1, 1] == 0 and got[2, 1] > 0 and got[3, 2] > 0 and got[4, 2] == 0
    assert {d for d, _ in got} == {1, 2, 3, 4, 7, 8, 9, None, 10}


def test_drop_native_and_empty(spark, docs_of, no_docs):
    docs = docs_of(rows(), clashing=True)
    kept = drop_contaminated(docs, bench(spark))
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(
        [5, 6] + [d or -1 for d, t in edge_texts() ]
    )
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert leaks(no_docs, bench(spark)).count() == 0
    assert leaks(docs, bench(spark).limit(0)).count() == 0


def test_punctuation_is_no_part_of_a_value(spark, docs_of):
    texts = [(1, ITEMS[1][1].replace("does Mary still", "does Mary, still"))]
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs_of(texts), bench(spark)).collect()} == {(1, 2), (1, 7)}


def test_items_rich_in_values_are_found_word_for_word(spark, docs_of):
    numbers = "12 34 56 78 90 11 22 33 44 55"
    items = [(1, numbers), (2, "capital of France?"), (3, "of Paris Berlin London Madrid Rome Vienna Prague"), (4, "yes")]
    around = "some words before {} and some words behind".format
    texts = [(1, around(numbers)), (2, "capital of France?"), (3, around(items[2][1])), (4, around(numbers[::-1])),
             (5, "capital of Spain?"), (6, around("of Paris Oslo London Lisbon Rome Athens Prague")), (7, "yes"), (8, "12 34")]
    found = leaks(docs_of(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 2), (3, 3), (7, 4)}


def test_a_conflict_costs_only_the_windows_that_changed(spark, docs_of):
    b = ITEMS[1][1]
    two = "Of the pens that Mary has and the pens that John has, how many does Mary give, and how many does John give, to Mary?"
    texts = [(1, b.replace("Mary", "Anna", 1)), (2, two.replace("Mary", "Anna", 1)),
             (3, "Of the pens that Anna has and the pens that Peter has, how many does Rosa give, and how many does Paul give, to Ella?")]
    items = [(2, b), (3, two)]
    found = leaks(docs_of(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 2), (2, 3)}


def test_items_with_one_id_or_none_are_counted_apart(spark, docs_of):
    text = "eight plain words make one short question here"
    for ids in ((5,), (5, 5), (None, None), (5, None, 5, 6)):
        bench = spark.createDataFrame([(i, text) for i in ids], "item_id long, text string")
        found = leaks(docs_of([(1, f"before it {text} and behind"), (2, "nothing of it")]), bench).collect()
        assert sorted(str(r["item_id"]) for r in found) == sorted(map(str, ids))
        assert {(r["doc_id"], r["matched"], r["item_windows"]) for r in found} == {(1, 4, 4)}


@pytest.mark.parametrize("bound", (0, 10**9))
def test_both_joins_find_the_same(spark, docs_of, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    docs = docs_of(rows())
    got = sorted(str((r["doc_id"], r["item_id"], r["matched"])) for r in leaks(docs, bench(spark)).collect())
    assert got == sorted(map(str, brute.leaks(rows(), ITEMS)))
