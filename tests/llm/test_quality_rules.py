from attesta.llm.quality_rules import Rule, quality_rules

from .brute import quality
from .conftest import edge_texts

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_figures_equal_brute_force(edges):
    got = sorted(str(tuple(r[c] for c in ("doc_id", *FIGURES))) for r in quality_rules(edges).collect())
    assert got == sorted(str((d, *quality(t))) for d, t in edge_texts())


def test_base_and_table(docs_of):
    rows = [
        (1, "a b c d e f g h i"), (2, "the plain words of a text that is kept for its own sake"),
        (3, "x y z u v " * 4), (4, "# | # | words | and | more | words | to | come | here | #"), (5, None),
    ]
    got = {r["doc_id"]: r for r in quality_rules(docs_of(rows)).collect()}
    assert [got[i]["base_failed"] for i in range(1, 6)] == [True, False, True, False, True]
    assert [got[i]["kept"] for i in range(1, 6)] == [False, True, False, False, False]
    assert "symbols_per_word" in got[4]["broken"]
    open_table = (Rule("free", "symbols"),)
    assert {r["kept"] for r in quality_rules(docs_of(rows[3:4]), open_table).collect()} == {True}


def test_native_and_empty(edges, no_docs):
    plan = quality_rules(edges)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality_rules(no_docs).count() == 0
