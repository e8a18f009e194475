import random

import attesta.llm.line_dedup as line_dedup
from attesta.llm.line_dedup import drop_repeated_lines

from . import brute
from .conftest import edge_texts, sentence


def test_equals_brute_force(edges):
    rows = edge_texts()
    out = drop_repeated_lines(edges, counts=True)
    assert out.columns == [*edges.columns, "removed_chunks", "removed_lines"]
    got = sorted(str((r["doc_id"], r["text"], r["n_chars"])) for r in out.collect())
    want = brute.line_dedup(rows)
    assert got == sorted(
        str((d, t, None if t is None else len(t))) for (d, _), t in zip(rows, want, strict=True)
    )
    assert {r["row"] for r in out.collect()} == {"row"}


def test_shared_block_goes_but_single_lines_stay(docs_of):
    rng = random.Random(6)
    block = "\n".join(sentence(rng, 9) for _ in range(30))
    notice = "all rights reserved"
    rows = [(i, f"{sentence(rng, 9)}\n{block}\n{notice}") for i in range(40)] + [(99, notice)]
    got = {r["doc_id"]: r["text"] for r in drop_repeated_lines(docs_of(rows)).collect()}
    assert got[0] == rows[0][1] and got[99] == notice
    assert all(got[i] == rows[i][1].split("\n")[0] for i in range(1, 40))


def test_short_runs_go_in_any_surroundings(docs_of):
    rng = random.Random(7)
    own = lambda: sentence(rng, 8)
    runs = [[own() for _ in range(n)] for n in (2, 3, 4, 5) for _ in range(10)]
    rows, plain = [], []
    for d in range(120):
        before, behind = ([own() for _ in range(rng.randint(0, 4))] for _ in range(2))
        rows.append((d, "\n".join([*before, *runs[d % 40], *behind])))
        plain.append("\n".join(before + behind))
    got = {r["doc_id"]: r["text"] for r in drop_repeated_lines(docs_of(rows)).collect()}
    assert all(got[d] == (rows[d][1] if d < 40 else plain[d]) for d in range(120))


def test_periods_overlaps_and_parts_of_runs(docs_of):
    texts = ["a\na\na\na\na", "a\nb\na\nb\na\nb", "x\nl0\nl1", "l0\nl1\nl2", "y\nl1\nl2\nz", "\n\n\n", "\n\n\n",
             "head\n\nbody", "head\n\nother", "l1\nl0"]
    rows = list(enumerate(texts))
    got = [r["text"] for r in sorted(drop_repeated_lines(docs_of(rows)).collect(), key=lambda r: r["doc_id"])]
    assert got == brute.line_dedup(rows)
    assert got[:6] == ["a\na", "a\nb", "x\nl0\nl1", "l2", "y\nz", "\n\n\n"]
    kept = {line for t in got for line in t.split("\n")}
    assert kept >= {line for t in texts for line in t.split("\n") if line}


def test_lines_with_one_hash_are_told_apart(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "line_hash", lambda line: len(line))
    rows = [(1, "one\nthree"), (2, "two\nthree"), (3, "fifteen\nfourteen"), (4, "fifteen\nfourteen"), (5, "x\nfifteen\nfourteen")]
    got = {r["doc_id"]: r["text"] for r in drop_repeated_lines(docs_of(rows)).collect()}
    assert got == {**dict(rows), 4: "", 5: "x"}


def test_empty(no_docs):
    out = drop_repeated_lines(no_docs)
    assert out.count() == 0 and out.schema == no_docs.schema
