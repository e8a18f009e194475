"""Alignment against encoding whole texts and counting pairs in dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import alignment
from attesta.llm.alignment import align_tokenizers, bitmaps, linked_pairs, places

from .conftest import edge_texts

SF = "/root/testdata/sf0.001"
ODD = list(" \n\t\r  ab'sI'll 1,.;é▁ß中𝒳\x1c\x85　  \n\n") + ["<|endoftext|>", "<s>", "<0x41>", " the", " and"]


@pytest.fixture(scope="module")
def pair():
    with open(alignment.BYTE_BPE, encoding="utf-8") as f, open(alignment.PIECE_BPE, "rb") as g:
        return alignment.Pair(f.read(), g.read())


def whole(pair, text):
    """Ids with byte ranges by encoding the text in one go; None where bytes differ."""
    raw = (" " + text).encode()
    out = []
    for ids, spelled in (
        (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.a_bytes), (pair.b.encode(text), pair.b_bytes),
    ):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(spelled[i])))
            at += len(spelled[i])
        if b"".join(spelled[i] for i in ids) != raw:
            return None
        out.append(spans)
    return out


def aligned(pair, texts):
    """The wanted rows, one per text."""
    coded = [whole(pair, t) if t else None for t in texts]
    links, docs = [], Counter()
    for spans in coded:
        own = Counter()
        for a, s, e in spans[0] if spans else ():
            for b, x, y in spans[1]:
                if x < e and s < y:
                    own[a, b] += 1
        links.append(own)
        docs.update(own.keys())
    highest = defaultdict(int)
    for (a, _), n in docs.items():
        highest[a] = max(highest[a], n)
    rows = []
    for spans, own in zip(coded, links, strict=True):
        if not spans:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for end in ends:
            inside = [",".join(str(i) for i, s, e in side if low <= s and e <= end) for side in spans]
            groups.append("|".join(inside))
            low = end
        rows.append((
            len(spans[0]), len(spans[1]), len(groups), sum(own.values()),
            sum(n for p, n in own.items() if docs[p] == highest[p[0]]), sum(n * docs[p] for p, n in own.items()),
            hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return rows, docs, links


def test_pieces_give_what_whole_texts_give(pair):
    rng = random.Random(7)
    chunks = alignment.Chunks(pair)
    for _ in range(2000):
        text = "".join(rng.choices(ODD, k=rng.randint(1, 40)))
        spans, ids = whole(pair, text), chunks.ids([text])[0]
        assert (len(ids) > 0) == (spans is not None)
        if spans:
            groups = [g.split("|") for i in ids for g in chunks.groups[i].split(";")]
            for k in (0, 1):
                assert [int(i) for g in groups for i in g[k].split(",")] == [i for i, _, _ in spans[k]]


def test_bitmaps_return_their_places():
    rng = np.random.default_rng(3)
    key = np.unique(np.r_[rng.integers(0, 50 << 13, 3000), (7 << 13) + rng.integers(0, 900, 2000)])
    pairs, pos = key >> 13, key & 8191
    got = set()
    for part in bitmaps(pairs, pos, 8192):
        row, at = places(part["bits"] if isinstance(part["bits"], pa.Array) else pa.array(part["bits"]), part["dense"])
        assert np.bincount(row).tolist() == list(part["n"])
        got |= set(zip(part["pair"][row].tolist(), at.tolist(), strict=True))
    assert got == set(zip(pairs.tolist(), pos.tolist(), strict=True))


@pytest.mark.parametrize("block_docs", [alignment.BLOCK_DOCS, 7])
def test_documents_equal_brute_force(spark, edges, pair, monkeypatch, block_docs):
    """Also with blocks of seven documents, so that counts cross blocks."""
    monkeypatch.setattr(alignment, "BLOCK_DOCS", block_docs)
    rng = random.Random(11)
    odd = [(2000 + i, "".join(rng.choices(ODD, k=60))) for i in range(60)]
    rows = [(r["doc_id"], r["text"]) for r in edges.collect() if len(r["text"] or "") < 5_000] + odd
    more = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 3000")
    rows += [(r["doc_id"] + 1000, r["text"]) for r in more.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pair", "2 AS block", "3 AS n")
    want, docs, links = aligned(pair, [t for _, t in rows])
    want = sorted(((d, *w) for (d, _), w in zip(rows, want, strict=True)), key=str)
    assert sorted((tuple(r) for r in align_tokenizers(df).collect()), key=str) == want
    total = sum(links, Counter())
    got = {(r["a_id"], r["b_id"]): (r["n_docs"], r["n_links"]) for r in linked_pairs(df).collect()}
    assert got == {p: (docs[p], total[p]) for p in docs}


def test_many_repeats_and_long_texts(spark, pair):
    rows = [(1, "a " * 3000), (2, "x" * 20_000), (3, edge_texts()[11][1]), (4, "a " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in align_tokenizers(df).collect()}
    want, _, _ = aligned(pair, ["a " * 3000, "x" * 300, edge_texts()[11][1], "a " * 3000])
    assert got[3] == want[2] and got[1][:4] == want[0][:4] and got[1] == got[4]
    assert got[2][0] > 0


def test_empty_table(no_docs):
    assert align_tokenizers(no_docs).count() == 0


def test_new_pieces_are_encoded_a_few_at_a_time(pair, monkeypatch):
    """A block's new pieces reach the tokenizers in slices, and the slices change no figure."""
    rng = random.Random(9)
    block = [" ".join(f"w{rng.randrange(400)}é" for _ in range(60)) for _ in range(20)] + ["", None, "\x1c", "  a\r\nb"]
    at_once = alignment.Chunks(pair)
    wanted = alignment.documents_of(at_once.ids(block), list(range(len(block))), at_once)
    sizes, encode = [], pair.encode
    monkeypatch.setattr(pair, "encode", lambda chunks: sizes.append(len(chunks)) or encode(chunks))
    monkeypatch.setattr(alignment, "ENCODED", 64, raising=False)
    sliced = alignment.Chunks(pair)
    found = alignment.documents_of(sliced.ids(block), list(range(len(block))), sliced)
    assert max(sizes) <= 64 < sum(sizes) == len(sliced.groups)
    assert {k: list(v) for k, v in found.items()} == {k: list(v) for k, v in wanted.items()}
