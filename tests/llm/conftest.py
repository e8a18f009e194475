import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Columns whose names operators use inside, to show that input columns cannot clash with them.
CLASHING = ("row", "key", "fp", "root", "count", "words", "lines", "shard", "hash", "x", "links", "n")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("aeioustrnlm", k=rng.randint(2, 9))) for _ in range(n))


def edge_texts() -> list[tuple]:
    """(doc_id, text): nulls, blanks, ties, repeated rows, copies and a very long text."""
    rng = random.Random(5)
    page = "\n".join(sentence(rng, 12) for _ in range(9))
    long = "\n".join(sentence(rng, 40) for _ in range(1200))
    rows = [
        (1, None), (2, ""), (3, " \n\t \n"), (None, "three plain words"), (None, None), (4, page), (4, page),
        (5, page), (6, page + "\n" + sentence(rng, 30)), (7, long), (8, "one"), (9, "Two WORDS"),
        (10, "two words"), (11, "a\n" * 50), (12, "é œ 𝒳 ß x\x1f" * 30), (13, long.replace("a", "o", 3)),
        (14, sentence(rng, 300)), (15, "\n".join([sentence(rng, 8)] * 6)),
    ]
    return rows


@pytest.fixture
def docs_of(spark, tmp_path):
    """Rows of (doc_id, text) as a written documents table, with clashing columns if asked for."""

    def make(rows, clashing=False):
        full = [
            (d, t, "en" if i % 3 else None, f"src{i % 3}" if i % 4 else None, None if t is None else len(t))
            for i, (d, t) in enumerate(rows)
        ]
        df = spark.createDataFrame(full, DOCS).coalesce(2)
        if clashing:
            df = df.selectExpr("*", *[f"'{c}' AS {c}" for c in CLASHING])
        path = str(tmp_path / f"docs-{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def edges(docs_of):
    return docs_of(edge_texts(), clashing=True)


@pytest.fixture
def no_docs(docs_of):
    return docs_of([])
