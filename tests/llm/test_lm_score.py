import math
import random

import numpy as np

from attesta.llm import lm_score as lm
from attesta.llm.common import numbered, texts
from attesta.sources import tables

from .conftest import edge_texts


def grammar(rng, n):
    """Sentences in which the neighbours on both sides tell the word between them."""
    out = []
    for _ in range(n):
        k = rng.randrange(12)
        out.append(f"open{k} middle{k} close{k} stop")
    return " ".join(out)


def rows(n=120, seed=31):
    rng = random.Random(seed)
    return [(i, grammar(rng, rng.randint(20, 60))) for i in range(n)]


def test_gradients():
    rng = np.random.default_rng(1)
    params = {k: v.astype(np.float64) for k, v in lm.fresh_params(rng.integers(1, 50, lm.OUTPUTS)).items()}
    context, y = rng.integers(0, lm.OUTPUTS + 1, (2 * lm.REACH, 40)), rng.integers(0, lm.OUTPUTS, 40)
    _, grads = lm.forward(params, context, y, grads=True)
    for name, at in (("class", (3, 5)), ("word", (int(y[0]) // 32, 2, 7)), ("hidden", (4,)),
                     ("embed", (1, int(context[1][0]), 3)), ("word_bias", (int(y[1]) // 32, int(y[1]) % 32))):
        values = []
        for step in (1e-4, -1e-4):
            moved = {k: v.copy() for k, v in params.items()}
            moved[name][at] += step
            values.append(-lm.forward(moved, context, y).mean())
        assert math.isclose((values[0] - values[1]) / 2e-4, grads[name][at], rel_tol=2e-2, abs_tol=1e-6)


def test_probabilities_sum_to_one_and_use_both_sides():
    params = lm.fresh_params(np.arange(1, lm.OUTPUTS + 1))
    params["embed"] = np.random.default_rng(2).normal(0, 1, params["embed"].shape)
    context = np.tile(np.array([[1], [2], [3], [4]]), lm.OUTPUTS)
    assert math.isclose(np.exp(lm.forward(params, context, np.arange(lm.OUTPUTS))).sum(), 1, rel_tol=1e-5)
    for place in range(4):
        moved = context.copy()
        moved[place] += 7
        assert abs(lm.forward(params, moved, np.arange(lm.OUTPUTS)) - lm.forward(params, context, np.arange(lm.OUTPUTS))).max() > 1e-3


def test_windows():
    context, y, owner = lm.windows([np.array([5, 6, 7]), np.array([], int), np.array([8])])
    pad = lm.PAD
    assert context.T.tolist() == [[pad, pad, 6, 7], [pad, 5, 7, pad], [5, 6, pad, pad], [pad] * 4]
    assert y.tolist() == [5, 6, 7, 8] and owner.tolist() == [0, 0, 0, 2]


def test_scores_equal_word_by_word(docs_of):
    docs = lm.texts(docs_of(rows(20) + edge_texts()[:4]))
    vocabulary, params = lm.fit(docs)
    got = {r["doc_id"]: r for r in lm.score(docs, vocabulary, params).collect()}
    for doc_id, text in rows(20):
        ids = [vocabulary[w] for w in text.encode().lower().split()]
        total = 0.0
        for i, y in enumerate(ids):
            around = [ids[i + k] if 0 <= i + k < len(ids) else lm.PAD for k in (-2, -1, 1, 2)]
            total += float(lm.forward(params, np.array(around)[:, None], np.array([y]))[0])
        if doc_id not in (1, 2, 3):
            assert abs(got[doc_id]["log_prob"] - total) < 0.02 and got[doc_id]["n_tokens"] == len(ids)


def test_held_out_order_scores_better_than_shuffled(docs_of):
    docs = lm.texts(docs_of(rows()))
    vocabulary, params = lm.fit(docs)
    rng, held, mixed = random.Random(99), [], []
    for _ in range(20):
        words = grammar(rng, 40).split()
        held.append(" ".join(words))
        rng.shuffle(words)
        mixed.append(" ".join(words))
    test = lm.texts(docs_of([(i, t) for i, t in enumerate(held + mixed)]))
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(test, vocabulary, params).collect()}
    assert sum(got[i] > got[20 + i] for i in range(20)) >= 19
    counts = np.full(lm.OUTPUTS, 1.0)
    flat = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(test, vocabulary, lm.fresh_params(counts)).collect()}
    assert np.mean([got[i] for i in range(20)]) > np.mean([flat[i] for i in range(20)]) + 1


def test_average_weighs_tasks_by_their_words(spark, docs_of):
    docs = lm.texts(docs_of(rows(40)))
    vocabulary = lm.Vocabulary({})
    start = lm.fresh_params(np.ones(lm.OUTPUTS))
    parts = docs.repartition(3, "doc_id").sortWithinPartitions("doc_id")
    got = lm.average(parts, vocabulary, start)
    total, want = 0, {k: 0.0 for k in start}
    for part in parts.rdd.glom().collect():
        found = [np.array([vocabulary[w] for w in r["text"].encode().lower().split()]) for r in part]
        if found:
            context, y, _ = lm.windows(found)
            trained, seen = lm.train(start, iter([(context, y)]))
            total += seen
            want = {k: want[k] + seen * trained[k].astype(float) for k in want}
    for k in want:
        assert np.allclose(got[k], want[k] / total, atol=1e-4)


def test_counts_and_edges(edges, no_docs):
    got = lm.pseudo_likelihood(edges).collect()
    assert len(got) == len(edge_texts())
    for r in got:
        assert (r["n_tokens"] == 0) == (r["mean_log_prob"] is None) and r["log_prob"] <= 0
    counted = {bytes(r["word"]): r["n"] for r in lm.count_words(lm.texts(edges)).collect()}
    assert sum(counted.values()) == sum(len((t or "").encode().split()) for _, t in edge_texts())
    assert lm.pseudo_likelihood(no_docs).count() == 0


def one_word_rows():
    """One word a row: 1,000 common words and 1,500 rare ones, some of them more often than others."""
    words = [f"common{i}" for i in range(1000) for _ in range(8)]
    return list(enumerate(words + [f"rare{i}" for i in range(1500) for _ in range(1 + 3 * (i % 2))]))


def test_words_in_a_bucket_share_its_probability(docs_of):
    found = {r["doc_id"]: r["log_prob"] for r in lm.pseudo_likelihood(docs_of(one_word_rows())).collect()}
    got = {w: found[i] for i, w in one_word_rows()}
    assert sum(math.exp(p) for p in got.values()) < 1.05
    bucket = {w: lm.Vocabulary()[w.encode()] for w in got if w.startswith("rare")}
    often, once = (next(w for w in bucket if bucket[w] == lm.VOCABULARY and int(w[4:]) % 2 == odd) for odd in (1, 0))
    assert math.isclose(got[often] - got[once], math.log(4), abs_tol=0.02)


def test_unseen_words_score_below_seen_ones(docs_of):
    model = lm.fit_counted(lm.texts(docs_of(one_word_rows())))
    test = docs_of([(i, f"rare{i}") for i in range(200)] + [(1000 + i, f"unseen{i}") for i in range(200)])
    rows = lm.texts(lm.numbered(test), "doc_id", "text", lm.ROW)
    got = {r["doc_id"]: r["log_prob"] for r in lm.score_words(rows, *model).collect()}
    assert min(got[i] for i in range(200)) > max(got[1000 + i] for i in range(200))


def test_blocks_do_not_change_scores(docs_of, monkeypatch):
    docs = lm.numbered(lm.texts(docs_of(rows(40) + edge_texts())))
    model = lm.fit_counted(docs)
    whole = sorted(map(str, lm.score_words(docs, *model).collect()))
    monkeypatch.setattr(lm, "BLOCK_WORDS", 3)
    encoded = lm.encode(docs, model[0])
    assert encoded.filter("ids IS NOT NULL").count() == len(rows(40) + edge_texts())
    assert encoded.select("block").distinct().count() > 5
    assert sorted(map(str, lm.score_encoded(encoded, model[1], *model[2:]).collect())) == whole


def test_words_go_to_their_blocks_as_one_long(spark):
    # The rare words of a block meet their counts and come back with eight bytes for count and place.
    docs = numbered(texts(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")))
    counted = spark.createDataFrame([(bytearray(b"a"), 1 << 31)], "word binary, n long")
    vocabulary = lm.Vocabulary()
    params = lm.fresh_params(np.ones(lm.OUTPUTS))
    found = lm.score_words(docs, vocabulary, params, counted, np.zeros(lm.CLASS_SIZE))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "AS held" in plan and "AS n#" not in plan
    rows = {r.doc_id: r for r in found.collect()}
    ids = np.array([vocabulary[w] for w in (b"a", b"b", b"c")], np.int16)
    less = np.zeros(lm.OUTPUTS)
    less[lm.VOCABULARY:] = np.log(lm.UNSEEN)
    want = lm.log_probs([ids], params, less)[0] + np.log(float(1 << 31)) + 2 * np.log(lm.UNSEEN)
    assert abs(rows[1].log_prob - want) < 0.01 and rows[1].n_tokens == 3
    assert (rows[2].n_tokens, rows[2].log_prob, rows[2].mean_log_prob) == (0, 0.0, None)


def test_intermediates_are_written_with_zstd(spark):
    written = tables.materialise(spark.range(3).toDF("x"), "codec")
    assert written.inputFiles() and all(f.endswith(".zstd.parquet") for f in written.inputFiles())
    assert sorted(r.x for r in written.collect()) == [0, 1, 2]
