import math
import random
import re

import numpy as np
import pytest

from attesta.llm import toxicity as t

from .conftest import edge_texts, sentence

BAD = ("grumbolt", "snarkwit", "vexling")


def rows(n=400, seed=13):
    """(doc_id, text, mild, harsh): harsh texts hold bad words, mild ones much shouting."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = sentence(rng, rng.randint(30, 120)).split()
        harsh, mild = int(rng.random() < 0.2), int(rng.random() < 0.3)
        if harsh:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if mild:
            words = [w.upper() for w in words]
        out.append((i, " ".join(words), mild, harsh))
    return out


@pytest.fixture
def labels(spark):
    rows_ = [(i, m, h, "x") for i, _, m, h in rows()[:250]]
    rows_ += [(3, 0, 0, "x"), (None, 1, 1, "x"), (9999, 1, 1, "x"), (5, None, 1, "x")]
    return spark.createDataFrame(rows_, "doc_id long, mild int, harsh int, text string")


def test_held_out_documents(docs_of, labels):
    docs = docs_of([r[:2] for r in rows()], clashing=True)
    got = {r["doc_id"]: r for r in t.toxicity(docs, labels, ("mild", "harsh")).collect()}
    held = rows()[250:]
    right = [got[i]["toxic"] == bool(h) for i, _, _, h in held]
    assert sum(right) / len(right) > 0.97
    assert np.mean([(got[i]["p_mild"] > 0.5) == bool(m) for i, _, m, _ in held]) > 0.95
    kept = t.drop_toxic(docs, labels, ("mild", "harsh"))
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}


def test_sample_is_bounded_and_its_words_tell(docs_of, labels):
    docs = t.texts(docs_of([r[:2] for r in rows()]))
    sample = t._sample(docs, labels, ("mild", "harsh"), 100)
    assert sample.count() == 100
    # A term may be the word or a beginning of it, as one of those that share a stem is taken.
    terms = t._telling_terms(t._sample(docs, labels, ("mild", "harsh"), 1000), 2)
    assert all(any(w.startswith(term.rstrip("*")) for term in terms) for w in BAD)


def test_later_models_are_fitted_on_out_of_fold_predictions(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = np.stack([x[:, 0] + rng.normal(size=200) > 0, x[:, 1] > 0], 1).astype(float)
    folds = np.arange(200) % 5
    weights, cuts = t.fit_models(x, y, folds)
    held = np.zeros(200)
    for k in range(5):
        own = folds == k
        held[own] = t.predict(x[own], t.fit_logistic(x[~own], y[~own, 0]))
    assert np.allclose(weights[1], t.fit_logistic(np.hstack([x, held[:, None]]), y[:, 1]))
    assert len(weights[0]) == 5 and len(weights[1]) == 6 and len(cuts) == 2


def test_logistic_reaches_its_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.logistic(size=300) > 0).astype(float)
    w = t.fit_logistic(x, y, ridge=1.0)
    full = np.hstack([x, np.ones((300, 1))])
    slope = full.T @ (y - t.sigmoid(full @ w)) - np.array([1, 1, 1, 1e-6]) * w
    assert np.abs(slope).max() < 1e-6
    assert t.predict(x, t.fit_logistic(x, np.zeros(300))).max() < 1e-9


def test_threshold():
    p, y = np.array([0.9, 0.8, 0.7, 0.6, 0.2]), np.array([1, 1, 0, 1, 1])
    assert t.threshold(p, y, 0.95) == 0.8 and t.threshold(p, y, 0.7) == 0.6
    assert t.threshold(p, 0 * y, 0.5) > 1 and t.threshold(np.zeros(0), np.zeros(0)) > 1


def test_edges(spark, edges, no_docs, labels):
    none = labels.limit(0)
    got = t.toxicity(edges, none, ("mild", "harsh")).collect()
    assert len(got) == len(edge_texts()) and not any(r["toxic"] or r["p_harsh"] > 1e-6 for r in got)
    assert t.drop_toxic(edges, none, ("mild", "harsh")).count() == len(edge_texts())
    assert t.toxicity(no_docs, labels, ("mild", "harsh")).count() == 0
    one = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (14, 1, 0)], "doc_id long, mild int, harsh int")
    assert t.toxicity(edges, one, ("mild", "harsh")).count() == len(edge_texts())


def test_threshold_with_noisy_labels_is_the_best_by_f_score():
    p = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.1])
    y = np.array([0, 1, 1, 1, 0, 0, 1])
    assert t.threshold(p, y, 0.95) == 0.7


def plain_terms(text):
    """Words of a text with their counts, and beginnings of three to seven letters of longer words."""
    out = {}
    for w in re.findall(r"\w+", text.lower()):
        for term in {w} | {w[:k] + "*" for k in range(3, 8) if len(w) > k}:
            out[term] = out.get(term, 0) + 1
    return out


def plain_fit(x, y, ridge=0.1):
    """Ridge logistic weights by reweighted least squares, the penalty as rows of its own."""
    full, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    bars = np.diag(np.sqrt([ridge] * x.shape[1] + [1e-6]))
    for _ in range(40):
        p = 1 / (1 + np.exp(-full @ w))
        root = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        target = full @ w + (y - p) / root**2
        w = np.linalg.lstsq(
            np.vstack([full * root[:, None], bars]), np.append(target * root, np.zeros(len(bars))), rcond=None
        )[0]
    return w


def plain_chain(texts, train, marks, folds):
    """(probabilities, verdicts) of all texts, from the labelled ones: counts, fits and cuts by plain loops."""
    held = [plain_terms(x) for x in texts]
    own = [held[i] for i in train]
    terms = []
    for c in range(marks.shape[1]):
        bad = int(marks[:, c].sum())
        ranked = []
        for term in set().union(*own):
            n = sum(term in d for d in own)
            k = sum(int(marks[j, c]) for j, d in enumerate(own) if term in d)
            if n >= 5:
                odds = math.log((k + 0.5) / (bad + 1) / ((n - k + 0.5) / (len(own) - bad + 1)))
                z = odds / math.sqrt(1 / (k + 0.5) + 1 / (n - k + 0.5))
                if z > 0:
                    ranked.append((-round(z, 9), -len(term), term))
        chosen = []
        for *_, term in sorted(ranked)[:512]:
            stem = term.rstrip("*")
            if len(chosen) < 64 and not any(stem.startswith(o) or o.startswith(stem) for o in (t.rstrip("*") for t in chosen)):
                chosen.append(term)
        terms += [x for x in chosen if x not in terms]
    table = []
    for text, d in zip(texts, held, strict=True):
        words, size = re.findall(r"\w+", text.lower()), max(1, len(text))
        n = max(1, len(words))
        row = [math.log(1 + d.get(x, 0)) for x in terms] + [math.sqrt(100 * d.get(x, 0) / n) for x in terms]
        share = lambda test: sum(map(test, text)) / size
        row += [math.log(1 + len(words)), min(50, sum(map(len, words)) / n), share(str.isupper), share(str.isdigit),
                share(lambda ch: not ch.isalnum() and not ch.isspace()), len(set(words)) / n]
        table.append(row)
    x = np.array(table)
    shown = x[train][:, -6:]
    x[:, -6:] = (x[:, -6:] - shown.mean(axis=0)) / np.maximum(shown.std(axis=0), 1e-6)
    fitted, out, cut = x[train], [], 2.0
    prob = lambda a, w: 1 / (1 + np.exp(-(a @ w[:-1] + w[-1])))
    for c in range(marks.shape[1]):
        y, fair = marks[:, c], np.zeros(len(train))
        for k in set(folds):
            out_of = folds == k
            fair[out_of] = prob(fitted[out_of], plain_fit(fitted[~out_of], y[~out_of]))
        out.append(prob(x, plain_fit(fitted, y)))
        fitted, x = np.column_stack([fitted, fair]), np.column_stack([x, out[-1]])
        good = [p for p in fair if p >= 0.5 and y[fair >= p].mean() >= 0.95]
        assert good  # the other rules for the cut have tests of their own
        cut = min(good)
    return np.column_stack(out), out[-1] >= cut, np.abs(out[-1] - cut) > 1e-4


def test_equals_plain_loops(spark, docs_of):
    """The whole operator, terms, features, folds, chain and verdicts, against loops over all documents."""
    all_rows = rows(160, seed=41)
    docs = docs_of([r[:2] for r in all_rows])
    marks = [(i, m, h) for i, _, m, h in all_rows[:110]]
    labels = spark.createDataFrame(marks, "doc_id long, mild int, harsh int")
    fold = {r[0]: r[1] for r in labels.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {t.FOLDS})").collect()}
    train = [i for i, *_ in marks]
    p, toxic, clear = plain_chain(
        [r[1] for r in all_rows], train, np.array([m[1:] for m in marks], float), np.array([fold[i] for i in train])
    )
    got = {r["doc_id"]: r for r in t.toxicity(docs, labels, ("mild", "harsh")).collect()}
    assert np.abs(np.array([[got[i]["p_mild"], got[i]["p_harsh"]] for i in range(160)]) - p).max() < 1e-4
    assert clear.mean() > 0.95 and 0 < toxic.sum() < 160
    assert all(got[i]["toxic"] == bool(toxic[i]) for i in range(160) if clear[i])
