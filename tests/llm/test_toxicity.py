"""The factorization machine: against explicit sums over pairs, on interactions, on held-out rows, on edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest

from vellumine.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def brute_score(model, numbers):
    w = dict(zip(model.bins.tolist(), model.weights.tolist(), strict=True))
    v = dict(zip(model.bins.tolist(), model.vectors.tolist(), strict=True))
    known = [i for i in numbers if i in w]
    margin = model.bias + sum(w[i] for i in known) + sum(np.dot(v[i], v[j]) for i, j in itertools.combinations(known, 2))
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def interacting(n=4000, seed=1):
    """Texts that are toxic where an insult and a group stand together, and hardly ever otherwise."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(("plain", "words", "without", "any", "weight")) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["zorgish"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_terms():
    one = toxicity.terms("Word word WORD, wor")
    assert len(one) == 2 and np.array_equal(one, toxicity.terms("wor word"))
    assert {toxicity._hash("w lowercase"), toxicity._hash("s lowe"), toxicity._hash("s lowerc")} == set(toxicity.terms("LOWERCASE 123 _ !").tolist())
    for empty in (None, "", "12 34 ..."):
        assert len(toxicity.terms(empty)) == 0


def test_pairs_are_learnt_and_scored_as_sums_over_pairs():
    rows = interacting()
    terms, labels = [toxicity.terms(t) for _, t, _ in rows], np.array([y for *_, y in rows], float)
    model = toxicity.learn(terms[:3000], labels[:3000])
    scores = model.scores(terms)
    assert np.allclose(scores[:60], [brute_score(model, t.tolist()) for t in terms[:60]], atol=1e-9)
    held = slice(3000, None)
    assert ((scores[held] >= 0.5) == (labels[held] == 1)).mean() > 0.98
    one, other = toxicity._hash("w zorgish"), toxicity._hash("w martians")
    at = {b: k for k, b in enumerate(model.bins.tolist())}
    assert model.vectors[at[one]] @ model.vectors[at[other]] > 0.5
    # without the pairs one of the terms alone must weigh too much, or both together too little
    alone = toxicity.learn(terms[:3000], labels[:3000], factors=0)
    assert len(alone.vectors[0]) == 0
    log = lambda s: -np.mean(np.log(np.where(labels[held] == 1, s[held], 1 - s[held]) + 1e-9))
    assert log(scores) < 0.75 * log(alone.scores(terms))


def test_learning_is_repeatable_and_needs_both_labels():
    rows = interacting(600)
    terms, labels = [toxicity.terms(t) for _, t, _ in rows], np.array([y for *_, y in rows], float)
    a, b = toxicity.learn(terms, labels), toxicity.learn(terms, labels)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.vectors, b.vectors) and a.bias == b.bias
    for y, want in ((0.0, 0.0), (1.0, 1.0)):
        assert toxicity.learn(terms, labels * 0 + y).scores(terms[:3] + [np.empty(0, np.int64)]) == pytest.approx([want] * 4, abs=1e-9)
    assert toxicity.learn([], np.empty(0)).scores([terms[0]]) == pytest.approx([0], abs=1e-9)


def test_through_spark(spark):
    rows = interacting(3000)
    docs = [(i, t, "x", 7) for i, t, _ in rows] + [(None, "no identifier", "x", 7), (5000, None, "x", 7), (5001, "", "x", 7), (5002, "zorgish martians " * 40_000, "x", 7), (5002, "zorgish martians " * 40_000, "x", 7)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, score string, label int").repartition(5)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(3, None, 1), (None, 1, 1), (99_999, 1, 1)], "doc_id long, toxic int, score int")
    model = toxicity.fit(docs, labels)
    found = toxicity.predict(docs, model)
    assert set(found.columns) == {"doc_id", "label", "score", "predicted"}
    got = sorted(map(tuple, found.select("doc_id", "score", "predicted").collect()), key=repr)
    assert len(got) == len(rows) + 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, score, predicted in random.Random(1).sample(got, 60) + got[-8:]:
        assert score == pytest.approx(brute_score(model, toxicity.terms(texts[i]).tolist()), abs=1e-9) and predicted == int(score >= 0.5)
    by = {i: s for i, s, _ in got}
    assert by[5000] == by[5001] == pytest.approx(1 / (1 + np.exp(-model.bias))) and by[5002] > 0.5
    assert np.mean([(by[i] >= 0.5) == (y == 1) for i, _, y in rows]) > 0.98
    # other orders and partitions give the same model, a smaller bound fewer texts
    again = toxicity.fit(docs.repartition(2), labels)
    assert np.array_equal(again.bins, model.bins) and np.allclose(again.weights, model.weights)
    assert len(toxicity.fit(docs, labels, rows=40).bins) < len(model.bins)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.predict(docs, model).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert toxicity.predict(some, toxicity.fit(some, labels)).select("score", "predicted").first() == pytest.approx((0.0, 0), abs=1e-9)


def test_held_out_rows(spark):
    """On rows that nothing was learnt from, most toxic texts are found and clean ones are left alone."""
    got = {r.doc_id: r for r in queries.QUERIES["op12_toxicity"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    found, said, real = (sum(f(p, y) for p, y in held) for f in (lambda p, y: p & y, lambda p, y: p, lambda p, y: y))
    assert found / real > 0.85 and found / said > 0.97
