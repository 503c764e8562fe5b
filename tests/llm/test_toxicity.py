import random
import zlib

import numpy as np
import pytest

from keystrata.llm import toxicity
from keystrata.llm.queries import op6_toxicity


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition: the best segment, then left and right."""
    best, at = 0.0, None
    for i in range(len(scores)):
        s = 0.0
        for j in range(i, len(scores)):
            s += scores[j]
            if s > best + 1e-12 or (at and abs(s - best) <= 1e-12 and j - i < at[1] - at[0] - 1):
                best, at = s, (i, j + 1)
    if at is None:
        return []
    left, right = brute_segments(scores[: at[0]]), brute_segments(scores[at[1] :])
    return left + [(*at, best)] + [(a + at[1], b + at[1], s) for a, b, s in right]


def test_segments_equal_the_definition():
    r = random.Random(4)
    for _ in range(300):
        n, loss = r.randint(1, 25), r.choice([0.13, 0.71, 1.37])
        at = sorted(r.sample(range(n), r.randint(0, n)))
        score = [r.uniform(0.1, 3) for _ in at]
        line = [-loss] * n
        for i, s in zip(at, score):
            line[i] = s
        got = toxicity.Model(loss=loss).segments(at, score)
        want = brute_segments(line)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def corpus(n=900):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{r.randrange(400)}" for _ in range(r.randint(5, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(1 + len(w) // 30):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", f"zarkle{r.randrange(300)}"]))
        docs.append((i, " ".join(w), "extra"))
        labels.append((i, int(bad)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, la)).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [got[i].predicted == truth[i] for i in held]
    assert len(held) > 150 and sum(right) / len(right) > 0.97
    assert all(got[i].segments for i in held if got[i].predicted)
    kept = {r.doc_id for r in toxicity.reject(d, la).collect()}
    assert kept == {i for i in got if not got[i].predicted}


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(300)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    d = spark.createDataFrame(docs, DOCS)
    a, b = (toxicity.fit(d, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert (a.parts == b.parts).all() and np.allclose(a.weights, b.weights)


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 1), (2, 5)], [(1, 0), (3, 0)], [(1, 1), (1, 0), (7, 1)]])
def test_cases(spark, labels):
    docs = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "idiot " * 3000, None)]
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(d, la)
    rows = toxicity.score(d, model).collect()
    assert len(rows) == 5 and all(0 <= r.toxicity <= 1 for r in rows)
    assert toxicity.score(d.limit(0), model).count() == 0
    assert toxicity.fit(d.limit(0), la).parts.size == 0


def test_query(spark, sf_dir):
    rows = op6_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)


def test_steps_are_linear():
    r = random.Random(8)
    n = 1_000_000
    falling = list(range(0, n, 40)), [0.1] * (n // 40)  # each sum is lower than all before it
    rising = list(range(0, n, 2)), [1.0, 0.2] * (n // 4)
    mixed = sorted(r.sample(range(n), 200_000)), [r.choice([0.1, 0.3, 3.0]) for _ in range(200_000)]
    for at, score in (falling, rising, mixed):
        model = toxicity.Model(loss=0.13)
        model.segments(at, score)
        assert model.steps <= 4 * len(at)


def test_constant_of_a_simulated_background():
    """Best scores drawn by the law of extreme values are given back their K."""
    r = np.random.default_rng(5)
    n, rate, k = r.integers(50, 400, 4000), 1.7, 0.04
    top = np.log(k * n / r.exponential(size=len(n))) / rate
    got = toxicity.fit_constant(np.column_stack((np.maximum(top, 0), n)), rate)
    assert abs(got - k) < 0.004
    assert toxicity.fit_constant(np.zeros((0, 2)), rate) == 0.1


def test_score_of_documents_from_their_segments(spark):
    """Every document's score, recomputed from the model by the definition of segments, token by token."""
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, DOCS)
    model = toxicity.fit(d, spark.createDataFrame(labels, LABELS))
    assert model.constant != 0.1 and len(model.parts)
    odds = dict(zip(model.parts.tolist(), model.scores.tolist()))
    got = {r.doc_id: r.toxicity for r in toxicity.score(d, model).collect()}
    for i, text, _ in docs[:60]:
        split = toxicity.splitter().split(toxicity.pa.array([text]))
        line = [-model.loss] * len(split.hashes)
        for at, hashes in toxicity.parts(split):
            for place, h in zip(at.tolist(), hashes.tolist()):
                line[place] = max(line[place], odds.get(h, -model.loss))
        each = [model.rate * s - np.log(model.constant * len(line)) for *_, s in brute_segments(line)]
        best = min(max(max(each) + 10, 0), 40) if each else 0.0
        total = np.log1p(sum(e for e in each if e > -np.log(toxicity.CHANCE)))
        a, b, c = model.weights
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(a * best + b * total + c, -35, 35)))) < 1e-9


def test_texts_of_one_id_teach_once(spark):
    d = spark.createDataFrame([(1, f"text number {i}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    la = spark.createDataFrame([(1, 1), (2, 0)], LABELS)
    assert toxicity.training_rows(d, la, "toxic", 4, 9).count() == 2


def test_every_labelled_row_teaches(spark):
    """More labelled documents than any bound there was: counts, constant and logistic curve are those of all of them."""
    docs, labels = corpus(400)
    more = [(1000 + i, f"w{i % 400} w{i % 397} w{i} {'zork' if i % 50 == 0 else 'calm'}", "extra") for i in range(28_000)]
    docs, labels = docs + more, labels + [(i, int("zork" in t)) for i, t, _ in more]
    d, la = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    truth = {i: t for i, t in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    texts: dict[str, int] = {}
    for i, text, _ in docs:
        if i in truth:
            texts[text] = max(truth[i], texts.get(text, 0))
    assert len(texts) > 21_000
    train = toxicity.training_rows(d, la, "toxic", 4, 2)
    assert {r.text: r.label for r in train.collect()} == texts
    model = toxicity.fit(d, la)
    scored = toxicity._evidence(train, model, ["label"]).collect()
    background = np.array([(r.top, r.n) for r in scored if not r.label])
    assert abs(toxicity.fit_constant(background, model.rate) - model.constant) < 1e-9
    x, y = np.array([(r.best, r.sum, 1.0) for r in scored]), np.array([r.label for r in scored])
    off = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -35, 35))) - y
    assert np.abs(off @ x / len(y) + np.array([1e-3, 1e-3, 1e-6]) * model.weights).max() < 1e-7  # no better weights
