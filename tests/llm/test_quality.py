import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from keystrata.llm import quality, words
from keystrata.llm.queries import op4_quality

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, quality int"


def corpus(n=700):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(r.choice("etaoinsh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 150))]
        good = i % 4 != 0
        if not good:
            kind = i % 3
            w = [x + r.choice(["***", "%%%"]) for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [y for x in w for y in (x, "|")]
        docs.append((i, " ".join(w), "extra"))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in quality.score(d, quality.fit(d, la)).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 90 and sum(got[i].predicted == t for i, t in held) / len(held) > 0.97


def test_pairs_recover_the_order():
    r = np.random.default_rng(2)
    x = r.normal(size=(800, 3))
    strength = x @ np.array([2.0, -1.0, 0.0])
    y = (strength + r.normal(scale=0.3, size=800) > -0.8).astype(np.int64)
    model = quality.learn(x, y)
    assert np.corrcoef(model.strength(x), strength)[0, 1] > 0.98
    share = (model.score(x) >= quality.THRESHOLD).mean()
    assert abs(share - y.mean()) < 0.01  # the threshold is that quantile


def test_measures_of_a_text_stand_alone():
    texts = ["Some text, twice. Some text!", None, "", "A | B | C", "é é", "x" * 5000]
    s = words.Splitter(words.WHITE, fold=False)
    together = quality.measures(s.split(pa.array(texts)))
    for t, row in zip(texts, together):
        assert np.allclose(quality.measures(s.split(pa.array([t], pa.string())))[0], row)


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 1), (2, 5)], [(1, 0), (3, 0)], [(1, 1), (3, 0), (1, 0), (7, 1)]])
def test_cases(spark, labels):
    docs = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "fine text", "x"), (None, "word " * 30000, None)]
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = quality.fit(d, la)
    rows = quality.score(d, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.score(d.limit(0), model).count() == 0
    quality.fit(d.limit(0), la)


def test_query(spark, sf_dir):
    rows = op4_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_all_pairs_count():
    """The weights are those of the mean logistic loss over every pair of a good and a poor row, written out."""
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 4))
    y = (x @ np.array([1.5, -1.0, 0.5, 0.0]) + r.normal(scale=0.5, size=300) > -0.7).astype(np.int64)
    model = quality.learn(x, y)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 4)
    lost = 1 / (1 + np.exp(d @ model.weights))
    assert np.abs(lost @ d / len(d) - quality.RIDGE * model.weights).max() < 1e-5
    s = model.strength(x)
    assert abs(model.threshold - np.quantile(s, (y == 0).mean())) < 1e-9


def test_every_labelled_row_teaches(spark, monkeypatch):
    """More labelled documents than any bound there was: the model is that of all of them in one place."""
    docs, labels = corpus(300)
    more = [(1000 + i, f"{'Fine' if i % 3 else 'POOR!!'} {i} text{'.' * (i % 7)} {'|' * (i % 5)}", "extra") for i in range(26_500)]
    docs, labels = docs + more, labels + [(i, int(t.startswith("Fine"))) for i, t, _ in more]
    d, la = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    monkeypatch.setattr(quality, "HELD_STRENGTHS", 20)
    model = quality.fit(d, la)
    truth = {i: t for i, t in labels if zlib.crc32(str(i).encode()) % 5 != 0}
    assert len(truth) > 21_000
    x = quality.measures(words.Splitter(words.WHITE, fold=False).split(pa.array([t for i, t, _ in docs if i in truth])))
    y = np.array([truth[i] for i, *_ in docs if i in truth])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.spread, np.maximum(x.std(axis=0), 1e-6))
    want = quality.learn(x, y)
    assert np.allclose(model.strength(x), want.strength(x), atol=1e-3)
    assert abs(model.threshold - np.quantile(model.strength(x), (y == 0).mean())) < 1e-9 and abs(model.scale - want.scale) < 1e-3 * want.scale
    both = {r.doc_id: r.score for r in quality.rate(d, la).collect()}
    assert np.allclose([both[i] for i, *_ in docs[:400]], model.score(quality.measures(words.Splitter(words.WHITE, fold=False).split(pa.array([t for _, t, _ in docs[:400]])))), atol=1e-4)
