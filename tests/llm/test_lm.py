import math
import re
import zlib
from collections import Counter

import numpy as np

from keystrata.llm import lm
from keystrata.llm.queries import op1_lm_scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def brute_base(docs, training):
    c = Counter(t for _, x in training for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = []
    for d, x in docs:
        w = tokens(x)
        out.append((d, len(w), sum(c[t] > 0 for t in w), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)))
    return out


def compare(got, want):
    key = lambda r: (repr(r[0]), r[1], r[2])
    got, want = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose(sorted(g[4] for g in got), sorted(w[4] for w in want))


def test_query_against_brute_force_and_better_than_the_base(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op1_lm_scoring(spark, sf_dir).collect()
    compare(got, brute_base(docs, [x for x in docs if zlib.crc32(str(x[0]).encode()) % 7 != 2]))
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_head_and_tail_give_the_same(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 50))) for i in range(60)] + [(7, None), (8, ""), (None, "w1 new"), (3, "W1 w1"), (3, "W1 w1")]
    df = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, hash int, score double")
    training = df.where("doc_id < 40 or doc_id is null")
    want = brute_base(docs, [d for d in docs if d[0] is None or d[0] < 40])
    full = lm.score(df, training).collect()
    compare(full, want)
    monkeypatch.setattr(lm, "HEAD", 5)
    compare(lm.score(df, training).collect(), want)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lm.score(df.limit(0), df).count() == 0
    rows = lm.score(df, df.limit(0)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 0, 0), (3, 0, 0)]


def test_probabilities_are_normalised():
    r = np.random.default_rng(0)
    line = [int(x) for x in r.integers(0, 5, 4000)]
    for i in range(1, 4000):
        line[i] = (line[i - 1] + 1) % 5 if r.random() < 0.9 else line[i]
    numbers = [(lm.CLASSES * a + b) * lm.CLASSES + c for a, b, c in zip(line, line[1:], line[2:])]
    number, n = np.unique(numbers, return_counts=True)
    table = lm.train(number, n.astype(float)).astype(float)
    assert np.allclose((10**table).sum(axis=1), 1, atol=1e-4)
    assert 10 ** table[0 * lm.CLASSES + 1, 2] > 0.6  # learned: 2 follows 1
    assert np.allclose((10 ** lm.train(np.zeros(0, dtype=np.int64), np.zeros(0)).astype(float)).sum(axis=1), 1, atol=1e-4)


def test_contexts_that_are_rare_in_a_large_corpus_are_learned():
    c = lm.CLASSES
    common = [((a * c + b) * c + t, 1e5) for a in range(5) for b in range(5) for t in range(5)]
    rare = [((b * c + b) * c + b + 1, 3.0) for b in range(20, 60)]  # each about one token in four millions
    number, n = zip(*sorted(common + rare))
    table = lm.train(np.array(number), np.array(n))
    assert min(table[number // c, number % c] - np.log10(k / sum(n)) for number, k in rare) > 3  # over 1000 times its share


def test_words_of_one_ending_have_vectors_of_their_own(spark):
    common = [f"w{i}" for i in range(lm.WORDS)]
    rows = [(f"{w} {v}",) for w, v in zip(common, common[1:]) for _ in range(12)] + [("w1 coming",), ("w2 going",)] * 10
    training = spark.createDataFrame(rows, "text string")
    asked = spark.createDataFrame([(i, f"w{i} {w}") for i in (1, 2) for w in ("coming", "going", "thing")], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.score for r in lm.score(asked, training, ("doc_id", "text")).collect()}
    assert got[1, "w1 coming"] > got[1, "w1 going"] + 0.3 and got[2, "w2 going"] > got[2, "w2 coming"] + 0.3
    learned = lm.fit_words(np.array([[3.0] + [0] * (lm.CLASSES - 1)]), np.array([3]), np.array([0]), np.array([0.5]), np.full((1, lm.CLASSES), 0.1), np.eye(lm.CLASSES))
    assert learned[0, 0] > 0 > learned[0, 1]


def test_score_from_the_model_token_by_token(spark, sf_dir, monkeypatch):
    """Scores recomputed from the trained parameters in plain Python; each word's chances sum to one."""
    sent, learned = [], []
    send, learn = lm.send, lm.learn_words
    monkeypatch.setattr(lm, "HEAD", 300)  # so that most words come by the join
    monkeypatch.setattr(lm, "send", lambda spark, value: (sent.append(value), send(spark, value))[1])
    monkeypatch.setattr(lm, "learn_words", lambda *a: (learned.append(learn(*a)), learned[-1])[1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "never seen words"), (-2, None)], "doc_id long, text string"))
    training = lm.training_part(docs)
    got = {r.doc_id: r.score for r in lm.score(docs, training).collect()}
    lexicon, table, contexts, log_sums, mass, total, distinct, ends = next(x for x in sent if isinstance(x, tuple) and len(x) == 8)
    weights = {r.hash: np.array(r.weights, dtype=float) for r in learned[0].select("hash", "weights").collect()}
    counts = {r.hash: (r.n, r.ending) for r in lm.count_words(training).collect()}
    heads = {h: c for h, c in zip(lexicon.hashes.view(np.int64).tolist(), lexicon.classes.tolist()) if c >= 0}
    zero = np.zeros(contexts.shape[1])
    for doc_id, text in [(r.doc_id, r.text) for r in docs.collect()]:
        split = lm.splitter().split(lm.pa.array([text], lm.pa.string()))
        two = one = lm.START
        want = 0.0
        for h, e in zip(split.hashes.view(np.int64).tolist(), lm.ending(split).tolist()):
            c = heads.get(h, lm.WORDS + e)
            want += float(table[two * lm.CLASSES + one, c])
            if c >= lm.WORDS:
                n = counts.get(h, (0, 0))[0]
                want += math.log10((n + 1) / mass[e]) + float(weights.get(h, zero) @ contexts[one]) / math.log(10) - log_sums[e, one]
            two, one = one, c
        want += float(table[two * lm.CLASSES + one, lm.END])
        assert abs(got[doc_id] - want) < 1e-3 + 1e-5 * abs(want), doc_id
    for e in (0, 7):
        own = [(n, weights[h]) for h, (n, x) in counts.items() if x == e and h not in heads]
        for before in (0, 50, lm.START):
            sums = 1 / mass[e] + sum((n + 1) / mass[e] * math.exp(w @ contexts[before]) for n, w in own)
            assert abs(math.log10(sums) - log_sums[e, before]) < 1e-4
