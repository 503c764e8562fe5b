import hashlib
import random
import re

import numpy as np

from keystrata.llm import decontam
from keystrata.llm.fmindex import FMIndex
from keystrata.llm.queries import op10_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    wins = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(-1 if item is None else item)
    sizes = sorted({len(p) for p in wins})
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[p]
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_index_finds_every_occurrence():
    r = np.random.default_rng(4)
    for _ in range(60):
        n, sigma = int(r.integers(1, 200)), int(r.integers(2, 6))
        text = np.append(r.integers(0, sigma, n), 0)
        index = FMIndex(text, sigma)
        size = int(r.integers(1, 5))
        patterns = r.integers(1, sigma, (20, size))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            got = sorted(index.locate(np.arange(a, b)).tolist()) if a < b else []
            assert got == want


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, items int, spans int")
    b = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, decontam.digest(decontam.find(d, b, **more)).collect()), key=repr)


def test_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["a", "b", "Ça", "x1", "été", "the"]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 3, 13, 14, 30]))) for i in range(1, 30) if i % 7] + [(100, None), (None, say(20)), (5, say(4))]
    items = [x for x in items if len(words_of(x[1])) != 1]
    docs = [(i, say(r.choice([0, 2, 12, 40, 200]))) for i in range(60)]
    docs += [(200 + k, say(30) + " qq " + t.upper() + "; " + say(30)) for k, (_, t) in enumerate(items) if t] + [(300, None), (301, ""), (302, "...")]
    docs += [docs[5], docs[-4], (None, docs[30][1])]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, shard_words=20, stretch=16) == want  # many shards, split stretches and passages
    single = [*items, (6, "été"), (8, "X1."), (9, "été")]
    assert run(spark, docs, single) == brute(docs, single)
    assert run(spark, docs, single, shard_words=20, stretch=13) == brute(docs, single)


def test_empty_tables_and_no_patterns(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    docs = [(1, "a b"), (2, None)]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, docs, [(1, "..."), (2, None)]) == brute(docs, [])


def test_cleaning(spark):
    leak = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"Keep, this. {leak}! And that.", "en", "s", 9), (2, "clean text", "en", "s", 10), (3, leak, "en", "s", 1), (4, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in decontam.clean(docs, spark.createDataFrame([(7, leak)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 4}
    assert out[1].text == "Keep, this. ! And that." and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean text" and out[4].text is None


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = op10_decontamination(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)
    assert any(r.contaminated for r in got)
