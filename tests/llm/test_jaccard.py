import random
import re

import pytest

from keystrata.llm import jaccard
from keystrata.llm.components import components
from keystrata.llm.queries import op5_ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(docs)), key=repr)


def run(spark, docs):
    df = spark.createDataFrame([(a, b, 1, 2, 3, 4) for a, b in docs], "doc_id long, text string, class int, n int, row_key int, token int")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=repr)


def edit(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


def corpus(seed):
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(300)}" for _ in range(n)]
    docs = [" ".join(say(r.choice([1, 2, 4, 5, 6, 30, 80]))) for _ in range(25)]
    for size in (20, 60, 150):  # chains and clouds of copies around the limit
        base = say(size)
        for _ in range(14):
            docs.append(" ".join(base))
            base = edit(r, base, r.choice([0, 1, 1, 2, 3]))
        base = say(size)
        docs += [" ".join(edit(r, base, r.randint(0, max(1, size // 25)))) for _ in range(14)]
        docs += [" ".join(base[: size * f // 100]) for f in range(60, 101, 4)]
    passage = say(40)
    docs += [" ".join(say(12) + passage) for _ in range(12)] + [" ".join(passage).upper(), " ".join(passage)]
    docs += ["Is onhe. " * r.randint(3, 40) for _ in range(8)] + ["the same", "The  SAME", "the", "a\x0bb", "é b", "É b"]
    out = [(i, t) for i, t in enumerate(docs)]
    r.shuffle(out)
    return out + [(900, None), (901, ""), (902, " \n"), out[0], (None, out[1][1]), (None, "quite alone here"), out[3], out[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(jaccard, "GROUP", 3)
        monkeypatch.setattr(jaccard, "QUERIES_A_TASK", 2)
    docs = corpus(seed)
    assert run(spark, docs) == brute(docs)


def test_comparisons_of_unlinked_near_copies(spark, monkeypatch):
    """Near copies that hardly link: the (class, part) pairs grow with the copies, not with their square."""
    asked = []
    inner = jaccard.verify

    def counted(members, queries, *rest):
        asked.append(queries.count())
        return inner(members, queries, *rest)

    monkeypatch.setattr(jaccard, "verify", counted)
    for n in (100, 200, 400):
        r = random.Random(5)
        base = [f"w{i}" for i in range(150)]
        docs = [(i, " ".join(edit(r, base, 6))) for i in range(n)]
        got = run(spark, docs)
        assert n > 100 or got == brute(docs)
        assert len({c for *_, c in got}) > n / 2  # most link with none
    assert asked[0] <= 200 and asked[1] <= 2.5 * asked[0] and asked[2] <= 2.5 * asked[1]


def test_very_long_texts(spark):
    r = random.Random(3)
    long = [f"w{r.randrange(10**5)}" for _ in range(900_000)]
    docs = [(1, " ".join(long)), (2, " ".join(edit(r, long, 9_000))), (3, " ".join(long[:600_000])), (4, "short text of six words here")]
    assert len(docs[0][1]) > 5 << 20
    assert [(d, c) for d, _, c in run(spark, docs)] == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + r.randrange(1, 60)) for _ in range(30)] + [(7, 7), (-5, 300), (300, -5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[300] == -5 and all(got[b] == 100 for a, b in edges if a == 100)


def test_keep_one_and_empty(spark):
    assert run(spark, []) == []
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(3, t), (1, t + " x"), (2, "other text"), (4, None), (5, ""), (6, None), (3, t)]
    docs = spark.createDataFrame([(*r, "en", "s", 4) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 2, 4, 5, 6]


def test_keep_one_of_null_and_repeated_ids(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "tu")
    rows = [(1, t), (None, t), (None, t + " x"), (7, u), (7, u + " x"), (None, "alone here"), (7, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((repr(r.doc_id), r.text[:2]) for r in jaccard.keep_one(docs).collect())
    assert kept == [("1", "t0"), ("7", "an"), ("7", "u0"), ("None", "al")]


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, op5_ngram_jaccard_join(spark, sf_dir).collect()), key=repr)
    assert got == brute(docs)
    assert any(a != c for a, _, c in got)
