import hashlib
import random
import re

import numpy as np

from keystrata.llm import substring
from keystrata.llm.queries import op9_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=35):
    split = [WORD.findall(t or "") for _, t in docs]
    seen = {}
    for k, w in enumerate(split):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((k, i))
    hit = [set() for _ in docs]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                hit[k].update(range(i, i + window))
    out = []
    for (doc, _), w, h in zip(docs, split, hit):
        kept = " ".join(x for i, x in enumerate(w) if i not in h)
        out.append((doc, len(w), len(h), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, **more):
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in docs], "doc_id long, text string, hash int, row_key int, spans int")
    return sorted(map(tuple, substring.digest(substring.locate(df, **more)).collect()), key=repr)


def test_sliding():
    r = np.random.default_rng(0)
    for width in range(1, 30):
        x = r.integers(0, 50, 60)
        assert substring.sliding(x, width).tolist() == [x[i : i + width].min() for i in range(61 - width)]


def test_automata_find_every_window_of_the_passages():
    """Passages are all that a shard knows; what it finds in texts equals a search for each of their windows."""
    r = random.Random(1)
    for window, phrase, v in ((7, 3, 4), (5, 2, 2), (6, 6, 3), (35, 12, 2)):
        say = lambda n: [f"w{r.randrange(v)}" for _ in range(n)]
        for _ in range(20):
            passages = [say(r.randint(window, 3 * window)) for _ in range(3)] + [["w0"] * window]
            texts = [say(r.randint(0, 60)) for _ in range(6)] + [say(9) + p[r.randrange(len(p)) :] + ["new"] + p[: r.randrange(len(p))] for p in passages] + [["w0"] * 90]
            shard = substring.Shard([" ".join(p) for p in passages], window, phrase)
            split = substring.words.Splitter(substring.words.WHITE, fold=False).split(substring.pa.array([" ".join(t) for t in texts]))
            got = shard.stream(split)
            known = {tuple(p[i : i + window]) for p in passages for i in range(len(p) - window + 1)}
            for k, t in enumerate(texts):
                want = {x for i in range(len(t) - window + 1) if tuple(t[i : i + window]) in known for x in range(i, i + window)}
                assert set(np.flatnonzero(got[split.bounds[k] : split.bounds[k + 1]]).tolist()) == want


def test_without_automata_nothing_is_found(spark, monkeypatch):
    p = " ".join(f"p{i}" for i in range(50))
    docs = [(1, f"a {p}"), (2, f"{p} b")]
    assert [x[2] for x in run(spark, docs)] == [50, 50]
    monkeypatch.setattr(substring.Shard, "stream", lambda self, split: np.zeros(len(split.hashes), dtype=bool))
    assert [x[2] for x in run(spark, docs)] == [0, 0]


def test_very_long_and_monotonous_texts(spark):
    r = random.Random(7)
    long = " ".join(f"v{r.randrange(10**6)}" for _ in range(400_000))
    assert len(long) > 2 << 20
    docs = [(1, long), (2, "x " + long[: len(long) // 2]), (3, "same " * 200_000), (4, "is onhe " * 50_000), (5, long[-3000:])]
    assert run(spark, docs) == brute(docs)


def test_against_brute_force(spark):
    r = random.Random(9)
    say = lambda n, v=400: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    passage, other = say(60), say(40)
    docs = [(i, say(r.choice([0, 1, 34, 35, 36, 90]))) for i in range(30)]
    docs += [(100 + i, f"{say(10)} {passage}\t{say(20)}") for i in range(6)]
    docs += [(200, f"{other} {say(5)} {other}"), (201, passage[: len(passage) // 2]), (202, None), (203, ""), (204, "Is onhe. " * 60), (205, " Is\nonhe." * 40), (206, say(300, 2)), (207, say(300, 2))]
    docs += [docs[3], docs[5], docs[5], (None, docs[100 % 30][1]), (208, f"{passage.upper()}"), (209, "\x0b".join(passage.split())), (210, "é\x85" + passage + " é")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs, window=5, phrase=2) == brute(docs, 5)


def test_several_automata(spark, monkeypatch):
    monkeypatch.setattr(substring, "PHRASES_AN_AUTOMATON", 2)
    monkeypatch.setattr(substring, "WINDOWS_A_SHARD", 20)
    monkeypatch.setattr(substring, "DOCUMENTS_A_TASK", 3)
    r = random.Random(2)
    docs = [(i, " ".join(f"w{r.randrange(9)}" for _ in range(60))) for i in range(12)]
    assert run(spark, docs, window=4, phrase=2) == brute(docs, 4)


def test_empty_table_and_cleaning(spark):
    assert run(spark, []) == []
    p = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"Start\n {p} \n end", "en", "s", 9), (2, f"{p}", "en", "s", 3), (3, "clean  text ", "en", "s", 12), (4, None, "en", "s", None)]
    out = {r.doc_id: r for r in substring.clean(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert set(out) == {1, 3, 4} and out[1].text == "Start\n  \n end" and out[1].n_chars == len(out[1].text)
    assert out[3].text == "clean  text " and out[3].n_chars == 12


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, op9_substring_dedup(spark, sf_dir).collect()), key=repr)
    assert got == brute(docs) and any(x[2] for x in got)


def test_cleaning_marks_and_cuts_in_one_python_step(spark):
    """Two steps in one stage would keep twice as many workers, with their memory, beside each executor."""
    p = " ".join(f"p{i}" for i in range(50))
    d = spark.createDataFrame([(1, f"a {p}", 9), (2, f"{p} b", 9)], "doc_id long, text string, n_chars long")
    out = substring.clean(d)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("a ", 2), 2: (" b", 2)}


def test_a_step_hands_back_what_its_task_took():
    """Freed small arrays stay in the heap of a worker, unless they are handed back when its task ends."""
    import os
    import re
    import subprocess
    import sys

    code = """if True:
        import re, sys
        import numpy as np
        from keystrata.llm import common
        def held():
            return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
        def step(batches):
            for b in batches:
                some = [np.ones(8000) for _ in range(3000)]
                keep.append(np.ones(8000))
                del some
                yield b
        keep = []
        before = held()
        assert list(common.lean(step, lambda x: x)(iter([1, 2]))) == [1, 2]
        print(held() - before)
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=60)
    assert re.fullmatch(r"-?\d+\s", out.stdout), out.stderr
    assert int(out.stdout) < 40
