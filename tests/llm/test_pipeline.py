import hashlib
import random

import pytest

import corpus_pipeline
from keystrata.llm import toxicity
from keystrata.llm.common import settle

from . import test_decontam, test_jaccard, test_substring


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(settle(stage(spark, frames[-1], sf_dir)))
        if stage is not corpus_pipeline.tokenise:
            assert frames[-1].columns == columns
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert texts[1] == {r.doc_id: texts[0][r.doc_id] for r in judged if not r.predicted}
    linked = test_jaccard.brute(sorted(texts[1].items()))
    assert texts[2] == {d: texts[1][d] for d, n, c in linked if n == 0 or d == c}
    words = test_substring.WORD.findall
    want = {d: (n, k, sha) for d, n, k, sha in test_substring.brute(list(texts[2].items()))}
    for d, (n, k, sha) in want.items():
        if k and k == n:
            assert d not in texts[3]
        elif k:
            assert hashlib.sha256(" ".join(words(texts[3][d])).encode()).hexdigest() == sha
        else:
            assert texts[3][d] == texts[2][d]
    assert set(texts[3]) == {d for d, (n, k, _) in want.items() if not k or k < n}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = {x[0]: x for x in test_decontam.brute(list(texts[3].items()), items)}
    for d, (_, n, k, *_) in hits.items():
        if k and k == n:
            assert d not in texts[4]
        elif k:
            assert len(test_decontam.words_of(texts[4][d])) == n - k
        else:
            assert texts[4][d] == texts[3][d]
    last = {r.doc_id: r for r in frames[-1].collect()}
    assert set(last) == set(texts[4])
    assert all(r.decoded_sha256 == hashlib.sha256((texts[4][d] or "").encode()).hexdigest() for d, r in last.items())


def test_run_is_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


CLASHES = "spans items n_words row_key hashes predicted segments toxicity score best sum top n carried held class component component_id token group part label doc text_ hash chosen shards phrase".split()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_defined_cases_of_every_stage(spark, sf_dir, stage):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns, an empty table."""
    r = random.Random(6)
    long = " ".join(f"v{r.randrange(10**6)}" for _ in range(620_000))
    assert len(long) > 4 << 20
    clean = [f"plain words number {i} " + " ".join(f"u{i}x{j}" for j in range(20)) for i in range(4)]
    texts = [(1, clean[0]), (2, clean[1]), (None, clean[2]), (3, None), (4, ""), (5, " \n"), (6, long), (7, clean[3]), (7, clean[3])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(i, t, None, "s", None if t is None else len(t), *(f"{c}-{i}" for c in CLASHES)) for i, t in texts]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, sf_dir)
    if stage is corpus_pipeline.tokenise:
        assert out.count() == len(rows) and stage(spark, docs.limit(0), sf_dir).count() == 0
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    found = out.collect()
    assert all(x[c] == f"{c}-{x.doc_id}" for x in found for c in CLASHES)
    kept = sorted((x.doc_id for x in found if x.doc_id is not None))
    if stage is corpus_pipeline.drop_near_copies:
        assert kept == [1, 2, 3, 4, 5, 6, 7]
    elif stage is corpus_pipeline.cut_repeats:
        assert kept == [1, 2, 3, 4, 5, 6, 7, 7]  # too short to be a window
    else:
        assert kept == [1, 2, 3, 4, 5, 6, 7, 7]
    assert {x.doc_id: x.text for x in found}[6] == long and any(x.text is None for x in found)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
