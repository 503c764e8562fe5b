import numpy as np
import pytest

from keystrata.llm import ann
from keystrata.llm.queries import op8_nearest_neighbours


def brute(rows, k=20, every=20):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            scored = sorted((-ann.exact(a[None], b[None])[0], i) for i, b in fine if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, k=20, **more):
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double, id int")
    return sorted(map(tuple, ann.nearest(df, df.where("vec_id % 20 = 0"), k, **more).collect()))


@pytest.mark.parametrize("block", [4096, 2])
def test_against_brute_force(spark, block):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=16)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(400, [0.0] * 16), (420, None), (401, [None] + [1.0] * 15), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (None, [1.0] * 16), (440, [float(np.float32(1e-30))] * 16), (404, [float(np.float32(1e30))] * 16)]
    assert run(spark, rows, block=block) == brute(rows)


def test_grid_lengths_and_repeated_queries(spark):
    r = np.random.default_rng(4)
    say = lambda n: [float(np.float32(x)) for x in r.normal(size=n)]
    rows = [(i, say(8)) for i in range(130)] + [(200 + i, say(5)) for i in range(50)] + [(900, say(3))]
    short, long = ([x for x in rows if len(x[1]) == n] for n in (5, 8))
    want = sorted(brute(short, 7) + brute(long, 7))
    for block, tile in ((3, 10), (1000, 1000), (1, 40)):
        assert run(spark, rows, 7, block=block, tile=tile) == want
    again = long + [rows[0], rows[0]]  # one query, three candidates; its own id is left out, however often it is there
    assert run(spark, short + again, 200, block=3, tile=10) == sorted({*brute(again, 200), *brute(short, 200)})
    other = (0, say(8))
    found = run(spark, rows + [other], 7, tile=10)
    assert sorted(x for x in found if x[0] == 0) == sorted(x for q in (rows[0], other) for x in brute([q] + [y for y in long if y[0] != 0], 7) if x[0] == 0)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [1.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0, 2.0])]) == [] and run(spark, []) == []


def test_bounds_hold():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(50, 64)), r.normal(size=(80, 64)) * 10.0 ** r.integers(-6, 6, (80, 1))
    qa, sa, na, ea = ann.quantise(a)
    qb, sb, nb, eb = ann.quantise(b)
    near = (qa.astype(float) @ qb.T) * sa[:, None] * sb
    assert (np.abs(a @ b.T - near) <= (na + ea)[:, None] * eb + ea[:, None] * nb + 1e-12 * (1 + np.abs(near))).all()


def test_vectors_near_the_smallest_number():
    q, scale, norm, error = ann.quantise(np.array([[5e-324, 0.0], [1.0, 2.0]]))
    assert (scale > 0).all() and np.isfinite(norm).all() and np.isfinite(error).all() and not q[0].any()


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op8_nearest_neighbours(spark, sf_dir).collect())) == brute(rows)
