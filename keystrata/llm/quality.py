"""Quality by Bradley-Terry ranking.

Measures of a text (shares of kinds of characters, word shapes, repetition) are taken once and stored. All labelled
documents outside the held-out fold teach: in every pair of a good and a poor document the good one is to win, and
the mean logistic loss over all these pairs is minimised by Newton steps. A pair's share in a step hangs on the difference
of two strengths only, so two passes make a step: one counts the strengths of each kind on a grid of 1/``GRID``
(between two points of it both get their part, which moves a pair's share by less than 1e-5), one sums what each
document adds against the whole other kind. Each task sends sums, no rows. A text's strength is its weighted
sum. The threshold is the quantile of the training strengths at the share of poor documents, to the row; the
strength above it, scaled by a logistic fit, is the score, which is 0.3 at the threshold.

Defined cases: null and empty texts are measured as texts without characters; labels that are null or
neither 0 nor 1 teach nothing, repeated labels of an id count once (1 before 0); of several texts of a labelled id
that of the smallest hash teaches, and copies of a text once; with labels of one kind only, every
document gets the score 1 or 0 of that kind, without labels 0.5; repeated rows each get the same score;
documents of equal strength get equal scores, and pairs are of one good and one poor document only, so ties
teach nothing; a text of any length is measured whole, as one chunk of its own; an empty table of documents
gives an empty result, an empty training part the model without labels; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import chunks, prepare, received, remainder, send, settle

THRESHOLD = 0.3
#: Points of the strengths' grid and of the coarser one of second derivatives, to a unit.
GRID, COARSE = 128, 8
#: Weight of the squares of the weights, and of the scale; Newton steps at most.
RIDGE, SCALE_RIDGE, STEPS = 1e-4, 1e-3, 60
#: Strengths that the driver may hold to find a quantile, and parts that a range is cut into until so few are left.
HELD_STRENGTHS, CUTS = 1000, 4096
#: Kinds of bytes that are counted apart.
KINDS = {
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "blank": b" \t",
    "line": b"\n\r",
    "stop": b".",
    "comma": b",;:",
    "loud": b"!?",
    "quote": b"\"'`()",
    "bar": b"|",
    "angle": b"<>{}[]\\/=",
    "mark": b"#$%&*+@^_~-",
    "other": bytes(range(128, 256)),
}


def basic(split: words.Words) -> np.ndarray:
    """One row for each text of the measures that all others follow from, shares of kinds first."""
    data, bounds, n = split.data, split.offsets, len(split.offsets) - 1
    kind = np.zeros(256, dtype=np.int64)
    for i, held in enumerate(KINDS.values(), 1):
        kind[list(held)] = i
    text = np.repeat(np.arange(n), np.diff(bounds))
    size = np.maximum(np.diff(bounds), 1)
    counts = np.bincount(text * (len(KINDS) + 1) + kind[data], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    shares = counts[:, 1:] / size[:, None]
    many = np.maximum(split.counts, 1)
    row, length = split.rows(), split.ends - split.starts
    per_word = lambda x: np.bincount(row, weights=x, minlength=n) / many
    order = np.lexsort((split.hashes, row))
    a, h = row[order], split.hashes[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])))[: len(a)]
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(a)))
    top = np.zeros(n)
    np.maximum.at(top, a[heads], runs)
    pairs, first = words.shingle_hashes(split.hashes, 3), words.inside_runs(split.bounds, 3)
    key = np.stack((np.searchsorted(split.bounds, first, side="right") - 1, pairs[first].view(np.int64))) if len(first) else np.zeros((2, 0), dtype=np.int64)
    triples = np.bincount(np.unique(key, axis=1)[0], minlength=n) if len(first) else np.zeros(n)
    first_byte = data[split.starts] if len(split.starts) else np.zeros(0, dtype=np.uint8)
    last_byte = data[split.ends - 1] if len(split.ends) else np.zeros(0, dtype=np.uint8)
    marks = kind[last_byte] >= list(KINDS).index("bar") + 1
    columns = [
        np.log1p(np.minimum(split.counts, 5000)),
        per_word(np.minimum(length, 40)),
        np.sqrt(per_word(np.minimum(length, 40).astype(float) ** 2)),
        np.bincount(a[heads], minlength=n) / many,
        top / many,
        triples / np.maximum(split.counts - 2, 1),
        per_word(length == 1),
        per_word(length > 20),
        per_word((first_byte >= 65) & (first_byte < 91)),
        per_word(marks & (last_byte < 128)),
        per_word(kind[last_byte] == list(KINDS).index("loud") + 1),
    ]
    return np.column_stack((shares, *columns))


def derived(x: np.ndarray) -> np.ndarray:
    """All measures from the basic ones."""
    shares = x[:, : len(KINDS)]
    return np.column_stack((x, np.sqrt(shares), shares > 0.02))


def measures(split: words.Words) -> np.ndarray:
    """One row of measures for each text."""
    return derived(basic(split))


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    constant: float | None = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.scale * (self.strength(x) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


#: Sums over all training rows of what a function makes of measures and labels: arrays, or dicts of arrays by number.
Total = Callable[[Callable[[np.ndarray, np.ndarray], tuple]], tuple]


def added(a, b):
    if isinstance(a, dict):
        return a | {k: a[k] + v if k in a else v for k, v in b.items()}
    return a + b


def on_grid(s: np.ndarray) -> dict[int, float]:
    """Counts at the points of the grid; between two points each gets its part."""
    low = np.floor(s * GRID).astype(np.int64)
    part = s * GRID - low
    point, at = np.unique(np.concatenate((low, low + 1)), return_inverse=True)
    return dict(zip(point.tolist(), np.bincount(at, weights=np.concatenate((1 - part, part)), minlength=len(point)).tolist()))


def against(counts: dict[int, float], low: int, high: int, step: int, kernel) -> np.ndarray:
    """For each point of the grid from low to high: the sum of kernel(other - own) over what is counted."""
    n = high - low + 1
    held = np.zeros(n)
    held[np.fromiter(counts, dtype=np.int64) - low] = list(counts.values())
    size = 1 << (3 * n).bit_length()
    values = kernel(np.arange(-n + 1, n)[::-1] / step)
    return np.fft.irfft(np.fft.rfft(held, size) * np.fft.rfft(values, size), size)[n - 1 : 2 * n - 1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def slope(x: np.ndarray) -> np.ndarray:
    p = sigmoid(x)
    return p * (1 - p)


def learn_from(total: Total) -> Model:
    n, n_good, sums = total(lambda x, y: (len(y), int(y.sum()), x.sum(axis=0))) or (0, 0, 0)
    n_poor = n - n_good
    if not n_good or not n_poor:
        zero = np.zeros(1)
        return Model(zero, zero + 1, zero, 0.0, 1.0, float(n_good > 0) if n else 0.5)
    centre = sums / n
    (squares,) = total(lambda x, y: (((x - centre) ** 2).sum(axis=0),))
    model = Model(centre, np.maximum(np.sqrt(squares / n), 1e-6), np.zeros(len(centre)), 0.0, 1.0)
    for _ in range(STEPS):
        step = newton_step(total, model, n_good * n_poor)
        model.weights = model.weights - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    model.threshold = quantile(total, model, n, n_poor / n)
    model.scale = max(0.05, fit_scale(total, model, n))
    return model


def newton_step(total: Total, model: Model, pairs: int) -> np.ndarray:
    """Of the mean loss over all pairs. Second derivatives take each strength at the nearest point of a coarse grid,
    the same for all terms, so that they stay those of a convex function."""
    near = lambda s: np.rint(s * COARSE).astype(np.int64)

    def count(x, y):
        s = model.strength(x)
        coarse = [dict(zip(*(v.tolist() for v in np.unique(near(s[y == k]), return_counts=True)))) for k in (0, 1)]
        return on_grid(s[y == 0]), on_grid(s[y == 1]), *coarse

    poor, good, poor_near, good_near = total(count)
    low, high = min(*poor, *good), max(*poor, *good)
    loses = against(poor, low, high, GRID, sigmoid), against(good, low, high, GRID, lambda d: sigmoid(-d))
    first, last = min(*poor_near, *good_near), max(*poor_near, *good_near)
    bends = against(poor_near, first, last, COARSE, slope), against(good_near, first, last, COARSE, slope)
    points = np.arange(low, high + 1) / GRID

    def add(x, y):
        s = model.strength(x)
        z = np.clip((x - model.centre) / model.spread, -8, 8)
        gradient, own, sums = np.zeros(z.shape[1]), np.zeros((z.shape[1], z.shape[1])), ({}, {})
        for kind, sign in ((1, -1), (0, 1)):  # a good document against all poor ones, and the reverse
            mine, at = z[y == kind], near(s[y == kind])
            gradient += sign * (np.interp(s[y == kind], points, loses[1 - kind]) @ mine)
            own += (mine * np.maximum(bends[1 - kind][at - first], 0)[:, None]).T @ mine
            for b in np.unique(at).tolist():
                sums[kind][b] = mine[at == b].sum(axis=0)
        return gradient, own, *sums

    gradient, own, poor_sums, good_sums = total(add)
    a, b = (np.stack([d[k] for k in d]) for d in (good_sums, poor_sums))
    at_a, at_b = np.array([*good_sums]), np.array([*poor_sums])
    cross = sum(a[i : i + 256].T @ (slope((at_a[i : i + 256, None] - at_b) / COARSE) @ b) for i in range(0, len(a), 256))
    second = (own - cross - cross.T) / pairs
    return np.linalg.solve(second + (RIDGE + 1e-9) * np.eye(len(second)), gradient / pairs + RIDGE * model.weights)


def quantile(total: Total, model: Model, n: int, share: float) -> float:
    """Of all strengths, between the two rows next to the share."""
    at = share * (n - 1)
    below = int(np.floor(at))
    values = [ranked(total, model, k) for k in (below, min(below + 1, n - 1))]
    return float(values[0] + (values[1] - values[0]) * (at - below))


def ranked(total: Total, model: Model, k: int) -> float:
    """The strength that k others stand before: its range is cut until few rows are left in it."""
    low, high, before, left = -np.inf, np.inf, 0, None
    while True:
        inside = lambda x: (s := model.strength(x))[(s >= low) & (s <= high)]
        (ends,) = total(lambda x, y: ({0: Least(s.min(), s.max(), len(s))} if len(s := inside(x)) else {},))
        low, high, left = ends[0].low, ends[0].high, ends[0].n
        if low == high:
            return float(low)
        if left <= HELD_STRENGTHS:
            (held,) = total(lambda x, y: ({0: Joined(inside(x))},))
            return float(np.sort(held[0].values)[k - before])
        edges = np.linspace(low, high, CUTS + 1)
        (counts,) = total(lambda x, y: (np.bincount(np.minimum(np.searchsorted(edges, inside(x), side="right") - 1, CUTS - 1), minlength=CUTS),))
        upto = np.cumsum(counts)
        cut = int(np.searchsorted(upto, k - before, side="right"))
        before += int(upto[cut - 1]) if cut else 0
        low, high = edges[cut], high if cut == CUTS - 1 else np.nextafter(edges[cut + 1], -np.inf)


@dataclass
class Least:
    """Least, greatest and number of values."""

    low: float
    high: float
    n: int

    def __add__(self, other: Least) -> Least:
        return Least(min(self.low, other.low), max(self.high, other.high), self.n + other.n)


@dataclass
class Joined:
    values: np.ndarray

    def __add__(self, other: Joined) -> Joined:
        return Joined(np.concatenate((self.values, other.values)))


def fit_scale(total: Total, model: Model, n: int) -> float:
    """The slope of a logistic curve from strengths above the threshold to labels."""
    w, penalty = np.zeros(2), np.array([SCALE_RIDGE, 1e-6])

    def add(x, y):
        z = np.column_stack((model.strength(x) - model.threshold, np.ones(len(y))))
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        return z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z

    for _ in range(STEPS):
        gradient, second = total(add)
        step = np.linalg.solve(second / n + np.diag(penalty + 1e-12), gradient / n + penalty * w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0])


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """From measures and labels."""
    return learn_from(lambda f: f(x, y) if len(y) else ())


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep (as keep_0 and so on), hash (of the text) and x, the basic measures."""
    prepare(docs)
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.xxhash64("text").alias("hash"), F.col("text").alias("text"))

    def run(batches):
        s = words.Splitter(words.WHITE, fold=False)
        for batch in chunks(batches, "text"):
            x = basic(s.split(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), batch.column("hash"), lists], [*names, "hash", "x"])

    schema = rows.select(*names, "hash").withColumn("x", F.array(F.lit(0.0))).schema
    return rows.mapInArrow(run, schema)


def matrix(lists: pa.Array) -> np.ndarray:
    """All measures from a column of basic ones."""
    return derived(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1))


def training_part(found: DataFrame, labels: DataFrame, divisor: int, held: int) -> DataFrame:
    """(x, label) of all labelled documents outside the held-out fold, from measured(docs)."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder("doc_id", divisor) != held))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    rows = found.select(F.col("keep_0").alias("doc_id"), "hash", "x").join(chosen, "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("hash").alias("hash"), F.min_by("x", "hash").alias("x"), F.max("label").alias("label"))
    return one.groupBy("hash").agg(F.any_value("x").alias("x"), F.max("label").alias("label")).sortWithinPartitions("hash").select("x", "label")


def totals(train: DataFrame) -> Total:
    """Sums over a stored training part; a task sends one row."""

    def total(f):
        shared = send(train.sparkSession, f)

        def run(batches):
            g, sums = received(shared), None
            for batch in batches:
                if batch.num_rows:
                    part = g(matrix(batch.column("x")), batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64))
                    sums = part if sums is None else tuple(map(added, sums, part))
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(sums)], pa.binary())], ["sums"])

        out: tuple = ()
        for r in train.mapInArrow(run, "sums binary").collect():  # one row a task
            part = pickle.loads(r.sums)
            out = tuple(map(added, out, part)) if out else part
        shared.destroy()
        return out

    return total


def fit(docs: DataFrame, labels: DataFrame, divisor: int = 5, held: int = 0) -> Model:
    return fit_measured(measured(docs), labels, divisor, held)


def fit_measured(found: DataFrame, labels: DataFrame, divisor: int = 5, held: int = 0) -> Model:
    return learn_from(totals(settle(training_part(found, labels, divisor, held))))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, score and predicted."""
    return score_measured(measured(docs, keep), model, keep)


def score_measured(found: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    shared = send(found.sparkSession, model)
    names = [f"keep_{i}" for i in range(len(keep))]

    def run(batches):
        m = received(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(m.score(matrix(batch.column("x"))), pa.float64())], [*names, "quality_score"])

    schema = found.select(*names).withColumn("quality_score", F.lit(0.0)).schema
    out = found.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def rate(docs: DataFrame, labels: DataFrame, divisor: int = 5, held: int = 0) -> DataFrame:
    """doc_id, score and predicted of all documents, by a model of the labelled ones; texts are measured once."""
    found = settle(measured(docs))
    return score_measured(found, fit_measured(found, labels, divisor, held))
