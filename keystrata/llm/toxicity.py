"""Toxicity by maximum-scoring segments.

Training counts, over all labelled documents outside the held-out fold,
in how many toxic and other documents each word, word beginning and word end occurs. Their log-odds
under a Dirichlet prior in proportion to overall frequency, with a z-score, decide which are significant.
A token scores the largest log-odds of its parts less ``z``-scaled doubt, any other token a small loss.

Scoring scans each text once: the linear-time algorithm for all maximal scoring segments works on the
positive tokens and the losses between them. A segment's score S over n tokens is judged by extreme-value
theory: about K n exp(-lambda S) segments that good are expected by chance. lambda follows from the scores and
frequencies of the parts in the training background, K from the best segments of its texts. A logistic curve over these turns them into the document's score.

Defined cases: null and empty texts have no segments and get the score of a text without any; labels that
are null or neither 0 nor 1 teach nothing, repeated labels of an id count once (1 before 0); without
usable labels every score is the share of toxic ones, or 0; of a repeated labelled id one text teaches, and repeated
rows each get the same score; very long texts are scanned whole, in steps linear in their tokens; of equal
sums before it a segment takes in the nearest only, so equal scores leave the shorter segment; an empty table of documents
gives an empty result, an empty training part a model that rejects nothing; other columns are ignored or, in
reject(), carried along untouched, and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import carried, chunks, lean, received, remainder, send, settle, prepare

#: Weight of the prior as a share of all counts; least z-score and toxic documents of a significant part.
PRIOR, LEAST_Z, LEAST_DOCUMENTS = 0.05, 3.0, 4
DOUBT = 1.0
CHANCE = 0.05
THRESHOLD = 0.3
#: Beginnings and ends of words that count as parts, in bytes.
HEADS, TAILS = (4, 5, 6), (4, 5)


def splitter() -> words.Splitter:
    return words.Splitter(words.NOT_ALNUM, fold=True)


def parts(split: words.Words):
    """For each kind of part: (the words that have it, hashes)."""
    size = split.ends - split.starts
    everything = np.arange(len(size))
    yield everything, split.hashes
    for k, (n, head) in enumerate([*((n, True) for n in HEADS), *((n, False) for n in TAILS)], 1):
        at = np.flatnonzero(size > n)
        a = split.starts[at] if head else split.ends[at] - n
        yield at, words.mix(split.part_hashes(a, a + n) + words.U(k))


@dataclass
class Model:
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=words.U))  # ascending
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loss: float = 0.05
    rate: float = 1.0  # lambda
    constant: float = 0.1  # K, as expected without a background
    weights: tuple[float, float, float] = (0.0, 0.0, -20.0)
    steps: int = 0  # that searches for segments have taken

    def token_scores(self, split: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the tokens with a significant part."""
        best = np.zeros(len(split.hashes))
        if len(self.parts):
            for at, hashes in parts(split):
                found = np.minimum(np.searchsorted(self.parts, hashes), len(self.parts) - 1)
                hit = self.parts[found] == hashes
                best[at[hit]] = np.maximum(best[at[hit]], self.scores[found[hit]])
        at = np.flatnonzero(best > 0)
        return at, best[at]

    def segments(self, at: list[int], score: list[float]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments of one text, as (first token, last token + 1, score). Each kept segment
        is linked to the last one before it whose sum before is smaller, and searches follow the links: what one
        search passes over, no later one meets again."""
        kept: list[tuple[int, int, float, float, int]] = []  # with the sums before and after, and the link
        total, upto = 0.0, None
        for i, s in zip(at, score):
            total -= self.loss * (i if upto is None else i - upto)
            start, before = i, total
            total, upto = total + s, i + 1
            j = len(kept) - 1
            while True:
                while j >= 0 and kept[j][2] >= before:
                    self.steps += 1
                    j = kept[j][4]
                self.steps += 1
                if j < 0 or kept[j][3] >= total:
                    kept.append((start, i + 1, before, total, j))
                    break
                start, _, before, _, link = kept[j]
                del kept[j:]
                j = link
        return [(a, b, z - y) for a, b, y, z, _ in kept]

    def surprise(self, score, n):
        """-ln of the number of segments of at least that score expected by chance in n tokens."""
        return self.rate * score - np.log(np.maximum(self.constant * n, 1e-9))

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """Surprise of the best segment, and summed surprise of all that chance hardly explains."""
        if not found or not n:
            return 0.0, 0.0
        each = self.surprise(np.array([s for _, _, s in found]), n)
        return float(np.clip(each.max() + 10, 0, 40)), float(np.log1p(each[each > -np.log(CHANCE)].sum()))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(evidence @ np.array([a, b]) + c, -35, 35)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held: int) -> DataFrame:
    """(text, label) of all labelled documents outside the held-out fold; of several texts of one id the one of the
    smallest hash. Texts are told apart by 64-bit hashes, and only the last join moves them."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", divisor) != held))
    chosen = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    one = rows.select("doc_id", "text_hash").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"), F.max("label").alias("label"))
    once = one.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))  # copies teach once
    found = rows.join(once, ["doc_id", "text_hash"])
    return found.groupBy("doc_id", "text_hash").agg(F.any_value("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def _counts(rows: DataFrame) -> DataFrame:
    """(part, toxic, other): the number of documents with a part."""

    def run(batches):
        s = splitter()
        for batch in chunks(batches, "text"):
            split = s.split(batch.column("text"))
            label = np.array(batch.column("label").to_pylist(), dtype=np.int64)
            row = split.rows()
            pairs = [np.zeros((2, 0), dtype=words.U)] + [np.stack((hashes, row[at].astype(words.U))) for at, hashes in parts(split)]
            part, text = np.concatenate(pairs, axis=1)
            order = np.lexsort((text, part))
            part, text = part[order], text[order]
            new = np.concatenate(([True], (part[1:] != part[:-1]) | (text[1:] != text[:-1])))[: len(part)]
            part, text = part[new], text[new].astype(np.int64)
            heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))[: len(part)]
            toxic = np.add.reduceat(label[text], heads) if len(part) else np.zeros(0, dtype=np.int64)
            both = np.diff(np.append(heads, len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(part[heads].view(np.int64)), pa.array(toxic, pa.int64()), pa.array(both - toxic, pa.int64())], ["part", "toxic", "other"])

    return rows.mapInArrow(lean(run), "part long, toxic long, other long").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _rate(share: np.ndarray, scores: np.ndarray, loss: float) -> float:
    """The positive root of the background's moment generating function at 1."""
    rest = max(1e-9, 1 - share.sum())

    def moment(x: float) -> float:
        return rest * np.exp(-loss * x) + float((share * np.exp(np.minimum(scores * x, 600))).sum())

    low, high = 1e-6, 1.0
    while moment(high) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    return (low + high) / 2


def fit_constant(background: np.ndarray, rate: float) -> float:
    """K, from the best segment's score (0: none) and the number of tokens of each background text."""
    score, n = background[:, 0], background[:, 1]
    return constant_of((score > 0).sum(), (n * np.exp(-rate * score)).sum())


def constant_of(hits: float, exposure: float) -> float:
    """K, from the number of background texts with a segment and the sum of n exp(-rate S) over all: texts of n
    tokens stay below a score S with chance exp(-K n exp(-rate S)), which is likeliest at this K. One more text, of
    ten tokens and a segment that chance has made, stands for what is expected without a background."""
    return float((1 + hits) / (10 + exposure))


def fit_logistic(rows: DataFrame, x: list[str], y: str, n: int, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of columns x and intercept by damped Newton steps over all n rows, of which each sends only sums."""
    size = len(x) + 1
    w, penalty = np.zeros(size), np.append(np.full(size - 1, ridge), 1e-6)
    columns = [*(F.col(c) for c in x), F.lit(1.0)]
    for _ in range(steps):
        z = sum((c * float(v) for c, v in zip(columns[1:], w[1:])), columns[0] * float(w[0]))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0))))
        rated = rows.select(*columns[:-1], p.alias("p"), (p - F.col(y)).alias("off"))
        gradient = [F.sum(F.col("off") * c) for c in columns]
        second = [F.sum(F.col("p") * (1 - F.col("p")) * columns[i] * columns[j]) for i in range(size) for j in range(size)]
        sums = np.array(rated.agg(*gradient, *second).first(), dtype=float) / n
        step = np.linalg.solve(sums[size:].reshape(size, size) + np.diag(penalty + 1e-9 / n), sums[:size] + penalty * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, divisor: int = 4, held: int = 2) -> Model:
    prepare(docs)
    train = settle(training_rows(docs, labels, "toxic", divisor, held))
    counts = settle(_counts(train))
    model = Model()
    totals = counts.agg(F.sum("toxic"), F.sum("other")).first()
    toxic, other = float(totals[0] or 0), float(totals[1] or 0)
    if toxic and other:
        prior, weight = PRIOR * (F.col("toxic") + F.col("other")), PRIOR * (toxic + other)
        a, b = F.col("toxic") + prior, F.col("other") + prior
        odds = F.log(a / (toxic + weight - a)) - F.log(b / (other + weight - b))
        doubt = F.sqrt(1 / a + 1 / b)
        found = counts.select("part", "other", odds.alias("odds"), doubt.alias("doubt"), "toxic").where(f"toxic >= {LEAST_DOCUMENTS} and odds >= {LEAST_Z} * doubt")
        found = found.toPandas()  # the significant parts, which every task of the scan gets
        part = found["part"].to_numpy().astype(np.int64).view(words.U)
        order = np.argsort(part)
        model.parts, model.scores = part[order], np.maximum((found["odds"] - DOUBT * found["doubt"]).to_numpy()[order], 0.1)
        share = (found["other"].to_numpy()[order] + 0.1) / other
        model.loss = float(max(0.05, 2 * (share * model.scores).sum()))  # the background drifts down
        model.rate = _rate(share, model.scores, model.loss)
    background = _evidence(train.where("label = 0"), model, ["label"])
    hits, exposure = background.agg(F.sum((F.col("top") > 0).cast("long")), F.sum(F.col("n") * F.exp(-model.rate * F.col("top")))).first()
    model.constant = constant_of(hits or 0, exposure or 0.0)
    evidence = settle(_evidence(train, model, ["label"]).select("best", "sum", "label"))
    n, bad = evidence.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if 0 < bad < n:
        model.weights = tuple(float(v) for v in fit_logistic(evidence, ["best", "sum"], "label", n))
    elif n:
        model.weights = (0.0, 0.0, 20.0 if bad else -20.0)
    return model


def _evidence(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns keep, best, sum, top (the best segment's score), n (tokens) and segments (significant ones) of each row."""
    shared = send(rows.sparkSession, model)

    def run(batches):
        s, m = splitter(), received(shared)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in chunks(batches, "text"):
            split = s.split(batch.column("text"))
            at, score = m.token_scores(split)
            cuts = np.searchsorted(at, split.bounds).tolist()
            best, total, top, segments = *np.zeros((3, batch.num_rows)), [[] for _ in range(batch.num_rows)]
            for i, n in enumerate(split.counts.tolist()):
                if cuts[i] < cuts[i + 1]:
                    own = m.segments((at[cuts[i] : cuts[i + 1]] - split.bounds[i]).tolist(), score[cuts[i] : cuts[i + 1]].tolist())
                    best[i], total[i] = m.evidence(own, n)
                    top[i] = max(v for _, _, v in own)
                    segments[i] = [{"start": a, "end": b, "score": v} for a, b, v in own if m.surprise(v, n) > -np.log(CHANCE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(best), pa.array(total), pa.array(top), pa.array(split.counts, pa.int64()), pa.array(segments, kind), pa.array(m.score(np.column_stack((best, total))))], [*keep, "best", "sum", "top", "n", "segments", "score"])

    held = rows.select(*keep).schema
    schema = held.simpleString()[7:-1].replace(":", ": ")
    return rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), f"{schema}, best double, sum double, top double, n long, segments array<struct<start: int, end: int, score: double>>, score double")


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, score, predicted, and the significant segments (word positions, scores)."""
    prepare(docs)
    names = {c: f"keep_{i}" for i, c in enumerate(keep)}  # clear of the new columns' names
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("text").alias("text"))
    out = _evidence(rows, model, list(names.values()))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("score").alias("toxicity"), (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "segments")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not predicted toxic, unchanged with all their columns, whatever these are called."""
    held, back = carried(docs)
    out = score(held, fit(docs, labels), keep=tuple(held.columns))
    return out.where("predicted = 0").select(*back)
