"""Language-model scoring with a log-bilinear neural model over word classes.

Every token belongs to a class: each of the ``WORDS`` most frequent training words is one, the others are
dealt to ``ENDINGS`` classes by their last bytes. The model gives P(class | two classes before) times
P(word | class, class before), both of them log-bilinear and normalised.

Counts cover the whole training corpus: words are counted once, and all class trigrams. A log-bilinear
model (a context vector, made of one matrix row for each place, is multiplied with the class vectors) is
trained on the trigram counts in numpy by noise-contrastive estimation; every step takes all counted
trigrams, weighted by their counts, until the loss settles. There are CLASSES**2 contexts, so batched
matrix products give the normalised log-probabilities of all of them as one table of fixed size.

Within an ending's class every training word, however rare, has a vector and a bias of its own: its
chance goes with its count times exp(vector . context + bias), where the context vector is that of the
class before. They are fitted by noise-contrastive estimation to the counts of the word behind each class,
with the class's words by their counts as noise; given the context vectors, words don't hang together, so
each is fitted where its counts lie. The sums that normalise a class (one unseen word included) are
ENDINGS * CLASSES numbers.

Counts of the most frequent words (``HEAD`` of them at most) go to every task; a document's other words
are looked up by a join, in which each row stands for all uses of a word in a document.

Defined cases: null texts are scored as empty ones, which have the end token only; rows are told apart
where they lie, so repeated rows and null ids each get a row; a text of any length is scored whole; of words of
equal counts those of the smaller hash are the frequent ones; without training rows each token has the
probability 1 of an unseen word in an empty corpus for the base, and a class's share for the model; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import chunks, prepare, received, release, remainder, send, store

WORDS, ENDINGS = 96, 30
END = WORDS + ENDINGS  # the class of the end token; START stands before a text
CLASSES, START = END + 1, END
HEAD = 1 << 18
#: Bytes of text whose counts are put together before they leave Python.
COUNTED_BYTES = 4 << 20
#: Steps of a word's fit, and the share of a count that bends it.
STEPS, BEND, RIDGE, FARTHEST = 6, 0.25, 1.0, 4.0
DIMENSIONS, NOISE, RATE = 24, 10, 0.08
SETTLE_STEPS, SETTLED = 100, 3e-4


def ending(split: words.Words) -> np.ndarray:
    """The class number, by the last two bytes, that each word has if it isn't frequent."""
    if not len(split.ends):
        return np.zeros(0, dtype=np.int64)
    last = split.data[split.ends - 1].astype(np.int64)
    before = np.where(split.ends - split.starts > 1, split.data[split.ends - 2].astype(np.int64), 0)
    low = lambda b: np.where((b >= 65) & (b < 91), b + 32, b)
    return words.mix((low(before) * 256 + low(last)).astype(words.U)).astype(np.int64) % ENDINGS


def splitter() -> words.Splitter:
    return words.Splitter(words.WHITE, fold=True)


class Lexicon:
    """Frequent words: hashes in order, counts, and classes (-1: by ending)."""

    weights: np.ndarray | None = None  #: of each word within its class, once learned

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        best = np.lexsort((hashes, -counts))[:WORDS]
        classes = np.full(len(hashes), -1)
        classes[best] = np.arange(len(best))
        self.hashes, self.counts, self.classes = hashes[order], counts[order], classes[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word is, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def classes_of(self, split: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each word, and find()."""
        at, there = self.find(split.hashes)
        own = self.classes[at] if len(self.classes) else np.full(len(at), -1)
        return np.where(there & (own >= 0), own, WORDS + ending(split)), at, there


def with_ends(split: words.Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes with each text's end put in, and the places of the words among them."""
    texts = len(split.bounds) - 1
    out = np.full(len(classes) + texts, END)
    places = np.arange(len(classes)) + split.rows()
    out[places] = classes
    return out, places


def contexts(split: words.Words, line: np.ndarray) -> np.ndarray:
    """For each token in line, the two classes before as one number; START before the first."""
    first = split.bounds[:-1] + np.arange(len(split.bounds) - 1)
    one = np.concatenate(([START], line[:-1]))[: len(line)]
    one[first] = START
    two = np.concatenate(([START], one[:-1]))[: len(line)]
    two[first] = START
    return two * CLASSES + one


def fit(trigrams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of predicted classes and of classes two and one before, and biases. Each step takes every
    trigram with its count, and NOISE times as many noise classes by their expected number, so that no
    context is left to chance. Steps end when SETTLE_STEPS of them better the loss by less than SETTLED."""
    unigram = np.bincount(trigrams % CLASSES, weights=counts, minlength=CLASSES) + 0.5
    noise = unigram / unigram.sum()
    random = np.random.default_rng(7)
    vectors = random.normal(scale=0.1, size=(CLASSES, DIMENSIONS))  # of predicted classes
    places = random.normal(scale=0.1, size=(2, CLASSES, DIMENSIONS))  # of classes two and one before
    bias = np.log(noise)
    if not len(counts):
        return vectors, places, bias
    seen, row = np.unique(trigrams // CLASSES, return_inverse=True)
    two, one = seen // CLASSES, seen % CLASSES
    pick = np.stack([np.arange(CLASSES)[:, None] == x for x in (two, one)]).astype(np.float32)
    good = np.zeros((len(seen), CLASSES), dtype=np.float32)
    np.add.at(good, (row, trigrams % CLASSES), counts / counts.sum())
    both = good + NOISE * good.sum(axis=1, keepdims=True) * noise.astype(np.float32)
    moments = [np.full(x.shape, 1e-20) for x in (vectors, places, bias)]
    log_noise, losses = np.log(NOISE * noise), []
    while True:
        ctx = (places[0][two] + places[1][one]).astype(np.float32)
        logits = np.clip(ctx @ vectors.T.astype(np.float32) + (bias - log_noise).astype(np.float32), -30, 30)
        small = np.exp(-logits)
        losses.append(float((both * (logits + np.log1p(small)) - good * logits).sum(dtype=np.float64)))
        if len(losses) > SETTLE_STEPS and min(losses[:-SETTLE_STEPS]) - min(losses) < SETTLED * min(losses):
            return vectors, places, bias
        error = both / (1 + small) - good
        grads = error.T @ ctx, pick @ (error @ vectors.astype(np.float32)), error.sum(axis=0)
        for x, g, m in zip((vectors, places, bias), grads, moments):
            m += g.astype(float) ** 2
            x -= RATE * g / np.sqrt(m)


def table_of(vectors: np.ndarray, places: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Normalised log10 P(class | context), one row a context."""
    contexts_ = (places[0][:, None, :] + places[1][None, :, :]).reshape(-1, DIMENSIONS)
    logits = contexts_ @ vectors.T + bias
    logits -= logits.max(axis=1, keepdims=True)
    return ((logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))) / np.log(10)).astype(np.float32)


def train(trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Normalised log10 P(class | context), one row a context, from trigram numbers and their counts."""
    return table_of(*fit(trigrams, counts))


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, ending, n) of all tokens but ends, counted on the map side first."""

    def run(batches):
        s = splitter()
        for batch in chunks(batches, "text", COUNTED_BYTES):
            split = s.split(batch.column("text"))
            hashes, first, n = np.unique(split.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ending(split)[first].astype(np.int8)), pa.array(n, pa.int64())], ["hash", "ending", "n"])

    counted = docs.select("text").mapInArrow(run, "hash long, ending byte, n long")
    return counted.groupBy("hash").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(hash, cells, uses): for each training word that shares its class, how often it stands behind each
    class. A cell is the class before times ENDINGS plus the word's ending; a word has CLASSES at most."""
    shared = send(docs.sparkSession, lexicon)

    def run(batches):
        s, held = splitter(), received(shared)
        for batch in chunks(batches, "text", COUNTED_BYTES):
            split = s.split(batch.column("text"))
            classes = held.classes_of(split)[0]
            line, places = with_ends(split, classes)
            own = np.flatnonzero(classes >= WORDS)
            before = (contexts(split, line) % CLASSES)[places[own]]
            hashes = split.hashes[own]
            cell = before * ENDINGS + classes[own] - WORDS
            _, first, n = np.unique(words.mix(hashes + cell.astype(words.U) * words.U(0x9FB21C651E98DF25)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(cell[first].astype(np.int16)), pa.array(n, pa.int64())], ["hash", "cell", "n"])

    rows = docs.select("text").mapInArrow(run, "hash long, cell short, n long")
    summed = rows.groupBy("hash", "cell").agg(F.sum("n").alias("n"))
    return summed.groupBy("hash").agg(F.collect_list(F.struct("cell", "n")).alias("pairs")).select("hash", F.col("pairs.cell").alias("cells"), F.col("pairs.n").alias("uses"))


def fit_words(uses: np.ndarray, n: np.ndarray, ending: np.ndarray, shares: np.ndarray, tokens: np.ndarray, contexts_: np.ndarray) -> np.ndarray:
    """Weights of words within their classes, one row a word, for contexts_ (a row for each class before,
    its first column the bias). The noise of a class is its words by their counts, in expected numbers, so
    noise-contrastive estimation splits into one logistic regression for each word. Its steps share the curvature
    of the class: what a word bends by is about its count times the mean outer product of the class's contexts,
    whose axes are found once for each class."""
    weights = np.zeros((len(n), contexts_.shape[1]), dtype=np.float32)
    behind = tokens / np.maximum(tokens.sum(axis=1, keepdims=True), 1e-9)
    axes, lengths = {}, np.zeros_like(weights)
    for e in np.unique(ending).tolist():
        bend, axis = np.linalg.eigh((contexts_ * behind[e][:, None]).T @ contexts_)
        axes[e] = axis.astype(np.float32)
        lengths[ending == e] = np.maximum(bend, 0)
    uses, tokens, contexts_, shares = (x.astype(np.float32) for x in (uses, tokens, contexts_, shares))
    lengths = BEND * (n[:, None] + NOISE * (tokens.sum(axis=1)[ending] * shares)[:, None]) * lengths + np.float32(RIDGE)
    lengths = lengths.astype(np.float32)
    noise = np.float32(NOISE) * tokens[ending] * shares[:, None]
    parts = [(np.flatnonzero(ending == e), axis) for e, axis in axes.items()]
    for _ in range(STEPS):
        chance = 1 / (1 + np.exp(np.float32(np.log(NOISE)) - np.clip(weights @ contexts_.T, -20, 20)))
        slope = (uses * (1 - chance) - noise * chance) @ contexts_ - RIDGE * weights
        step = np.empty_like(slope)
        for at, axis in parts:
            step[at] = (slope[at] @ axis / lengths[at]) @ axis.T
        weights += step / np.maximum(np.linalg.norm(step, axis=1, keepdims=True) / FARTHEST, 1)
    return weights


def learn_words(pairs: DataFrame, places: np.ndarray, tokens: np.ndarray, mass: np.ndarray) -> DataFrame:
    """(hash, weights) of every training word that shares its class."""
    shared = send(pairs.sparkSession, (with_bias(places), tokens, mass))

    def run(batches):
        contexts_, tokens, mass = received(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column("cells")
                sizes = np.diff(lists.offsets.to_numpy())
                cell = lists.flatten().to_numpy().astype(np.int64)
                uses = np.zeros((part.num_rows, CLASSES), dtype=np.float32)
                uses[np.repeat(np.arange(part.num_rows), sizes), cell // ENDINGS] = part.column("uses").flatten().to_numpy()
                n, ending = uses.sum(axis=1).astype(np.int64), cell[np.cumsum(sizes) - sizes] % ENDINGS
                weights = fit_words(uses, n, ending, (n + 1) / mass[ending], tokens, contexts_).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("hash"), pa.array(ending.astype(np.int8)), pa.array(n), vectors_of(weights)], ["hash", "ending", "n", "weights"])

    return pairs.mapInArrow(run, "hash long, ending byte, n long, weights array<float>")


def sums(words_: DataFrame, places: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 of the sum over the words of each ending's class, unseen one included, behind each class."""
    shared = send(words_.sparkSession, (with_bias(places), mass))

    def run(batches):
        contexts_, mass = received(shared)
        total = np.zeros((ENDINGS, CLASSES))
        for batch in batches:
            ending = batch.column("ending").to_numpy().astype(np.int64)
            weights = batch.column("weights").flatten().to_numpy().reshape(len(ending), -1)
            parts = ((batch.column("n").to_numpy() + 1) / mass[ending])[:, None] * np.exp(weights @ contexts_.T)
            total += (np.arange(ENDINGS)[:, None] == ending) @ parts
        cell = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total.reshape(-1))], ["cell", "part"])

    found = words_.select("ending", "n", "weights").mapInArrow(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect()  # ENDINGS * CLASSES rows
    out = np.repeat(1 / mass, CLASSES)  # the unseen word
    for r in found:
        out[r["cell"]] += r["part"]
    return np.log10(out).reshape(ENDINGS, CLASSES)


def vectors_of(rows: np.ndarray) -> pa.Array:
    """Rows as lists of float."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).astype(np.float32)))


def with_bias(places: np.ndarray) -> np.ndarray:
    """Context of each class before, 1 first."""
    return np.column_stack((np.ones(CLASSES), places[1]))


def count_trigrams(docs: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """All class trigrams of the training texts and their counts; CLASSES**3 at most."""
    shared = send(docs.sparkSession, lexicon)

    def run(batches):
        s, held = splitter(), received(shared)
        for batch in chunks(batches, "text", COUNTED_BYTES):
            split = s.split(batch.column("text"))
            line, _ = with_ends(split, held.classes_of(split)[0])
            number, n = np.unique(contexts(split, line) * CLASSES + line, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(n, pa.int64())], ["number", "n"])

    rows = docs.select("text").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    found = rows.orderBy("number").toArrow()
    return found["number"].to_numpy(), found["n"].to_numpy().astype(float)


def score(docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    prepare(docs)
    spark = docs.sparkSession
    counts = spark.read.parquet(store(count_words(training)))
    ends = training.count()
    size = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(size[0] or 0) + ends, int(size[1]) + (ends > 0)
    steps = counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).count().orderBy(F.desc("step")).collect()  # 4 * 63 rows at most
    held, least = 0, None
    for r in steps:  # the lowest step down to which all words fit
        if held + r["count"] > HEAD:
            break
        held, least = held + r["count"], r["step"]
    frequent = F.floor(F.log2("n") * 4) >= F.lit(least) if least is not None else F.lit(False)
    head = counts.where(frequent).select("hash", "n").toArrow()  # HEAD rows at most
    lexicon = Lexicon(head["hash"].to_numpy().view(words.U), head["n"].to_numpy())
    trigrams, times = count_trigrams(training, lexicon)
    model = fit(trigrams, times)
    release(spark)
    behind = np.bincount(trigrams % CLASSES**2, weights=times, minlength=CLASSES**2).reshape(CLASSES, CLASSES)
    tokens = np.ascontiguousarray(behind.T[WORDS:END])  # of each ending behind each class
    single = spark.createDataFrame([(int(h),) for h in lexicon.hashes[lexicon.classes >= 0].view(np.int64)], "hash long")  # WORDS rows
    by_class = counts.join(F.broadcast(single), "hash", "left_anti").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    mass = np.ones(ENDINGS)
    for r in by_class:
        mass[r["ending"]] = r["n"] + r["words"] + 1
    learned = spark.read.parquet(store(learn_words(count_pairs(training, lexicon), model[1], tokens, mass)))
    log_sums = sums(learned, model[1], mass)
    lexicon.weights = np.zeros((len(lexicon.hashes), DIMENSIONS + 1), dtype=np.float32)
    near = learned.where(frequent).select("hash", "weights").toArrow()  # HEAD rows at most
    if near.num_rows:
        at, _ = lexicon.find(near["hash"].to_numpy().view(words.U))
        lexicon.weights[at] = near["weights"].combine_chunks().flatten().to_numpy().reshape(len(at), -1)
    rest = learned.where(~frequent).select("hash", F.col("n").alias("count"), "weights")  # all of these share a class
    shared = send(spark, (lexicon, table_of(*model), with_bias(model[1]), log_sums, mass, total, distinct, ends))
    names = {c: f"keep_{i}" for i, c in enumerate(keep)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("text").alias("text"))
    kept = rows.select(*names.values()).schema
    schema = "row_id long, hash long, uses int, behind array<float>, known long, tokens long, base double, score double"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    parts = rows.mapInArrow(_scores(shared, [*names.values()]), f"{schema}, {columns}")
    # words that aren't frequent: their part of the scores follows from their count
    # a text's own row has no word; its number stands in, so that these rows don't meet under one key
    place = [F.coalesce("hash", "row_id").alias("place"), F.col("hash").isNotNull().alias("is_word")]
    joined = parts.select("*", *place).join(rest.select(F.col("hash").alias("place"), F.lit(True).alias("is_word"), "count", "weights"), ["place", "is_word"], "left")
    times, there = F.col("uses"), F.coalesce("count", F.lit(0))
    gained = F.when(F.col("hash").isNotNull(), times * F.log10(there + 1.0)).otherwise(0.0)
    known = F.when(F.col("count").isNotNull(), times).otherwise(0)
    fitted = F.coalesce(sum(F.col("weights")[i].cast("double") * F.col("behind")[i] for i in range(DIMENSIONS + 1)), F.lit(0.0)) / float(np.log(10))
    done = joined.groupBy("row_id").agg(
        *(F.max(n).alias(n) for n in names.values()),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + known).alias("n_known"),
        F.sum(F.col("base") + gained).alias("base_score"),
        F.sum(F.col("score") + gained + fitted).alias("score"),
    )
    return done.select(*(F.col(n).alias(c) for c, n in names.items()), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _scores(shared, keep: list[str]):
    """One row for each text with what needs no join, and one for each of its words that need one. For
    these, all but log10(count + 1) is in the text's row."""

    def run(batches):
        lexicon, table, contexts_, log_sums, mass, total, distinct, ends = received(shared)
        flat, log_mass = table.reshape(-1), np.log10(mass)
        scale, near = np.log10(total + distinct + 1), contexts_.astype(np.float32)
        s, number = splitter(), TaskContext.get().partitionId() << 40
        for batch in chunks(batches, "text"):
            split, n = s.split(batch.column("text")), batch.num_rows
            classes, at, there = lexicon.classes_of(split)
            line, places = with_ends(split, classes)
            row = np.repeat(np.arange(n), split.counts + 1)
            context = contexts(split, line)
            chance = np.bincount(row, weights=flat[context * CLASSES + line], minlength=n)
            before = (context % CLASSES)[places]
            text = split.rows()
            count = np.where(there, lexicon.counts[at] if len(lexicon.counts) else 0, 0)
            seen = np.log10(count + 1.0)
            by_ending = np.where(classes >= WORDS, 1, 0)
            ended = np.maximum(classes - WORDS, 0) % ENDINGS
            # a word's part of its class: count and fitted weights, over the sum of the class
            own = np.zeros(len(classes))
            fitted = np.flatnonzero(there & (by_ending > 0))
            own[fitted] = np.einsum("nd,nd->n", lexicon.weights[at[fitted]], near[before[fitted]]) / np.log(10)
            inside = np.where(by_ending > 0, seen + own - log_mass[ended] - log_sums[ended, before], 0.0)
            base = np.bincount(text, weights=seen, minlength=n) + np.log10(ends + 1) - (split.counts + 1) * scale
            score = chance + np.bincount(text, weights=inside, minlength=n)
            known = np.bincount(text, weights=there, minlength=n).astype(np.int64) + (ends > 0)
            rare = np.flatnonzero(~there & (by_ending > 0)) if len(text) else np.zeros(0, dtype=np.int64)
            order = rare[np.lexsort((split.hashes[rare], text[rare]))]
            t, h = text[order], split.hashes[order]
            new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])))[: len(t)])
            uses = np.diff(np.append(new, len(t)))
            behind = np.add.reduceat(contexts_[before[order]], new, axis=0) if len(new) else np.zeros((0, DIMENSIONS + 1))
            ids = number + np.arange(n)
            number += n
            blank = lambda k: np.zeros(k)
            m = len(new)
            long = lambda a, b: pa.array(np.concatenate((a, b)).astype(np.int64))
            arrays = [
                long(ids, ids[t[new]]),
                pa.array(np.concatenate((np.zeros(n, dtype=np.int64), h[new].view(np.int64))), mask=np.arange(n + m) < n),
                pa.array(np.concatenate((np.zeros(n), uses)).astype(np.int32)),
                pa.concat_arrays([pa.nulls(n, pa.list_(pa.float32())), vectors_of(behind)]),
                long(known, np.zeros(m)),
                long(split.counts + 1, np.zeros(m)),
                pa.array(np.concatenate((base, blank(m)))),
                pa.array(np.concatenate((score, blank(m)))),
                *(pa.concat_arrays([batch.column(c), pa.nulls(m, batch.column(c).type)]) for c in keep),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["row_id", "hash", "uses", "behind", "known", "tokens", "base", "score", *keep])

    return run


def training_part(docs: DataFrame, divisor: int = 7, held: int = 2) -> DataFrame:
    return docs.where(remainder("doc_id", divisor) != held)
