"""Substring deduplication: words covered by a window that occurs more than once are removed.

1. Anchors. Each window of 35 words picks the 12-word phrase in it that has the smallest hash, so equal
   windows pick equal phrases. About one phrase in twelve is picked; only these are shuffled and counted.
2. Confirmation. In documents with a phrase that recurs, the windows that picked such a phrase are hashed
   and counted over the whole corpus; those that start at two places or more are confirmed. Each gets one
   representative document, which alone spells it out: runs of its windows become passages.
3. Location. Passages are dealt to shards by representative. A shard compiles an Aho-Corasick automaton
   (pyahocorasick) from phrases of its passages, so spaced that every window holds one, and the documents that have a
   window of the shard are streamed through it. Nothing else tells where in a document something occurs: each match
   is held against the passage word by word, and stretches of a window or more are spans.

Counts are summed on the map side before each shuffle, and a phrase or window in many documents meets only
joins that Spark can split. A shard with many documents is held by several tasks, each of which gets its
passages. A document goes to a shard once, however many windows they share.

Defined cases: null texts have no words; texts shorter than a window lose nothing; repeated rows are
occurrences of each other; rows are told apart by doc_id and text, so null or repeated ids do no harm;
a text of any length is taken whole, as one chunk of its own; of equal windows in one document the first spells it
out, of several documents that of the smallest row key, which changes no span; clashing extra columns are kept
out of the way; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import carried, chunks, erase, lean, release, row_key, prepare, settle, store

WINDOW, PHRASE = 35, 12
SPANS = "array<struct<start: int, end: int>>"
#: Confirmed windows of a shard, about; phrases of one automaton, of which a shard may have several.
WINDOWS_A_SHARD, PHRASES_AN_AUTOMATON = 1 << 18, 50_000
DOCUMENTS_A_TASK = 4096
#: Bytes of text that are streamed through an automaton at once.
STREAMED = 1 << 19
#: Words that are compared at once; bytes of a batch on its way to a shard.
COMPARED_AT_ONCE, BATCH = 1 << 19, 1 << 20


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best over each run of width values, by doubling."""
    size = 1
    while 2 * size <= width:
        values, size = best(values[:-size], values[size:]), 2 * size
    return best(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def picked(split: words.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all phrases; starts of the windows; the phrase hash that each window picks."""
    grams = words.shingle_hashes(split.hashes, phrase)
    starts = words.inside_runs(split.bounds, window)
    if not len(starts):
        return grams, starts, np.zeros(0, dtype=words.U)
    return grams, starts, sliding(grams, window - phrase + 1)[starts]


def anchors(split: words.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, phrase hash, number of places) of the phrases picked by some window around them."""
    grams, starts, least = picked(split, window, phrase)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(words.U), none
    width = window - phrase + 1
    around = np.zeros(len(grams) + width - 1, dtype=words.U)
    around[starts + width - 1] = least
    places = np.flatnonzero(sliding(around, width, np.maximum) == grams)
    return counted(np.searchsorted(split.bounds, places, side="right") - 1, grams[places])


def counted(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs and how often each comes."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (value[1:] != value[:-1]))))[: len(text)]
    return text[new], value[new], np.diff(np.append(new, len(text)))


def _rows(batch: pa.RecordBatch, text, value, n) -> pa.RecordBatch:
    keys = batch.column("row_key").to_numpy()[text]
    return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(keys), pa.array(n.astype(np.int32))], ["hash", "row_key", "n"])


def _recurring(spark, path: str) -> DataFrame:
    """(row_key, hashes): of the stored (hash, row_key, n), those hashes that come twice or more."""
    rows = spark.read.parquet(path)
    often = rows.groupBy("hash").agg(F.sum("n").alias("total")).where("total >= 2").select("hash")
    return rows.select("hash", "row_key").join(often, "hash").groupBy("row_key").agg(F.collect_set("hash").alias("hashes"))


def locate(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Columns keep (with the text), n_words and spans (word positions covered by recurring windows)."""
    schema = docs.select(*keep).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.from_json(F.lit("[]"), SPANS)}).schema
    return found_by_shards(docs, window, phrase, keep).mapInArrow(lean(_mark([*keep])), schema)


def found_by_shards(docs: DataFrame, window: int, phrase: int, keep: tuple[str, ...]) -> DataFrame:
    """Columns keep (with the text) and found: for each shard that has found something, its spans."""
    prepare(docs)
    spark = docs.sparkSession
    keyed = docs.select(*keep, row_key("doc_id", "text").alias("row_key"))

    def find_anchors(batches):
        splitter = words.Splitter(words.WHITE, fold=False)
        for batch in chunks(batches, "text"):
            yield _rows(batch, *anchors(splitter.split(batch.column("text")), window, phrase))

    def find_windows(batches):
        splitter = words.Splitter(words.WHITE, fold=False)
        for batch in chunks(batches, "text"):
            split = splitter.split(batch.column("text"))
            _, starts, least = picked(split, window, phrase)
            if not len(starts):
                continue
            text = np.searchsorted(split.bounds, starts, side="right") - 1
            chosen = member(batch.column("hashes"), text, least)
            hashes = words.shingle_hashes(split.hashes, window)[starts[chosen]]
            yield _rows(batch, *counted(text[chosen], hashes))

    schema = "hash long, row_key long, n int"
    first = store(keyed.select("row_key", "text").mapInArrow(lean(find_anchors), schema))
    candidates = keyed.select("row_key", "text").join(_recurring(spark, first), "row_key")
    second = store(candidates.select("row_key", "text", "hashes").mapInArrow(lean(find_windows), schema))
    del candidates
    erase(spark, first)
    release(spark)
    windows = spark.read.parquet(second)
    confirmed = settle(windows.groupBy("hash").agg(F.sum("n").alias("total"), F.min("row_key").alias("owner")).where("total >= 2").select("hash", "owner"))
    shards = max(1, -(-confirmed.count() // WINDOWS_A_SHARD))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int").alias("shard")
    routes = settle(windows.select("hash", "row_key").join(confirmed, "hash").select("row_key", shard).distinct())
    erase(spark, second)
    release(spark)
    tasks = routes.groupBy("shard").agg(F.ceil(F.count("*") / DOCUMENTS_A_TASK).cast("int").alias("tasks"))  # one row a shard
    own = confirmed.groupBy("owner").agg(F.collect_list("hash").alias("hashes")).select(F.col("owner").alias("row_key"), "hashes", shard).join(tasks, "shard")
    to = routes.join(tasks, "shard").groupBy("row_key").agg(F.collect_list(F.struct("shard", "tasks")).alias("to"))
    dealt = to.join(own, "row_key", "left").select("row_key", "to", "hashes", F.col("shard").alias("home"), F.col("tasks").alias("home_tasks"))
    # equal rows have one key; the scan's partition tells them apart, so they don't all go to one task
    texts = docs.select("text", row_key("doc_id", "text").alias("row_key"), F.spark_partition_id().alias("scan"))
    sent = texts.join(dealt, "row_key").select("text", "row_key", "scan", "to", "hashes", "home", "home_tasks").mapInArrow(lean(_deal(window)), "shard int, task int, row_key long, text string")
    hits = sent.repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("row_key").isNotNull()).mapInArrow(lean(_locate(window, phrase)), f"row_key long, found {SPANS}")
    third = store(hits.distinct())
    release(spark)
    of_row = spark.read.parquet(third).groupBy("row_key").agg(F.flatten(F.collect_list("found")).alias("found"))
    return keyed.join(of_row, "row_key", "left").drop("row_key")


def member(lists: pa.Array, text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values are in the list (of signed 64-bit numbers, or null) of their text; text ascends."""
    out = np.zeros(len(value), dtype=bool)
    bounds = np.searchsorted(text, np.arange(len(lists) + 1))
    for i in np.flatnonzero(np.diff(bounds)):
        some = lists[i].values
        if some is not None and len(some):
            a, b = bounds[i], bounds[i + 1]
            out[a:b] = np.isin(value[a:b], some.to_numpy().view(words.U))
    return out


def runs_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers (ascending)."""
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)]


def _deal(window: int):
    """For each document: its passages, to every task of their shard, and its text, to one task of each shard."""

    def run(batches):
        splitter = words.Splitter(words.WHITE, fold=False)
        for batch in chunks(batches, "text"):
            split = splitter.split(batch.column("text"))
            texts = batch.column("text")
            shard, task, key, body = [], [], [], []
            for i, (hashes, home, tasks) in enumerate(zip(*(batch.column(c) for c in ("hashes", "home", "home_tasks")))):
                a, b = split.bounds[i], split.bounds[i + 1]
                if not hashes.is_valid or b - a < window:
                    continue
                grams, first = np.unique(words.shingle_hashes(split.hashes[a:b], window), return_index=True)
                starts = np.sort(first[np.isin(grams, hashes.values.to_numpy().view(words.U))])
                for low, high in zip(*runs_of(starts)) if len(starts) else ():
                    passage = split.data[split.starts[a + low] : split.ends[a + high + window - 1]].tobytes().decode()
                    for t in range(tasks.as_py()):
                        shard.append(home.as_py())
                        task.append(t)
                        body.append(passage)
            for k in range(0, len(body), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(shard[k : k + 1000], pa.int32()), pa.array(task[k : k + 1000], pa.int32()), pa.nulls(len(body[k : k + 1000]), pa.int64()), pa.array(body[k : k + 1000], pa.string())], ["shard", "task", "row_key", "text"])
            rows, shard, task, size = [], [], [], 0
            for i, (to, row, scan) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("to", "row_key", "scan")))):
                bytes_ = int(split.offsets[i + 1] - split.offsets[i])
                for x in to:
                    if rows and size + bytes_ > BATCH:
                        yield _texts(batch, rows, shard, task)
                        rows, shard, task, size = [], [], [], 0
                    rows.append(i)
                    shard.append(x["shard"])
                    task.append(hash((row, scan)) % x["tasks"])
                    size += bytes_
            if rows:
                yield _texts(batch, rows, shard, task)

    return run


def _texts(batch: pa.RecordBatch, rows: list[int], shard: list[int], task: list[int]) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(task, pa.int32()), batch.column("row_key").take(at), batch.column("text").take(at)], ["shard", "task", "row_key", "text"])


def spelled(number: np.ndarray) -> np.ndarray:
    """Each word's number as three letters, of which the last two have 128 forms each: an automaton looks through the
    ways that leave a node one by one, so these have to be few. Row 0 is for any other word."""
    out = np.zeros((len(number) + 1, 3), dtype="<u4")
    out[1:] = np.stack((257 + (number >> 14), 129 + (number >> 7 & 127), 1 + (number & 127)), axis=1)
    return out


class Shard:
    """Passages of one shard, and automata over phrases of them."""

    def __init__(self, passages: list[str], window: int, phrase: int):
        import ahocorasick

        self.window, self.phrase = window, phrase
        split = words.Splitter(words.WHITE, fold=False).split(pa.array(sorted(set(passages)), pa.string()))
        self.words, self.bounds = split.hashes, split.bounds
        self.known, number = np.unique(split.hashes, return_inverse=True)
        self.letters = spelled(np.arange(len(self.known)))
        line = self.letters[number + 1]
        # a window that starts at s holds the phrase at the next multiple of the spacing
        spacing, sizes = window - phrase + 1, split.counts
        per = np.maximum((sizes - phrase) // spacing + 1, 0)
        self.passage = np.repeat(np.arange(len(sizes)), per)
        self.offset = (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)) * spacing
        rows = line[(self.bounds[self.passage] + self.offset)[:, None] + np.arange(phrase)] if len(self.passage) else np.zeros((0, phrase, 3), dtype="<u4")
        held: dict[str, list[int]] = {}
        for i, row in enumerate(rows):
            held.setdefault(row.tobytes().decode("utf-32-le"), []).append(i)
        self.places = list(held.values())
        self.automata = []
        names = list(held)
        for k in range(0, len(names), PHRASES_AN_AUTOMATON):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for j, name in enumerate(names[k : k + PHRASES_AN_AUTOMATON], k):
                automaton.add_word(name, j)
            automaton.make_automaton()
            self.automata.append(automaton)

    def stream(self, split: words.Words) -> np.ndarray:
        """Which words of the texts are covered by a stretch of some passage that is a window long or longer."""
        n = len(split.hashes)
        depth = np.zeros(n + 1, dtype=np.int64)
        if not n or not len(self.known):
            return depth[:-1] > 0
        at = np.minimum(np.searchsorted(self.known, split.hashes), len(self.known) - 1)
        letter = self.letters[np.where(self.known[at] == split.hashes, at + 1, 0)]
        row = split.rows()
        line = np.zeros((n + len(split.bounds), 3), dtype="<u4")  # what no phrase has stands between texts
        line[np.arange(n) + row] = letter
        text = line.tobytes().decode("utf-32-le")
        # (end, place) as one number, so that no hit is held as an object
        hits = [np.fromiter(((end // 3) * len(self.passage) + place for end, j in automaton.iter(text) for place in self.places[j]), dtype=np.int64) for automaton in self.automata]
        del text
        ends, found = np.divmod(np.concatenate(hits) if hits else np.zeros(0, dtype=np.int64), max(1, len(self.passage)))
        if not len(ends):
            return depth[:-1] > 0
        doc = np.searchsorted(split.bounds[:-1] + np.arange(len(split.bounds) - 1), ends, side="right") - 1
        start = ends - doc - self.phrase + 1 - self.offset[found]  # where the passage would begin
        passage = self.passage[found]
        doc, passage, start = _distinct(doc, passage, start)
        low = np.maximum(split.bounds[doc], start)
        high = np.minimum(split.bounds[doc + 1], start + np.diff(self.bounds)[passage])
        source = self.bounds[passage] - start
        sizes = high - low
        upto = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + COMPARED_AT_ONCE, side="right")))
            some = slice(first, last)
            size = sizes[some]
            stops = np.cumsum(size + 1)
            where = np.arange(int(stops[-1])) + np.repeat(low[some] - (stops - size - 1), size + 1)
            inside = np.ones(len(where), dtype=bool)
            inside[stops - 1] = False
            same = np.zeros(len(where), dtype=bool)
            same[inside] = split.hashes[where[inside]] == self.words[(where + np.repeat(source[some], size + 1))[inside]]
            edges = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
            a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            long = b - a >= self.window
            np.add.at(depth, where[a[long]], 1)
            np.add.at(depth, where[b[long] - 1] + 1, -1)
            first = last
        return np.cumsum(depth[:-1]) > 0


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of parallel arrays."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return [c[new] for c in columns]


def _locate(window: int, phrase: int):
    """Passages of a task come first, then the texts that are streamed through their automata."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        splitter = words.Splitter(words.WHITE, fold=False)
        at, passages, shard = None, [], None
        for batch in chunks(batches, "text", STREAMED):
            places = list(zip(batch.column("shard").to_pylist(), batch.column("task").to_pylist()))
            keys = batch.column("row_key").is_valid().to_pylist()
            cuts = [i for i in range(1, batch.num_rows) if (places[i], keys[i]) != (places[i - 1], keys[i - 1])]
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if places[a] != at:
                    at, passages, shard = places[a], [], None
                part = batch.slice(a, b - a)
                if not keys[a]:
                    passages += part.column("text").to_pylist()
                    continue
                if shard is None:
                    shard = Shard(passages, window, phrase)
                split = splitter.split(part.column("text"))
                covered = shard.stream(split)
                spans = [words.merged(covered[x:y]) for x, y in zip(split.bounds, split.bounds[1:])]
                some = pa.array([bool(x) for x in spans])
                yield pa.RecordBatch.from_arrays([part.column("row_key"), pa.array(spans, kind)], ["row_key", "found"]).filter(some)

    return run


def _mark(keep: list[str]):
    """n_words, and the union of what all shards have found in a document."""

    def run(batches):
        splitter = words.Splitter(words.WHITE, fold=False)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in chunks(batches, "text"):
            counts = splitter.split(batch.column("text")).counts
            spans: list[list] = []
            for n, found in zip(counts.tolist(), batch.column("found").to_pylist()):
                covered = np.zeros(n if found else 0, dtype=bool)
                for x in found or ():
                    covered[x["start"] : x["end"]] = True
                spans.append(words.merged(covered) if found else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(spans, kind)], [*keep, "n_words", "spans"])

    return run


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of located documents."""
    prepare(found)

    def run(batches):
        for batch in batches:
            removed, sha = [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                kept = (text.as_py() or "").encode().split()
                for s in reversed(spans):
                    del kept[s["start"] : s["end"]]
                removed.append(sum(s["end"] - s["start"] for s in spans))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "n_words", "spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the covered words; those of which nothing is left go, the others without such
    words stay as they are. n_chars follows the text; all other columns stay, whatever they are called."""
    prepare(docs)
    held, back = carried(docs)
    found = found_by_shards(held, window, PHRASE, tuple(held.columns))
    cut = lean(_mark(held.columns), words.cutting(words.WHITE, held.columns))  # one worker a task, not two
    return found.mapInArrow(cut, held.schema).select(*back)
