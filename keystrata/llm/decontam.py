"""Benchmark decontamination with an FM-index for each shard of the corpus.

1. Candidates. A bit table of fixed size holds every pair of neighbouring words that some window has. Stretches of
   a document in which all pairs are in it can hold an occurrence; only these go on, some words each, to shards.
2. Search. A shard builds one FM-index over its stretches, and every benchmark passage is streamed past it: windows
   are searched backward, many at once, through ranks in a wavelet matrix; occurrences are located from sampled
   suffixes. A shard gets all passages by the shuffle that brings its stretches, so the benchmark may be of any
   size and never passes the driver; a task holds one shard's index and one batch of passages.
3. Merging. Spans of a document are merged; the items of its windows are looked up by a join.

Whole texts never shuffle, but for those of documents with stretches where clean() cuts them. Words, pairs and
windows are known by 64-bit hashes.

Defined cases: null and empty texts have no words, items without words no window; items of fewer
words than a window are one window; equal items all count; repeated rows are judged alike; null ids
of items count as -1; texts and items of any length are taken whole, in overlapping stretches; of equal windows
every occurrence is a hit; clashing extra columns are ignored; empty tables give clean documents or none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import carried, chunks, lean, received, send, settle, prepare
from .fmindex import FMIndex

WINDOW = 13
CHUNK_BYTES = 4 << 20
#: Words of a stretch or passage at most; of a shard on average, and the least number of shards.
STRETCH, SHARD_WORDS, LEAST_SHARDS = 4096, 1 << 19, 64
#: Tasks that search at most; each takes its shards one after the other.
MOST_TASKS = 1 << 14
#: Windows searched at once.
AT_ONCE = 1 << 15
PAIR_BITS = 24

PASSAGE = "item_id long, n int, words array<long>"
FOUND = "own long, spans array<struct<start: int, end: int>>, windows array<long>"


def window_ids(hashes: np.ndarray, n: int) -> np.ndarray:
    """One id for each n consecutive words."""
    return words.shingle_hashes(hashes, n) + words.U(n)


def pair_slots(hashes: np.ndarray) -> np.ndarray:
    """Places of all pairs of neighbours in the bit table."""
    return (words.shingle_hashes(hashes, 2) >> words.U(64 - PAIR_BITS)).astype(np.int64)


def word_slots(hashes: np.ndarray) -> np.ndarray:
    return (words.mix(hashes + words.U(1)) >> words.U(64 - PAIR_BITS)).astype(np.int64)


def stretches(start: int, end: int, most: int, window: int) -> list[tuple[int, int]]:
    """The range cut into parts of at most so many words, each window wholly in one of them."""
    step = max(1, most - window + 1)
    return [(a, min(end, a + step + window - 1)) for a in range(start, max(start + 1, end - window + 1), step)]


def passages(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, n, words): hashes of consecutive words of an item, and the number of words of its windows."""

    def run(batches):
        splitter = words.Splitter(words.NOT_ALNUM, fold=True)
        for batch in chunks(batches, "text"):
            split, ids = splitter.split(batch.column("text")), batch.column("item_id").to_pylist()
            hashes, rows = split.hashes.view(np.int64), []
            for item, a, b in zip(ids, split.bounds.tolist(), split.bounds[1:].tolist()):
                if a < b:
                    rows += [(item, min(window, b - a), hashes[x:y]) for x, y in stretches(a, b, most, window)]
            for k in range(0, len(rows), 256):
                item, n, w = zip(*rows[k : k + 256])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(n, pa.int32()), pa.array(w, pa.list_(pa.int64()))], ["item_id", "n", "words"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return settle(items.mapInArrow(run, PASSAGE))


def each_words(batch: pa.RecordBatch):
    """The hashes of each row's words."""
    column = batch.column("words")
    flat, ends = column.flatten().to_numpy().view(words.U), np.cumsum(pa.compute.list_value_length(column).to_numpy())
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def window_items(given: DataFrame) -> DataFrame:
    """(win, item_id) of every window."""

    def run(batches):
        for batch in batches:
            for item, n, w in zip(batch.column("item_id").to_pylist(), batch.column("n").to_pylist(), each_words(batch)):
                ids = np.unique(window_ids(w, n)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), item))], ["win", "item_id"])

    return given.mapInArrow(run, "win long, item_id long").distinct()


class Filter:
    """Which stretches of a text can hold a window. shortest: words of the shortest window of several words."""

    def __init__(self, given: DataFrame):
        def run(batches):
            for batch in batches:
                slots = [word_slots(w) if n == 1 else pair_slots(w) for n, w in zip(batch.column("n").to_pylist(), each_words(batch))]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots)) if slots else np.zeros(0, np.int64))], ["slot"])

        bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
        table = given.mapInArrow(run, "slot long").groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2**18 rows
        rows = np.zeros(1 << PAIR_BITS - 6, dtype="<i8")
        rows[table["at"].to_numpy()] = table["bits"].to_numpy()
        self.bits = rows.view(np.uint8)
        least = given.agg(F.min(F.when(F.col("n") > 1, F.col("n"))), F.min("n")).first()
        self.shortest, self.single = least[0], least[1] == 1

    def has(self, slots: np.ndarray) -> np.ndarray:
        return (self.bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)

    def runs(self, split: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and ends of the stretches, none of which crosses texts."""
        n = len(split.hashes)
        starts = np.zeros(n + 1, dtype=bool)
        starts[split.bounds] = True
        change = np.zeros(n + 1, dtype=np.int64)
        if self.shortest and n > 1:
            pair = np.concatenate(([False], self.has(pair_slots(split.hashes)) & ~starts[1:n], [False]))
            edge = np.diff(pair.view(np.int8))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            long = b - a >= self.shortest
            change[a[long]] += 1
            change[b[long]] -= 1
        inside = np.cumsum(change[:n]) > 0
        if self.single:
            inside |= self.has(word_slots(split.hashes))
        before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
        return np.flatnonzero(inside & (~before | starts[:n])), np.flatnonzero(inside & (~after | starts[1:])) + 1


def candidates(docs: DataFrame, text: str, given: DataFrame, window: int, most: int) -> DataFrame:
    """docs with n_words and runs, the stretches that can hold a window; text stays."""
    shared = send(docs.sparkSession, Filter(given))

    def run(batches):
        splitter, chosen = words.Splitter(words.NOT_ALNUM, fold=True), received(shared)
        for batch in chunks(batches, text, CHUNK_BYTES):
            split = splitter.split(batch.column(text))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            first, end = chosen.runs(split)
            which = np.searchsorted(split.bounds, first, side="right") - 1
            hashes = split.hashes.view(np.int64)
            for t, low, a, b in zip(which.tolist(), split.bounds[which].tolist(), first.tolist(), end.tolist()):
                found[t] += [{"start": x - low, "words": hashes[x:y]} for x, y in stretches(a, b, most, window)]
            new = {"n_words": pa.array(split.counts, pa.int64()), "runs": pa.array(found, batch.schema.field("runs").type)}
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], batch.schema.names)

    rows = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("runs", F.from_json(F.lit("null"), "array<struct<start: int, words: array<long>>>"))
    return rows.mapInArrow(lean(run), rows.schema)


class Shard:
    """Stretches of one shard under one FM-index, and what has been found in them."""

    def __init__(self, own: list[int], start: list[int], parts: list[np.ndarray]):
        self.own, self.start = own, start
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.places = np.cumsum(self.sizes + 1) - self.sizes - 1  # where each stretch starts; a separator follows it
        flat = np.concatenate(parts)
        self.vocabulary, symbol = np.unique(flat, return_inverse=True)
        text = np.zeros(len(flat) + len(parts), dtype=np.int64)
        text[np.arange(len(flat)) + np.repeat(np.arange(len(parts)), self.sizes)] = symbol + 1
        self.index = FMIndex(text, len(self.vocabulary) + 1)
        self.depth = np.zeros(len(text) + 1, dtype=np.int64)
        self.windows: list[set[int]] = [set() for _ in parts]

    def search(self, n: int, passages: list[np.ndarray]) -> None:
        """All windows of n words of some passages."""
        flat = np.concatenate(passages)
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in passages])))
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        unknown = np.concatenate(([0], np.cumsum(self.vocabulary[at] != flat)))
        starts = words.inside_runs(bounds, n)
        starts = starts[unknown[starts + n] == unknown[starts]]
        if not len(starts):
            return
        ids, first = np.unique(window_ids(flat, n)[starts], return_index=True)
        starts = starts[first]
        for k in range(0, len(starts), AT_ONCE):
            rows = at[starts[k : k + AT_ONCE, None] + np.arange(n)] + 1
            low, high = self.index.search(rows)
            live = np.flatnonzero(low < high)
            if not len(live):
                continue
            counts = (high - low)[live]
            ends = np.cumsum(counts)
            found = self.index.locate(np.repeat(low[live] - (ends - counts), counts) + np.arange(int(ends[-1])))
            np.add.at(self.depth, found, 1)
            np.add.at(self.depth, found + n, -1)
            which = np.searchsorted(self.places, found, side="right") - 1
            for part, win in zip(which.tolist(), np.repeat(ids[k + live].view(np.int64), counts).tolist()):
                self.windows[part].add(win)

    def rows(self):
        hit = np.cumsum(self.depth) > 0
        found = [(i, w) for i, w in enumerate(self.windows) if w]
        for k in range(0, len(found), 500):
            own, spans, wins = [], [], []
            for i, w in found[k : k + 500]:
                a, s = int(self.places[i]), self.start[i]
                own.append(self.own[i])
                spans.append([{"start": x["start"] + s, "end": x["end"] + s} for x in words.merged(hit[a : a + self.sizes[i]])])
                wins.append(sorted(w))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(wins, pa.list_(pa.int64()))], ["own", "spans", "windows"])


def search_shards(batches):
    """Rows by shard: first its stretches (n is 0), then the passages."""
    shard = current = None
    gathered: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        numbers, lengths = batch.column("shard").to_numpy(), batch.column("n").to_numpy()
        own, start, parts = batch.column("own").to_pylist(), batch.column("start").to_pylist(), each_words(batch)
        edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(lengths) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
            if a == b:
                continue
            if numbers[a] != current:
                if shard is not None:
                    yield from shard.rows()
                shard, current, gathered = None, numbers[a], ([], [], [])
            if not lengths[a]:
                for held, new in zip(gathered, (own, start, parts)):
                    held += new[a:b]
                continue
            if shard is None and gathered[0]:
                shard, gathered = Shard(gathered[0], gathered[1], [np.array(p) for p in gathered[2]]), ([], [], [])
            if shard is not None:
                shard.search(int(lengths[a]), parts[a:b])
    if shard is not None:
        yield from shard.rows()


def merge_spans(batches):
    """Spans of each document in order, overlapping and touching ones as one."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            joined: list[dict] = []
            for s in sorted(spans, key=lambda s: s["start"]):
                if joined and s["start"] <= joined[-1]["end"]:
                    joined[-1]["end"] = max(joined[-1]["end"], s["end"])
                else:
                    joined.append(s)
            out.append(joined)
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(out, batch.schema.field("spans").type), batch.column("windows")], ["own", "spans", "windows"])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shard_words: int = SHARD_WORDS, stretch: int = STRETCH) -> DataFrame:
    """Columns keep (which may include the text), n_words, n_hit, spans (word positions) and items."""
    prepare(docs)
    given = passages(benchmark, window, stretch)
    kept = [c for c in keep if c != text]
    rows = candidates(docs.select(*kept, F.col(text).alias(text), F.monotonically_increasing_id().alias("own")), text, given, window, stretch)
    held = settle(rows.select(*keep, "own", "n_words", "runs"))
    some = held.where(F.size("runs") > 0)
    runs = some.select("own", F.inline("runs"))
    total = runs.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // shard_words))
    left = runs.select(F.pmod(F.xxhash64("own", "start"), F.lit(shards)).alias("shard"), F.lit(0).alias("n"), "own", "start", "words")
    right = given.select("n", "words").distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "n", F.lit(0).cast("long").alias("own"), F.lit(0).alias("start"), "words")
    dealt = left.unionByName(right).repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard", "n")
    found = settle(dealt.mapInArrow(lean(search_shards), FOUND))
    by_row = found.groupBy("own").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("windows")).alias("windows"))
    hits = by_row.mapInArrow(lean(merge_spans), FOUND).select("own", "spans")
    named = found.select("own", F.explode("windows").alias("win")).join(window_items(given), "win").groupBy("own").agg(F.collect_set("item_id").alias("items"))
    none = [F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"), F.expr("cast(array() as array<long>)").alias("items")]
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), F.lit(0).cast("long"))
    clear = held.where(F.size("runs") <= 0).select(*keep, "n_words", *none)
    judged = some.drop("runs").join(hits, "own", "left").join(named, "own", "left")
    judged = judged.select(*keep, "n_words", n_hit.alias("n_hit"), F.coalesce("spans", none[1]).alias("spans"), F.coalesce(F.array_sort("items"), none[2]).alias("items"))
    return clear.unionByName(judged)


def contaminated(n_hit, n_words):
    """A twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(found: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the hit spans: from a span's first word to the end of its last. Documents of
    which nothing is left go; those without hits stay as they are. n_chars follows the text; all other columns
    stay, whatever they are called."""
    prepare(docs)
    held, back = carried(docs)
    found = find(held, benchmark, window, keep=tuple(held.columns))
    return words.cut_spans(found, words.NOT_ALNUM, held.schema).select(*back)
