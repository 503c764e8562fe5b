"""N-gram Jaccard join with a token-group matrix: classes of documents linked by near equal shingle sets.

Sets that are equal form one class and go on once. Tokens (shingle hashes) are put in one global order,
rare ones first, by a counting sketch over all documents; two sets that link share one of the first
``n - ceil(t n) + 1`` tokens of each, so the index holds only these.

1. Groups. Each class goes to that token of its index whose list is longest: near copies come together before
   anything is compared. Large groups are cut into parts of ``GROUP`` classes and ``GROUP_TOKENS`` tokens at most on average.
2. Matrix. One row for each (token, group) holds the sizes and positions that bound what two groups can
   share; only groups that meet in a token within these bounds go on.
3. Opening. A part is loaded as the union of its members' tokens with the members that hold each. A query's
   overlap with the union bounds its overlap with any member, so only queries beyond the bound open the
   part; these are compared with all members at once, exactly. Links that connect nothing new are left out.

Rows grow with (token, group) pairs and with (class, part) pairs, never with pairs of classes: n near copies in one
list make n queries for each part of ``GROUP``. Parts with many queries are salted, so a task gets a bounded number.
Components are found once, at the end.

Defined cases: null texts and texts without words have an empty set, their own component and no links;
texts of fewer words than a shingle have one token; repeated rows are one class; rows of null doc_id get
the least non-null id of their component, or null; a text of any length is taken whole, as one chunk of its
own, and texts that no other shares an index token with are never loaded twice; ties (lists of equal
length, equal sizes) are broken by hashes and change no link; clashing extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import chunks, erase, lean, release, row_key, prepare, store
from .components import components

SHINGLE, SIMILAR = 5, (75, 100)
SKETCH_BITS, SEGMENT_BITS = 24, 16
#: Members and tokens of a part of a group; a set that is larger is a part for itself or makes one larger.
GROUP, GROUP_TOKENS = 1024, 1 << 20
QUERIES_A_TASK = 512
#: (query token, member) pairs that a task counts at once; one query may have as many as its part has tokens.
PAIRS_AT_ONCE = 1 << 21


def token_sets(split: words.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of each text's set of shingles, ordered by text and token."""
    counts = split.counts
    starts = words.inside_runs(split.bounds, k)
    text = np.searchsorted(split.bounds, starts, side="right") - 1
    tokens = words.shingle_hashes(split.hashes, k)[starts]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = [words.shingle_hashes(split.hashes[split.bounds[t] : split.bounds[t + 1]], int(counts[t]))[0] + words.U(counts[t]) for t in short]
        text, tokens = np.concatenate((text, short)), np.concatenate((tokens, np.array(whole, dtype=words.U)))
    order = np.lexsort((tokens, text))
    text, tokens = text[order], tokens[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (tokens[1:] != tokens[:-1])))[: len(text)]
    return text[new], tokens[new]


def prefix_size(n, similar=SIMILAR):
    """How many first tokens of n are to be indexed."""
    return n - (-(-n * similar[0] // similar[1])) + 1


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Number of documents by hashed token, over all documents: a table of 2**SKETCH_BITS places, or a
    smaller power of two for little text. A task's counts travel as bytes, so one that is over 255 in a
    task stays there, and sums stay at 65,535; only the order of tokens hangs on them."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(SKETCH_BITS, max(SEGMENT_BITS, (size // 48).bit_length()))  # about eight tokens a place
    segments = 1 << (bits - SEGMENT_BITS)

    def count(batches):
        splitter, total = words.Splitter(words.WHITE, fold=True), np.zeros(1 << bits, dtype=np.uint32)
        for batch in chunks(batches, "text"):
            _, tokens = token_sets(splitter.split(batch.column("text")), k)
            np.add.at(total, (tokens >> words.U(64 - bits)).astype(np.int64), 1)
        for i, row in enumerate(total.reshape(segments, -1)):
            if row.any():
                packed = zlib.compress(np.minimum(row, 255).astype(np.uint8).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["segment", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[s] = total.get(s, 0) + np.frombuffer(zlib.decompress(c), dtype=np.uint8).astype(np.uint32)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in total.values()], pa.binary())], ["segment", "counts"])

    schema = "segment int, counts binary"
    out = np.zeros((segments, 1 << SEGMENT_BITS), dtype=np.uint16)
    for s, c in docs.select("text").mapInArrow(lean(count), schema).repartition(min(segments, 64), "segment").mapInArrow(lean(add), schema).collect():  # one row a segment
        out[s] = np.frombuffer(c, dtype=np.uint16)
    return out.reshape(-1)


def signatures(docs: DataFrame, shared: Broadcast, k: int, similar) -> DataFrame:
    """(doc_id, row_key, n, class, first): the set's size, 64-bit digest and indexed tokens in order.
    shared: the sketch."""

    def run(batches):
        splitter, held = words.Splitter(words.WHITE, fold=True), shared.value
        shift = words.U(64 - (len(held).bit_length() - 1))
        for batch in chunks(batches, "text"):
            text, tokens = token_sets(splitter.split(batch.column("text")), k)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            n = np.diff(bounds)
            digests = [int.from_bytes(hashlib.blake2b(tokens[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(bounds, bounds[1:])]
            order = np.lexsort((tokens, held[(tokens >> shift).astype(np.int64)], text))
            size = np.where(n > 0, prefix_size(n, similar), 0)
            first = order[np.arange(len(text)) - bounds[text] < size[text]]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(tokens[first].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(n, pa.int32()), pa.array(digests, pa.int64()), lists], ["doc_id", "row_key", "n", "class", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row_key", "text").mapInArrow(lean(run), f"doc_id {kind}, row_key long, n int, class long, first array<long>")


class Group:
    """A held part of a group: its members' sets, their union and the members that hold each token of it."""

    def __init__(self, names: list[int], sets: list[np.ndarray]):
        self.names, self.sizes = np.array(names, dtype=np.int64), np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=words.U)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))[: len(tokens)]
        self.union, self.low = tokens[heads], heads
        self.held = np.diff(np.append(heads, len(tokens)))
        self.root = np.arange(len(sets))  # members that are connected so far share a root

    def ask(self, names: list[int], sets: list[np.ndarray], same: list[bool], similar) -> list[tuple[int, int]]:
        """Links that connect each query with all members it links to, but for those that earlier links connect.
        same: the query is of this very part, and meets only the members of smaller names."""
        if not len(self.union):
            return []
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens, query = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        hit = self.union[at] == tokens
        open_ = similar[1] * np.bincount(query[hit], minlength=len(sets)) >= similar[0] * sizes  # else no member can link
        chosen = hit & open_[query]
        at, query = at[chosen], query[chosen]
        work = np.bincount(query, weights=self.held[at], minlength=len(sets)).cumsum()
        out: list[tuple[int, int]] = []
        first = 0
        while first < len(sets):
            before = work[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(work, before + PAIRS_AT_ONCE, side="right")))
            a, b = np.searchsorted(query, [first, last])
            counts = self.held[at[a:b]]
            ends = np.cumsum(counts)
            places = np.repeat(self.low[at[a:b]] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
            both = np.bincount(np.repeat(query[a:b] - first, counts) * len(self.names) + self.owner[places], minlength=(last - first) * len(self.names)).reshape(last - first, -1)
            links = similar[1] * both >= similar[0] * (sizes[first:last, None] + self.sizes - both)
            for q in np.flatnonzero(links.any(axis=1)).tolist():
                name = names[first + q]
                member = np.flatnonzero(links[q] & (self.names < name) if same[first + q] else links[q])
                if len(member):
                    roots, one = np.unique(self.root[member], return_index=True)
                    out += [(name, m) for m in self.names[member[one]].tolist()]
                    self.root[np.isin(self.root, roots)] = roots[0]
            first = last
        return out


def verify(members: DataFrame, queries: DataFrame, texts: DataFrame, k: int, similar) -> DataFrame:
    """Links (a, b) that connect each query with the members of a part that it links to. members: (group,
    part, class); queries: (group, part, class, same); texts: (class, text). Tasks stream a part's members,
    then its queries; a part with many queries is held by several tasks."""
    salts = queries.groupBy("group", "part").agg(F.ceil(F.count("*") / QUERIES_A_TASK).cast("int").alias("salts"))
    asked = queries.join(salts, ["group", "part"]).select("group", "part", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("query"), "same", "class")
    held = members.join(salts, ["group", "part"]).select("group", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("query"), F.lit(False).alias("same"), "class")
    rows = held.union(asked).join(texts, "class").select("group", "part", "salt", "query", "same", "class", "text")
    return rows.repartition("group", "part", "salt").sortWithinPartitions("group", "part", "salt", "query").mapInArrow(lean(_open_groups(k, similar)), "a long, b long")


def _open_groups(k: int, similar):
    def run(batches: Iterator[pa.RecordBatch]):
        splitter = words.Splitter(words.WHITE, fold=True)
        at, names, sets, group = None, [], [], None
        for batch in chunks(batches, "text"):
            text, tokens = token_sets(splitter.split(batch.column("text")), k)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            columns = [batch.column(c).to_pylist() for c in ("group", "part", "salt", "query", "same", "class")]
            found, asked = [], ([], [], [])
            for i, (*place, query, same, name) in enumerate(zip(*columns)):
                own = tokens[bounds[i] : bounds[i + 1]]
                if place != at:
                    if asked[0]:
                        found += group.ask(*asked, similar)
                        asked = ([], [], [])
                    at, names, sets, group = place, [], [], None
                if not query:
                    sets.append(own)
                    names.append(name)
                    continue
                if group is None:
                    group = Group(names, sets)
                for held, value in zip(asked, (name, own, same)):
                    held.append(value)
            if asked[0]:
                found += group.ask(*asked, similar)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def shared_index(once: DataFrame) -> DataFrame:
    """(token, class, n, rest, listed): the index rows of tokens that several classes have. rest: tokens of
    the class behind this one; listed: length of the token's list."""
    often = once.select(F.explode("first").alias("token")).groupBy("token").agg(F.count("*").alias("listed")).where("listed > 1")
    index = once.select("class", F.posexplode("first").alias("pos", "token"), "n").select("token", "class", F.expr("shiftleft(bigint(n), 32) | (n - 1 - pos)").alias("sizes"))
    return index.join(often, "token").select("token", "class", F.expr("int(shiftright(sizes, 32))").alias("n"), F.expr("int(sizes & 2147483647)").alias("rest"), "listed")


def groups_of(shared: DataFrame) -> DataFrame:
    """(class, group, part, parts, members): each class goes to the token of its longest list, so that near copies
    meet although nothing is compared yet; large groups are cut into parts of bounded size."""
    homes = shared.groupBy("class").agg(F.max(F.struct("listed", F.xxhash64("token").alias("h"), "token")).alias("home"), F.first("n").alias("n"))
    homes = homes.select("class", F.col("home.token").alias("group"), "n")
    parts = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)).cast("int")
    sizes = homes.groupBy("group").agg(parts.alias("parts"), F.count("*").alias("members"))
    return homes.join(sizes, "group").select("class", "group", F.pmod(F.xxhash64("class", "group"), F.col("parts")).cast("int").alias("part"), "parts", "members")


def asked_parts(shared: DataFrame, grouped: DataFrame, similar) -> DataFrame:
    """(group, part, class, same): the parts that each class is to be compared with as a query. The (token, group)
    matrix tells which groups share an index token that leaves both enough tokens behind it, as each
    linked pair has; of two such groups the smaller one asks. A class also asks its own group."""
    t, of = similar
    cells = shared.join(grouped.select("class", "group", "parts", "members"), "class").groupBy("token", "group")
    matrix = cells.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.first("parts").alias("parts"), F.first("members").alias("members"))
    left, right = (matrix.select("token", *(F.col(c).alias(f"{side}_{c}") for c in matrix.columns[1:])) for side in "ab")
    near = f"a_group < b_group and {t} * a_least <= {of} * b_most and {t} * b_least <= {of} * a_most and {t + of} * (1 + least(a_rest, b_rest)) >= {t} * (a_least + b_least)"
    pairs = left.join(right, "token").where(near).select("a_group", "a_parts", "a_members", "b_group", "b_parts", "b_members").distinct()
    asks = F.col("a_members") <= F.col("b_members")
    side = lambda c, x, y: F.when(asks, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}"))
    others = pairs.select(side("group", "a", "b").alias("group"), side("group", "b", "a").alias("target"), side("parts", "b", "a").alias("parts"))
    asking = grouped.select("class", "group", "part", "members")
    foreign = asking.join(others, "group").select(F.col("target").alias("group"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "class", F.lit(False).alias("same"))
    own = asking.where("members > 1").select("group", F.explode(F.sequence(F.lit(0), "part")).alias("to"), "part", "class")
    return foreign.union(own.select("group", F.col("to").alias("part"), "class", (F.col("to") == F.col("part")).alias("same")))


def link_classes(docs: DataFrame, k: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, links between classes that connect all components)."""
    prepare(docs)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", row_key("doc_id", "text").alias("row_key"))
    counts = spark.sparkContext.broadcast(sketch(docs, k))
    full_path = store(signatures(docs, counts, k, similar))
    counts.destroy()
    signed = spark.read.parquet(full_path)
    classes = signed.where("n > 0").groupBy("class").agg(F.min("row_key").alias("row_key"))
    once = signed.join(classes, ["class", "row_key"]).dropDuplicates(["class"])
    once_path = store(once.select("class", "row_key", "n", "first"))
    signed = spark.read.parquet(store(signed.drop("first")))
    erase(spark, full_path)
    once = spark.read.parquet(once_path)
    shared_path = store(shared_index(once))
    shared = spark.read.parquet(shared_path)
    grouped_path = store(groups_of(shared))
    grouped = spark.read.parquet(grouped_path)
    wanted = once.select("class", "row_key").join(grouped.select("class"), "class")
    text_path = store(docs.join(wanted, "row_key").dropDuplicates(["class"]).select("class", "text"))
    erase(spark, once_path)
    asked_path = store(asked_parts(shared, grouped, similar))
    erase(spark, shared_path)
    release(spark)
    asked = spark.read.parquet(asked_path)
    links_path = store(verify(grouped.select("group", "part", "class"), asked, spark.read.parquet(text_path), k, similar))
    erase(spark, text_path, asked_path, grouped_path)
    release(spark)
    return signed, spark.read.parquet(links_path)


def grouped_rows(docs: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, component) of each row; component tells components apart
    whatever their ids are, and is null where a row has no shingles."""
    signed, links = link_classes(docs, k, similar)
    labels = components(links)
    own = signed.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    linked = own.join(labels.withColumnRenamed("node", "class"), "class")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("class", "component", "component_id")
    of_class = own.join(linked, "class", "left").select("class", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", "class").alias("component"))
    some = signed.where("n > 0").join(of_class, "class").select("doc_id", "row_key", "n", "component_id", "component")
    none = signed.where("n = 0").select("doc_id", "row_key", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return some.union(none).select("doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), "component_id", "component")


def join(docs: DataFrame, k: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id) of each row."""
    return grouped_rows(docs, k, similar).drop("component")


def keep_one(docs: DataFrame, k: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One document of each component, that of the smallest id (null ids last, then the least row_key), and
    one row of each document without words. Repeated and null ids make no difference to what is linked; all columns stay, whatever they are called."""
    found = grouped_rows(docs, k, similar)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"]
    chosen = found.where("n_shingles > 0").groupBy("component").agg(best.alias("row_key")).select("row_key")
    chosen = chosen.union(found.where("n_shingles = 0").select("row_key")).distinct()
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("held"), row_key("doc_id", "text").alias("row_key"))
    return held.join(chosen, "row_key", "left_semi").dropDuplicates(["row_key"]).select("held.*")
