"""Nearest neighbours by a block matrix join of int8 tiles.

Queries are dealt to blocks and candidates to tiles, and each cell of the grid (block, tile) becomes one group of a
shuffle: a task holds the block's queries and streams the tile's candidates past them. Nothing passes through the
driver, and no pair is ever shuffled. Vectors are quantised to int8 with one scale each; the product of two
quantised vectors is off from the true inner product by at most ``|q| |e_x| + |e_q| |x^|`` (e: the
quantisation error, x^: the quantised vector), which is known for every pair. A query keeps the pairs
whose upper bound reaches its k-th best lower bound so far; these alone are recomputed in double
precision and go into the query's heap of k. The heaps of a query's cells are merged by a last aggregation.

The search is exact: the bounds are proven, so recall is 1.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; null ids take
no part; vectors meet those of their own length only; repeated ids are separate candidates, but for the
query's own id; equal query rows (id and vector) are one query, different vectors under one id are queries of their
own, each with its own list; ties go to the smaller id; fewer candidates than k are all returned; clashing extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_by_value

#: Queries of a block; candidates of a tile at least and at most; candidates multiplied at once.
QUERY_BLOCK, LEAST_TILE, MOST_TILE, STEP = 8192, 8192, 1 << 18, 2048


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id long, v array<double>) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scale, norm of the quantised row, norm of its error (rounded up)."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1) * (1 + 1e-9), np.linalg.norm(x - back, axis=1) * (1 + 1e-9) + 1e-300


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Searcher:
    """The best k of the candidates seen so far for each query of a block, in a heap for each: the worst on top."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.q, self.scale, self.norm, self.error = quantise(vectors)
        self.wide = self.q.astype(np.float32)  # products of int8 are exact in float32 up to 1040 dimensions
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]  # (score, -id)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        q, scale, norm, error = quantise(x)
        kind = np.float32 if x.shape[1] <= 1040 else np.float64
        near = (self.wide.astype(kind, copy=False) @ q.T.astype(kind)).astype(np.float64) * self.scale[:, None] * scale
        off = (self.norm[:, None] + self.error[:, None]) * error + self.error[:, None] * norm + 1e-12 * (1 + np.abs(near))
        own = self.ids[:, None] == ids
        floor = self.floor
        if len(ids) >= self.k:
            low = np.where(own, -np.inf, near - off)
            floor = np.maximum(floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        row, column = np.nonzero((near + off >= floor[:, None]) & ~own)
        if not len(row):
            return
        score = exact(self.vectors[row], x[column])
        for r, entry in zip(row.tolist(), zip(score.tolist(), (-ids[column]).tolist())):
            heap = self.heaps[r]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        for r in np.unique(row).tolist():
            if len(self.heaps[r]) == self.k:
                self.floor[r] = self.heaps[r][0][0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of all heaps."""
        place = np.repeat(np.arange(len(self.heaps)), [len(h) for h in self.heaps])
        entries = [e for h in self.heaps for e in h]
        return place, -np.array([i for _, i in entries], dtype=np.int64), np.array([s for s, _ in entries], dtype=np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK, tile: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): of every query, its k nearest by inner product but itself."""
    ship_by_value()
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector).withColumn("d", F.size("v"))
    asked = usable(queries, key, vector).withColumn("d", F.size("v")).distinct()
    tasks = 2 * spark.sparkContext.defaultParallelism
    size = F.lit(tile) if tile else F.least(F.greatest(F.ceil(F.col("n") / tasks), F.lit(LEAST_TILE)), F.lit(MOST_TILE))
    # one row for each length of vectors
    grid = rows.groupBy("d").agg(F.count("*").alias("n")).join(asked.groupBy("d").agg(F.count("*").alias("m")), "d")
    grid = F.broadcast(grid.select("d", F.ceil(F.col("n") / size).cast("int").alias("tiles"), F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = asked.join(grid, "d").select("d", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"), each(F.col("tiles")).alias("tile"), F.lit(0).alias("side"), "id", "v")
    passed = rows.join(grid, "d").select("d", each(F.col("blocks")).alias("block"), F.pmod(F.monotonically_increasing_id(), F.col("tiles")).cast("int").alias("tile"), F.lit(1).alias("side"), "id", "v")
    cells = held.union(passed).repartition("d", "block", "tile").sortWithinPartitions("d", "block", "tile", "side")
    found = cells.mapInArrow(_search(k), "query_id long, query long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(k: int):
    """Cell by cell: the queries come first. query tells different vectors of one id apart."""

    def done(searcher: Searcher, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        place, found, score = searcher.rows()
        for a in range(0, len(place), 1 << 16):
            b = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(searcher.ids[place[a:b]]), pa.array(number[place[a:b]]), pa.array(found[a:b]), pa.array(score[a:b])], ["query_id", "query", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]):
        at, ids, vectors, searcher, number = None, [], [], None, None
        for batch in batches:
            cell = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("d", "block", "tile", "side")])
            cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == stop:
                    continue
                d, *place, side = cell[:, start].tolist()
                part = batch.slice(start, stop - start)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                names = part.column("id").to_numpy()
                if (d, *place) != at:
                    if searcher is not None:
                        yield from done(searcher, number)
                    at, ids, vectors, searcher = (d, *place), [], [], None
                if not side:
                    ids.append(names)
                    vectors.append(x)
                    continue
                if not ids:
                    continue
                if searcher is None:
                    searcher = Searcher(np.concatenate(ids), np.concatenate(vectors), k)
                    number = np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in searcher.vectors], dtype=np.int64)
                for first in range(0, len(names), STEP):
                    searcher.add(names[first : first + STEP], x[first : first + STEP])
        if searcher is not None:
            yield from done(searcher, number)

    return run
