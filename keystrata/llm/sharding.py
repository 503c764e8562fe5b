"""Shards of near equal bytes that keep equal texts together: minimax contiguous partition.

Atomic groups (equal texts, by a 62-bit hash of the text) are ordered by hash. The smallest feasible
shard capacity is found by binary search; a capacity is feasible if a greedy fill needs no more
shards than there are. There is no list of all groups anywhere: the driver holds *cells*, ranges of
hashes with their bytes (at most a few ten thousand), and Spark splits only those cells that a cut
could fall into, again and again, until these are single groups and the answer is exact. DataFrame
functions do all work on rows.

Defined cases: null and empty texts are one group and take one byte a row; repeated rows each get
their own slot, and rows of one repeated or null id are numbered in parallel like any others; a group is
never cut, so a very long text or a frequent one may make its shard larger than a fair share; of several
ways to cut under the smallest capacity the one nearest to fair shares is taken, and equal sizes are told
apart by hash; fewer groups than shards leave shards empty; other columns are ignored, whatever they are
called; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Cells that a hash range is split into: on the first pass and on each later one, in bits.
FIRST_BITS, NEXT_BITS = 12, 8
HASH_BITS = 62
#: Ranges of hashes of ids, texts and row numbers by which the rows of a shard are numbered in parallel.
SLOT_RANGES = 512


@dataclass(frozen=True)
class Cell:
    low: int  # first and last hash in it
    high: int
    size: int


def feasible(sizes: list[int], capacity: int, shards: int) -> bool:
    """Greedy: can the ordered sizes be filled into so many shards of that capacity?"""
    used, load = 1, 0
    for s in sizes:
        if s > capacity:
            return False
        if load + s > capacity:
            used, load = used + 1, 0
        load += s
    return used <= shards


def smallest_capacity(sizes: list[int], shards: int) -> int:
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(sizes, middle, shards) else (middle + 1, high)
    return low


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """Indexes of the first item of each shard but the first."""
    cuts, load = [], 0
    for i, s in enumerate(sizes):
        if load and load + s > capacity:
            cuts, load = [*cuts, i], 0
        load += s
    return cuts


def even_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts under the capacity that also share out what is left evenly, where that is possible: a
    group larger than a fair share else leaves the last shards empty."""
    cuts, load, left, free = [], 0, sum(sizes), shards
    for i, s in enumerate(sizes):
        fair = (load + left) / free
        if load and free > 1 and (load + s > capacity or load + s - fair > fair - load):
            cuts.append(i)
            free, load = free - 1, 0
        load, left = load + s, left - s
    loads = [sum(sizes[x:y]) for x, y in zip([0, *cuts], [*cuts, len(sizes)])]
    return cuts if max(loads, default=0) <= capacity else greedy_cuts(sizes, capacity)


def open_cells(cells: list[Cell], shards: int) -> list[int]:
    """Cells of several groups that a cut could fall into, for any capacity that may be the smallest.

    With cells as atoms a capacity is feasible, so none above it is needed; none below a fair share
    or the largest group can be. Whatever the groups, a fill of the lowest capacity ends in or at the
    start of the cell that its last byte would fall into; k fills of the highest end at most there."""
    ends, total = [], 0
    for c in cells:
        total += c.size
        ends.append(total)
    high = smallest_capacity([c.size for c in cells], shards)
    low = max([-(-total // shards), *(c.size for c in cells if c.low == c.high)])
    found: set[int] = set()
    least = most = 0
    for _ in range(shards - 1):
        first = bisect_right(ends, least + low)
        least = ends[first - 1] if first else 0
        most = min(total, most + high)
        found.update(range(first, min(bisect_right(ends, most), len(cells) - 1) + 1))
    return sorted(i for i in found if cells[i].low != cells[i].high)


def cells_of(rows: DataFrame, within: list[Cell], bits: int) -> list[Cell]:
    """The hash ranges cut into about 2**bits cells each, with bytes and true first and last hash."""
    ranges = [(c.low, c.high, max(0, (c.high - c.low + 1).bit_length() - 1 - bits)) for c in within]
    bounds = rows.sparkSession.createDataFrame(ranges, "low long, high long, shift int")
    joined = rows.join(F.broadcast(bounds), F.col("h").between(F.col("low"), F.col("high")))
    cell = F.expr("shiftright(h - low, shift)")
    found = joined.groupBy("low", cell.alias("cell")).agg(F.sum("size").alias("size"), F.min("h").alias("a"), F.max("h").alias("z"))
    out = [Cell(r["a"], r["z"], r["size"]) for r in found.collect()]  # at most len(within) * 2**(bits + 1) rows
    return sorted(out, key=lambda c: c.low)


def plan_cuts(rows: DataFrame, shards: int) -> tuple[list[int], int]:
    """First hash of each shard but the first, and the smallest capacity. rows: (h, size)."""
    cells = cells_of(rows, [Cell(0, (1 << HASH_BITS) - 1, 0)], FIRST_BITS)
    while again := open_cells(cells, shards):
        chosen = set(again)
        finer = cells_of(rows, [cells[i] for i in again], NEXT_BITS)
        cells = sorted([c for i, c in enumerate(cells) if i not in chosen] + finer, key=lambda c: c.low)
    sizes = [c.size for c in cells]
    capacity = smallest_capacity(sizes, shards)
    return [cells[i].low for i in even_cuts(sizes, capacity, shards)], capacity


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard); law is always ``bytes``."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(body), 64 - HASH_BITS).alias("h"), F.monotonically_increasing_id().alias("own"))
    rows = settle(rows)  # a few bytes a row; the texts are read once
    cuts, _ = plan_cuts(rows.select("h", "size"), shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("h") >= F.lit(c)).cast("int")
    rows = rows.withColumn("shard", number)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.col(key), "h", "own"), F.lit(SLOT_RANGES)).cast("int"))
    counts = rows.groupBy("shard", "part").count()  # shards * SLOT_RANGES rows at most
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy(key, "h", "own"))
    out = rows.withColumn("n", within).join(F.broadcast(before), ["shard", "part"])
    return out.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
