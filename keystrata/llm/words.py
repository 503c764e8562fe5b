"""Words of many texts at once, as positions and 64-bit hashes in flat numpy arrays.

A word's hash is a polynomial over random 64-bit values of its bytes, finished by a bit mixer, so it
depends on the bytes only: equal in every process and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import lean

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: shifts and odd multiplications."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xBF58476D1CE4E5B9))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=U)
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * U(step)
        done, step = done + take, step * step % (1 << 64)
    return out


class Splitter:
    """Finds the words of texts. separators: the bytes between words. fold: A-Z count as a-z."""

    def __init__(self, separators: bytes, fold: bool):
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False
        lower = np.arange(256)
        if fold:
            lower[65:91] += 32
            self.inside[65:91] = self.inside[97:123]
        self.value = byte_values()[lower]
        self.grown = 0

    def split(self, texts: pa.Array) -> Words:
        return Words(self, texts)

    def ready(self, n: int) -> None:
        if n > self.grown:
            self.grown = max(n, 2 * self.grown)
            self.up, self.down = powers(_BASE, self.grown), powers(_BASE_INVERSE, self.grown)


class Words:
    """starts, ends: byte positions in data; hashes: one for each word; bounds: words of text i are
    bounds[i] .. bounds[i+1]-1. A null text has no words."""

    def __init__(self, splitter: Splitter, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(len(texts) + 1, dtype=np.int64)
        low = int(offsets[0]) if len(offsets) else 0
        self.offsets = offsets - low
        n = int(self.offsets[-1])
        self.data = np.frombuffer(data, dtype=np.uint8)[low : low + n] if data else np.zeros(0, dtype=np.uint8)
        if not n:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
            self.hashes, self.bounds = np.zeros(0, dtype=U), np.zeros(len(texts) + 1, dtype=np.int64)
            return
        m = splitter.inside[self.data]
        first = m.copy()
        first[1:] &= ~m[:-1]
        last = m.copy()
        last[:-1] &= ~m[1:]
        edges = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        first[edges] = m[edges]
        last[edges[1:] - 1] = m[edges[1:] - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        splitter.ready(n)
        sums = splitter.value[self.data]
        sums *= splitter.up[:n]
        np.cumsum(sums, out=sums)
        self._sums, self._down = sums, splitter.down
        self.hashes = self.part_hashes(self.starts, self.ends)

    def part_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any non-empty stretches of bytes; of a whole word, the word's."""
        if not len(starts):
            return np.zeros(0, dtype=U)
        before = np.where(starts > 0, self._sums[starts - 1], U(0))
        return mix((self._sums[ends - 1] - before) * self._down[starts])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


#: ASCII white space: blank and \t to \r.
WHITE = bytes([32, 9, 10, 11, 12, 13])
#: All of ASCII but digits and letters.
NOT_ALNUM = bytes(x for x in range(128) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words in a flat array (runs may cross texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U(0xC2B2AE3D27D4EB4F)
        out += hashes[j : j + n]
    return mix(out)


def inside_runs(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of k words that stay within one text."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    total = int(counts.sum())
    base = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)


def merged(mask: np.ndarray) -> list[dict]:
    """Runs of True as spans."""
    edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())]


def cut_text(data: bytes, starts: list[int], ends: list[int], spans: list[tuple[int, int]]) -> bytes:
    """A text without spans of its words; what stands between the words of a span goes with them."""
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]])


def cut_spans(found: DataFrame, separators: bytes, schema: StructType) -> DataFrame:
    """Rows of the given schema from rows that also have spans (of words, in order, apart). Texts
    that lose all their words go as rows; rows without spans stay as they are; n_chars, where there
    is such a column, follows the text."""
    return found.mapInArrow(lean(cutting(separators, schema.names)), schema)


def cutting(separators: bytes, columns: list[str]):
    """The step of cut_spans over batches."""

    def run(batches):
        splitter = Splitter(separators, fold=False)
        for batch in batches:
            spans = batch.column("spans")
            some = pa.compute.greater(pa.compute.list_value_length(spans).fill_null(0), 0)
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            texts, keep = None, np.ones(batch.num_rows, dtype=bool)
            if len(at):
                picked = batch.column("text").take(pa.array(at))
                rows = picked.to_pylist()
                texts = batch.column("text").to_pylist()
                for i, text, cut in zip(at.tolist(), rows, spans.take(pa.array(at)).to_pylist()):
                    w = splitter.split(pa.array([text]))
                    data = cut_text(text.encode(), w.starts.tolist(), w.ends.tolist(), [(s["start"], s["end"]) for s in cut])
                    texts[i] = data.decode()
                    keep[i] = sum(s["end"] - s["start"] for s in cut) < len(w.hashes)
            new = {}
            if texts is not None:
                new["text"] = pa.array(texts, batch.schema.field("text").type)
                if "n_chars" in columns:
                    sizes = batch.column("n_chars").to_pylist()
                    for i in at.tolist():
                        sizes[i] = len(texts[i])
                    new["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            out = pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], columns)
            yield out.filter(pa.array(keep)) if not keep.all() else out

    return run
