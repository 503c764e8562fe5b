"""BPE encoding and decoding with a given vocabulary, by batched numpy merge rounds.

The pieces of many texts stand in one flat array of symbols. A round looks up every pair of
neighbours by binary search among the sorted pair keys, takes the lowest rank of each piece and
merges all its occurrences, left before right; pieces without a known pair leave. Pieces over
``LONG_PIECE`` symbols would keep the array busy for many rounds; their rounds are apart and touch only the pairs
of the round's rank. Both need merges to be ranked after those that make their parts, which is checked of
a vocabulary when it is read: then no merge brings up a pair of a lower rank.

Defined cases: a null text encodes like the empty text (no ids, empty decoded text); special tokens
written out in a text become their ids; any other columns of the input are ignored; equal rows
give equal results; texts and pieces of any length are encoded whole; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, prepare

#: Fixed values of byte-level BPE: the pattern that splits texts before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over texts of ASCII only, where a simpler engine does.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
LONG_PIECE = 400
#: Pieces that a task remembers before it starts afresh.
REMEMBERED = 400_000


def visible_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable Latin-1 stands for
    itself, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ragged(starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the elements of the picked rows of a ragged array, and where each row ends."""
    n = sizes[pick]
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[pick] - (ends - n), n), ends


class Seen(dict):
    """Numbers pieces as they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Codec:
    """Encodes and decodes with the vocabulary of a tokenizers file (byte-level BPE)."""

    def __init__(self, spec: str):
        import regex

        d = json.loads(spec)
        model = d["model"]
        kind = (d.get("pre_tokenizer") or {}).get("type")
        if model.get("type", "BPE") != "BPE" or kind != "ByteLevel" or d.get("normalizer") or d["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix blank is needed")
        to_byte = visible_bytes()
        vocab = model["vocab"]
        words = [(i, bytes(to_byte[c] for c in t)) for t, i in vocab.items()]
        added = d.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in blanks aren't supported")
        words += [(t["id"], t["content"].encode()) for t in added]
        names = [b""] * (max(i for i, _ in words) + 1)
        for i, w in words:
            names[i] = w
        self.added = {t["content"]: t["id"] for t in added}
        self.by_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.texts = self._blob(names)
        self.decimals = self._blob([b"%d," % i for i in range(len(names))])
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in to_byte.items():
            self.first[b] = vocab[c]
        pairs = [(p.split(" ") if isinstance(p, str) else p) for p in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        made = np.full(max(i for i, _ in words) + 1, -1)
        np.maximum.at(made, self.merged, np.arange(len(pairs)))
        if (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge is ranked before one that makes its parts")
        self.pieces, self.ascii_pieces = regex.compile(PIECES).findall, re.compile(ASCII_PIECES, re.ASCII).findall
        self._forget()

    @staticmethod
    def _blob(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array(list(map(len, rows)), dtype=np.int64)
        return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(rows), dtype=np.uint8)

    def _forget(self) -> None:
        self.seen, self.known = Seen(), 0
        self.starts = self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def merge(self, pieces: list[bytes]) -> list[np.ndarray] | tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces, and how many each has."""
        none = len(self.keys)
        sizes = np.array(list(map(len, pieces)), dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        done_at, done_ids = [], []
        long = sizes > LONG_PIECE
        if long.any():
            keep = ~long[piece]
            some, at = symbols[~keep], piece[~keep]
            stay = self._merge_long(some, at)
            done_ids.append(some[stay])
            done_at.append(at[stay])
            symbols, piece = symbols[keep], piece[keep]
        while len(symbols):
            ranks = np.full(len(symbols), none)
            same = piece[1:] == piece[:-1]
            at = np.flatnonzero(same)
            ranks[at] = self._ranks(symbols[at], symbols[at + 1])
            heads = np.flatnonzero(np.concatenate(([True], ~same)))
            lowest = np.minimum.reduceat(ranks, heads)
            spans = np.diff(np.append(heads, len(symbols)))
            least = np.repeat(lowest, spans)
            over = least == none
            if over.any():
                done_at.append(piece[over])
                done_ids.append(symbols[over])
            hit = (ranks == least) & ~over
            at = np.flatnonzero(hit)
            if len(at):  # of overlapping pairs (a a a), every second one from the left
                fresh = np.concatenate(([True], (np.diff(at) > 1)))
                lead = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - lead) % 2 == 0]
                symbols[at] = self.merged[ranks[at]]
                over[at + 1] = True
            symbols, piece = symbols[~over], piece[~over]
        at = np.concatenate(done_at) if done_at else np.zeros(0, dtype=np.int64)
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, dtype=np.int64)
        order = np.argsort(at, kind="stable")
        return ids[order].astype(np.int32), np.bincount(at, minlength=len(pieces)).astype(np.int64)

    def _merge_long(self, symbols: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Long pieces, as many as there are: a round takes the lowest rank that any of them has and merges all its
        occurrences, left before right. Pairs are kept by rank, so a round touches only its own pairs and their
        neighbours. symbols is merged in place; returns which of them stay."""
        n, none = len(symbols), len(self.keys)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        edges = np.flatnonzero(piece[1:] != piece[:-1]) + 1
        after[edges - 1], before[edges] = n, -1
        rank = np.full(n, none)
        held: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(at: np.ndarray) -> None:
            at = at[after[at] < n]
            found = self._ranks(symbols[at], symbols[after[at]])
            rank[at] = found
            at, found = at[found < none], found[found < none]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, some in zip(found[np.append(0, cuts)].tolist() if len(found) else (), np.split(at, cuts)):
                if r not in held:
                    held[r] = []
                    heapq.heappush(heap, r)
                held[r].append(some)

        look_up(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(held.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            fresh = np.concatenate(([True], after[at[:-1]] != at[1:]))  # of overlapping pairs, every second one
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - lead) % 2 == 0]
            gone = after[at]
            symbols[at], symbols[gone] = self.merged[r], -1
            rank[at] = rank[gone] = none
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            left = before[at]
            left = left[left >= 0]
            rank[left] = none
            look_up(np.unique(np.concatenate((left, at))))
        return symbols >= 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and where each text ends."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        rows: list[int] = []
        ends = []
        number = self.seen.__getitem__
        for text in texts:
            text = text or ""
            for part in self.by_added.split(text) if self.by_added and any(t in text for t in self.added) else (text,):
                if part in self.added:
                    rows.append(-1 - self.added[part])
                elif part:
                    rows.extend(map(number, (self.ascii_pieces if part.isascii() else self.pieces)(part)))
            ends.append(len(rows))
        if len(self.seen) > self.known:
            fresh = list(self.seen)[self.known :] if self.known else list(self.seen)
            ids, sizes = self.merge([p.encode() for p in fresh])
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
            self.known = len(self.seen)
        pick = np.array(rows, dtype=np.int64)
        special = pick < 0
        if special.any():  # their ids stand behind those of the pieces
            extra = -1 - pick[special]
            starts = np.concatenate((self.starts, len(self.ids) + np.arange(len(extra))))
            sizes, flat = np.concatenate((self.sizes, np.ones(len(extra), dtype=np.int64))), np.concatenate((self.ids, extra.astype(np.int32)))
            pick[special] = len(self.starts) + np.arange(len(extra))
        else:
            starts, sizes, flat = self.starts, self.sizes, self.ids
        at, piece_ends = ragged(starts, sizes, pick)
        ends = np.array(ends, dtype=np.int64)
        return flat[at], np.where(ends > 0, np.append(piece_ends, 0)[ends - 1], 0)

    def joined(self, blob: tuple, ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """For each text, the blob's rows of its ids, one after the other."""
        starts, sizes, data = blob
        at, stops = ragged(starts, sizes, ids)
        out = data[at].tobytes()
        cut = np.where(ends > 0, np.append(stops, 0)[ends - 1], 0).tolist()
        return (out[a:b] for a, b in zip([0, *cut], cut))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        return [b.decode("utf-8", "replace") for b in self.joined(self.texts, ids, ends)]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoded(batches, spec: str, text: str) -> Iterator[tuple[pa.RecordBatch, Codec, np.ndarray, np.ndarray]]:
    codec = Codec(spec)
    for batch in chunks(batches, text):
        yield batch, codec, *codec.encode(batch.column(text).to_pylist())


def encode(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row."""
    prepare(docs)

    def run(batches):
        for batch, _, ids, ends in _encoded(batches, spec, text):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, spec: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of each row of ids; null ids give an empty text."""
    prepare(encoded)

    def run(batches):
        codec = Codec(spec)
        for batch in batches:
            rows = [x or [] for x in batch.column(ids).to_pylist()]
            flat = np.array([i for x in rows for i in x], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(codec.decode(flat, np.cumsum([len(x) for x in rows])), pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, and digests both."""
    prepare(docs)

    def run(batches):
        for batch, codec, ids, ends in _encoded(batches, spec, text):
            sha = [hashlib.sha256(b[:-1]).hexdigest() for b in codec.joined(codec.decimals, ids, ends)]
            back = [hashlib.sha256(t.encode()).hexdigest() for t in codec.decode(ids, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
