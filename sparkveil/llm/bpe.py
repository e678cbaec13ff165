"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash, displace) resolves the distinct pre-tokens of a
step at once; a hit is confirmed on its bytes. Tier two: a pre-token outside the vocabulary is merged by rank
with a heap over doubly linked byte parts. Results of tier two are kept per worker up to a fixed number.

The rank file holds a fixed vocabulary (about 1 MB), so shipping it to every task is safe at any input size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkveil.llm._common import map_arrow, slices
from sparkveil.llm._words import mix, span_hashes

#: Pre-tokens outside the vocabulary whose merges a worker remembers in each of two generations: when the younger
#: one is full it becomes the older one, and what is asked for again moves to the younger. Others are merged again.
CACHE_TOKENS = 150_000
#: Rows that are decoded in one step.
DECODE_ROWS = 256


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: slot = mix(hash + displacement of its bucket) mod n."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        hashes = self._hash(keys)
        if len(np.unique(hashes)) < n:
            raise ValueError("keys must be distinct")
        self.buckets = max(1, n // 3)
        self.shift = np.zeros(self.buckets, np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        self.keys: list[bytes] = [b""] * n
        for b in sorted(range(self.buckets), key=lambda b: cuts[b] - cuts[b + 1]):
            own = order[cuts[b] : cuts[b + 1]]
            if not len(own):
                break
            base, step = 0, 32
            while True:
                tries = np.arange(base, base + step, dtype=np.uint64)
                slots = self._slot(hashes[own][None, :], tries[:, None])
                free = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    ranked = np.sort(slots, axis=1)
                    free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if free.any():
                    at = int(np.argmax(free))
                    break
                base, step = base + step, min(step * 2, 8192)
            self.shift[b] = tries[at]
            taken[slots[at]] = True
            for key, slot in zip(own, slots[at]):
                self.keys[slot] = keys[key]

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(k) for k in keys])
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        return span_hashes(b"".join(keys), starts, ends)

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashes + shift * np.uint64(0xD1B54A32D192ED03)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, -1 where the key is not one of those hashed."""
        if not keys or not self.n:
            return np.full(len(keys), -1)
        hashes = self._hash(keys)
        found = self._slot(hashes, self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)])
        own = self.keys
        return np.array([s if own[s] == k else -1 for s, k in zip(found.tolist(), keys)])


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the linked bytes of piece, always the pair of lowest rank, leftmost first. A tuple of integers is kept
    without cost to the garbage collector, which lists by the hundred thousand are not."""
    n = len(piece)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    rank_of = ranks.get
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, end = pop(heap)
        j = after[i] if ends[i] else n
        if j >= n or ends[j] != end:
            continue
        ends[i], ends[j] = end, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of(piece[i : ends[k]])
            if rank is not None:
                push(heap, (rank, i, ends[k]))
        h = before[i]
        if h >= 0:
            rank = rank_of(piece[h:end])
            if rank is not None:
                push(heap, (rank, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return tuple(out)


class Codec:
    """Encodes and decodes with the ranks of a vocabulary, given as the bytes of its rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.split = regex.compile(pattern).findall
        self.hash = PerfectHash(list(self.ranks))
        self.slot_rank = np.array([self.ranks[k] for k in self.hash.keys], np.uint32)
        size = max(self.ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each pre-token."""
        out: list[tuple[int, ...]] = []
        young, old, ranks = self.young, self.old, self.ranks
        slots = self.hash.slots(pieces)
        for piece, slot, rank in zip(pieces, slots.tolist(), self.slot_rank[np.maximum(slots, 0)].tolist() if self.hash.n else slots.tolist()):
            if slot >= 0:
                out.append((rank,))
                continue
            ids = young.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = heap_merge(piece, ranks)
                if len(piece) <= 64:
                    if len(young) >= CACHE_TOKENS:
                        self.old, self.young = young, {}
                        young, old = self.young, self.old
                    young[piece] = ids
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        index: dict[str, int] = {}
        sequence: list[int] = []
        counts: list[int] = []
        for text in texts:
            pieces = self.split(text)
            counts.append(len(pieces))
            sequence += [index.setdefault(p, len(index)) for p in pieces]
        coded = self.encode_pieces([p.encode() for p in index])
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for ids in coded for i in ids), np.uint32, int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        which = np.array(sequence, np.int64)
        own = sizes[which]
        places = np.concatenate(([0], np.cumsum(own)))
        ids = flat[np.arange(places[-1]) + np.repeat(starts[which] - places[:-1], own)]
        cuts = places[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec per worker process, kept over its tasks."""
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, *, text: str = "text", ids: str = "token_ids", keep: list[str] | None = None, as_bytes: bool = False) -> DataFrame:
    """Add the column `ids`: array<int> of token ids, or with as_bytes their little-endian 32-bit form.

    A null text counts as empty and has no ids. Rows are kept one for one, repeated rows too, in any partitioning
    and without a shuffle. `keep` names the other columns to return (default: all; the new column replaces one
    of its name).
    """
    others = [c for c in (keep if keep is not None else docs.columns) if c != ids]
    need = list(dict.fromkeys([*others, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(column):
                part = batch.slice(a, b - a)
                coded = own.encode([t or "" for t in column.slice(a, b - a).to_pylist()])
                if as_bytes:
                    made = pa.array([c.astype("<u4").tobytes() for c in coded], pa.binary())
                else:
                    offsets = np.concatenate(([0], np.cumsum([len(c) for c in coded]))).astype(np.int32)
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded).astype(np.int32) if coded else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), made], names=[*others, ids])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{ids}` {'binary' if as_bytes else 'array<int>'}"])
    return map_arrow(docs.select(*(f"`{c}`" for c in need)), run, schema)


def decode(coded: DataFrame, rank_file: bytes, pattern: str, *, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the binary column `out`: the bytes that the ids (array<int> or their packed form) stand for. Null or
    empty ids decode to no bytes. Rows are kept one for one."""
    others = [c for c in coded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            packed = pa.types.is_binary(column.type)
            for a in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(a, DECODE_ROWS)
                made = [own.decode(np.frombuffer(v, "<u4") if packed else np.array(v, np.int64)) if v else b"" for v in (x.as_py() for x in column.slice(a, DECODE_ROWS))]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), pa.array(made, pa.binary())], names=[*others, out])

    kinds = dict(coded.dtypes)
    return map_arrow(coded.select(*(f"`{c}`" for c in others)), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{out}` binary"]))
