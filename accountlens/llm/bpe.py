"""Byte-level BPE: text to token ids and back, by the ranks of a public vocabulary.

Text is split by a pattern, each piece is encoded on its own. A piece that is itself in the
vocabulary is resolved by a minimal perfect hash; any other piece is merged with a heap of
neighbouring pairs over linked bytes. A task remembers the pieces of late and looks them up once.

Null and empty texts have no ids. Texts of any length are cut between pieces and encoded whole.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.llm.common import REMEMBERED_WORDS, TEXT_SLICE, map_arrow, mixed

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts that a task holds with their ids at a time.
ROWS = 1024
#: Seeds tried at a time.
_TRIED = 32
#: Where a piece always ends: before a single space between two other characters.
_CUT = regex.compile(r"(?<=\S) (?=\S)")


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys in n slots.

    Keys fall into small buckets. Buckets of two and more, largest first, get the first seed that
    sends their keys to free slots; single keys take the slots that are left, by number.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        hashes = self.hashes(keys)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys repeat")
        self.buckets = max(1, n // 2)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if n else []
        groups.sort(key=len, reverse=True)
        self.slots = n
        self.seeds = np.zeros(self.buckets, dtype=np.int64)
        self.key_at = np.full(n, -1, dtype=np.int64)
        free: list[int] | None = None
        for group in groups:
            b = bucket[group[0]]
            if len(group) == 1:
                if free is None:
                    free = list(np.flatnonzero(self.key_at < 0))
                slot = free.pop()
                self.seeds[b] = -1 - slot
                self.key_at[slot] = group[0]
                continue
            seed, found = 0, None
            while found is None:
                seeds = np.arange(seed, seed + _TRIED, dtype=np.uint64)
                slots = self._spread(hashes[group][None, :], seeds[:, None])
                apart = (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                fits = np.flatnonzero(apart & (self.key_at[slots] < 0).all(axis=1))
                found = int(fits[0]) if len(fits) else None
                seed += _TRIED
            self.seeds[b] = seeds[found]
            self.key_at[slots[found]] = group

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _spread(self, hashes: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return (mixed(hashes + (seed + np.uint64(1)) * _STEP) % np.uint64(self.slots)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """Number of the key that each one can only be; a key that is not there gets any number."""
        hashes = self.hashes(keys)
        seeds = self.seeds[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(seeds < 0, -1 - seeds, self._spread(hashes, np.maximum(seeds, 0).astype(np.uint64)))
        return self.key_at[slots]


class Vocabulary:
    """Tokens and ids of a rank file, with the perfect hash of the tokens."""

    def __init__(self, tokens: list[bytes], ids: list[int]) -> None:
        self.tokens, self.ids = tokens, np.array(ids, dtype=np.int64)
        self.hash = PerfectHash(tokens)
        self.encoders: dict[str, Encoder] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"encoders": {}}

    def encoder(self, pattern: str) -> Encoder:
        """The encoder of a pattern; it and the pieces it remembers serve all tasks of a worker."""
        if pattern not in self.encoders:
            self.encoders[pattern] = Encoder(self, pattern)
        return self.encoders[pattern]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls([base64.b64decode(t) for t, _ in pairs], [int(r) for _, r in pairs])


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall
        self.rank = dict(zip(vocabulary.tokens, vocabulary.ids.tolist()))
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece: the pair of lowest rank, leftmost first, is merged until none is left."""
        rank, n = self.rank.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank, start and end of a pair in one number: numbers compare faster than tuples
        bits = n.bit_length()
        low, both = (1 << bits) - 1, 2 * bits
        heap = [
            (r << both) + (i << bits) + i + 2
            for i in range(n - 1)
            if (r := rank(piece[i : i + 2])) is not None
        ]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, end = entry >> bits & low, entry & low
            j = after[i]
            # stale: i was merged into its left neighbour, or one of the two has grown since
            if j < 0 or j >= n or after[j] != end:
                continue
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                last = after[end]
                if (r := rank(piece[i:last])) is not None:
                    heappush(heap, (r << both) + (i << bits) + last)
            if (h := before[i]) >= 0 and (r := rank(piece[h:end])) is not None:
                heappush(heap, (r << both) + (h << bits) + end)
        ids, i = [], 0
        while i < n:
            ids.append(rank(piece[i : after[i]]))
            i = after[i]
        return tuple(ids)

    def table(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pieces, and of some seen before."""
        known = self.known
        new = pieces - known.keys()
        if len(known) + len(new) > REMEMBERED_WORDS:
            known.clear()
            new = pieces
        listed = list(new)
        raw = [p.encode() for p in listed]
        tokens = self.vocabulary.tokens
        found = self.vocabulary.hash.lookup(raw).tolist() if raw else []
        ids = self.vocabulary.ids
        for p, r, k in zip(listed, raw, found):
            known[p] = (int(ids[k]),) if tokens[k] == r else self.merged(r)
        return known

    def encode_array(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text; the distinct pieces are looked up once, the texts put together from them."""
        split = [self.pieces(t) for t in texts]
        distinct = list(set(chain.from_iterable(split)))
        known = self.table(set(distinct))
        place = dict(zip(distinct, range(len(distinct))))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        table = pa.array([known[p] for p in distinct], pa.list_(pa.int32()))
        lengths = np.diff(table.offsets.to_numpy())[numbers] if distinct else numbers
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(pa.array(numbers)).flatten())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encode_array(texts).to_pylist()

    def encode_long(self, text: str) -> list[int]:
        """Ids of one text, a slice at a time."""
        return self.long_array(text).to_pylist()[0]

    def long_array(self, text: str) -> pa.ListArray:
        """As ``encode_array``, of one text, a slice at a time."""
        ids: list[pa.Array] = []
        start = 0
        while start < len(text):
            cut = _CUT.search(text, start + TEXT_SLICE) if len(text) - start > TEXT_SLICE else None
            end = cut.start() if cut else len(text)
            ids.append(self.encode_array([text[start:end]]).flatten())
            start = end
        flat = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def encode(
    docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>) of each row's whole text; no shuffle, rows that repeat each give a row.

    The vocabulary file is read once, on the driver, and broadcast: its size is that of a rank file,
    whatever the corpus. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.read(vocabulary_path))

    def make():
        encoder = vocabulary.value.encoder(pattern)

        def work(batch: pa.RecordBatch) -> list:
            ids: list[pa.Array] = []
            held: list[str] = []
            size = 0

            def flush() -> None:
                nonlocal size
                if held:
                    ids.append(encoder.encode_array(held))
                    held.clear()
                    size = 0

            for value in batch.column(1):
                text = value.as_py() or ""
                if len(text) > TEXT_SLICE:
                    flush()
                    ids.append(encoder.long_array(text))
                    continue
                held.append(text)
                size += len(text)
                if size > TEXT_SLICE:
                    flush()
            flush()
            listed = pa.concat_arrays(ids) if ids else pa.array([], pa.list_(pa.int32()))
            return [batch.column(0), listed]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        make,
        f"id {kind}, ids array<int>",
        most_rows=ROWS,
    ).withColumnRenamed("id", id_col)


def _strings(tokens: pa.Array, parts: list[pa.Array], counts: list[int]) -> list[bytes]:
    """The tokens of each row's ids, joined; ``parts`` are the ids of rows that have any."""
    if not parts:
        return [b""] * len(counts)
    taken = tokens.take(pa.concat_arrays(parts))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(counts)])].tolist()
    data = memoryview(taken.buffers()[2]) if taken.buffers()[2] else memoryview(b"")
    return [bytes(data[s:e]) for s, e in zip(ends[:-1], ends[1:])]


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes that the ids stand for; null ids are none."""
    with open(vocabulary_path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    listed = [b""] * (max((int(r) for _, r in pairs), default=-1) + 1)
    for token, rank in pairs:
        listed[int(rank)] = base64.b64decode(token)
    strings = encoded.sparkSession.sparkContext.broadcast(listed)

    def make():
        tokens = pa.array(strings.value, pa.large_binary())

        def work(batch: pa.RecordBatch) -> list:
            rows = batch.column(1)
            out, counts, held = [], [], 0
            parts = []
            for row in rows:
                ids = row.values if row.is_valid else None
                counts.append(len(ids) if ids is not None else 0)
                if counts[-1]:
                    parts.append(ids)
                held += counts[-1]
                # a bounded number of ids is put together at a time
                if held >= TEXT_SLICE:
                    out += _strings(tokens, parts, counts)
                    counts, parts, held = [], [], 0
            out += _strings(tokens, parts, counts)
            return [batch.column(0), rows, pa.array(out, pa.binary())]

        return work

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_arrow(
        encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")),
        make,
        f"id {kind}, ids array<int>, decoded binary",
    ).withColumnRenamed("id", id_col)
