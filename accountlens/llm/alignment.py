"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the token pairs they make.

Both tokenizers split the same bytes. Offsets where both end a token cut the tokens into groups; an
occurrence of a token of A and one of B are linked where their bytes overlap. How often a pair of ids is
linked in the whole corpus is counted by external spilling:

- a task gathers (pair, document) records of the documents it encodes; a full buffer is sorted, with
  ids of B first, cut by radix of the id of B, and spilled as zstd runs, one a radix. A run is a
  directory of its pairs (count, number of documents) in blocks, and the documents of each pair;
- directories are merged radix by radix, a heap picking the block whose first pair comes next; at most
  ``FAN`` runs meet in a merge, whose result is a run for the next round. The last round sees the pairs
  of an id of B side by side, and marks the most frequent of them as it goes;
- counts flow back: the runs of a radix meet its counts, in slices of bounded size, and give each
  document its share; a buffer's shares are added up beside its documents.

A hot pair is one entry a run in the merges, however many documents hold it, and its documents are
spread over the slices of its radix. Tables are written to the shared folder between the steps.

A text that is null, empty, or that a tokenizer doesn't give back as space + text, has no tokens: zeros,
and '' as its groups. Rows that repeat, and rows of null id, are documents of their own and all count.
Only the id and text columns are read. A text is encoded whole, whatever its length.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from accountlens.llm.byte_level import ByteLevelTokenizer
from accountlens.llm.common import TEXT_SLICE, Scratch, checkpointed, map_groups

#: Parts that ids of B are dealt to.
RADIX = 64
#: Links of a buffer, about; a document is never divided.
BUFFER = 4_000_000
#: Bits for a document's number within its buffer.
_DOC_BITS = 20
#: Pairs of a block of a run.
BLOCK = 4096
#: Runs that meet in a merge at most, about.
FAN = 256
#: Pairs that a merge holds before it passes on those that are complete.
POOL = 64 * BLOCK
#: Records of a radix that take their counts in one group.
SLICE = 8_000_000

_DOCS = "buffer long, doc_no int, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups {groups}"
_RUNS = "radix long, run long, n_records long, heads array<long>, blocks array<binary>, posts binary"


class SpacedByteLevel:
    """Side A: space + text by a byte-level tokenizer; special tokens' strings are plain text."""

    def __init__(self, tokenizer: ByteLevelTokenizer) -> None:
        self.tokenizer = tokenizer

    @property
    def token_bytes(self) -> list[bytes]:
        return self.tokenizer.token_bytes

    def encode(self, texts: list[str]) -> list[list[int]]:
        encode = self.tokenizer.plain_ids
        return [encode(" " + t) for t in texts]


class PieceTokenizer:
    """Side B: a sentencepiece model, which puts the space before the text itself."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.model = f.read()

    def __getstate__(self) -> dict:
        return {"model": self.model}

    @cached_property
    def processor(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def token_bytes(self) -> list[bytes]:
        p = self.processor
        pieces = ((i, p.id_to_piece(i)) for i in range(p.get_piece_size()))
        return [
            bytes([int(piece[3:5], 16)]) if p.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in pieces
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class _Side:
    def __init__(self, tokenizer) -> None:
        self.encode = tokenizer.encode
        self.bytes = pa.array(tokenizer.token_bytes, pa.large_binary())
        self.length = np.array([len(t) for t in tokenizer.token_bytes], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.length)

    def of(self, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, tokens of each text, whether its tokens' bytes are the raw ones)."""
        listed = self.encode(texts)
        counts = np.fromiter(map(len, listed), np.int64, len(listed))
        ids = np.fromiter(chain.from_iterable(listed), np.int64, int(counts.sum()))
        joined = _joined(self.bytes, ids)
        ends = np.concatenate([[0], np.cumsum(self.length[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        ok = [joined[s:e] == r for s, e, r in zip(ends[:-1].tolist(), ends[1:].tolist(), raw)]
        return ids, counts, np.array(ok, dtype=bool)


def _joined(table: pa.Array, numbers: np.ndarray) -> bytes:
    """The table's strings of these numbers, one after another."""
    data = table.take(pa.array(numbers)).buffers()[2]
    return data.to_pybytes() if data else b""


def _before(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class Aligner:
    """Groups and links of texts."""

    def __init__(self, a, b) -> None:
        self.a, self.b = _Side(a), _Side(b)
        most = max(len(self.a), len(self.b))
        self.most = most
        signs = [f"{sign}{i}".encode() for sign in ",;|" for i in range(most)]
        self.signs = pa.array(signs, pa.large_binary())
        self.sign_length = np.array([len(s) for s in signs], dtype=np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of non-empty texts: an array (4, n) of n_a, n_b, n_groups, n_links, the groups' texts, and
        of each link the text's number and the ids of A and B."""
        raw = [b" " + t.encode() for t in texts]
        a, n_a, ok_a = self.a.of(texts, raw)
        b, n_b, ok_b = self.b.of(texts, raw)
        ok = ok_a & ok_b
        if not ok.all():
            a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
            n_a, n_b = n_a * ok, n_b * ok
        n = len(texts)
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        doc_a = np.repeat(np.arange(n), n_a)
        # between two neighbouring offsets lies one token of each side: a link is such a stretch
        ends = np.unique(np.concatenate([end_a, end_b]))
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        doc = doc_a[at_a]
        both_a, both_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        counts = np.stack([
            n_a, n_b, np.bincount(doc_a, weights=both_a, minlength=n).astype(np.int64), np.bincount(doc, minlength=n)
        ])
        return counts, self._texts(a, b, both_a, both_b, n_a + n_b), doc, a[at_a], b[at_b]

    def _texts(self, a: np.ndarray, b: np.ndarray, both_a: np.ndarray, both_b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        n = int(both_a.sum())
        before_a = _before(np.bincount(group_a, minlength=n))
        before_b = _before(np.bincount(group_b, minlength=n))
        first_a = np.concatenate([[True], both_a[:-1]])[: len(a)]
        first_b = np.concatenate([[True], both_b[:-1]])[: len(b)]
        signs = np.empty(len(a) + len(b), dtype=np.int64)
        signs[np.arange(len(a)) + before_b[group_a]] = a + self.most * first_a
        signs[np.arange(len(b)) + before_a[group_b + 1]] = b + 2 * self.most * first_b
        joined = memoryview(_joined(self.signs, signs))
        ends = _before(self.sign_length[signs])[_before(tokens)].tolist()
        # without the sign before the text's first group
        return [bytes(joined[s + 1 : e]) if e > s else b"" for s, e in zip(ends[:-1], ends[1:])]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, not negative, each in the narrowest type."""
    out = []
    for x in columns:
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        out += [struct.pack("<cI", kind.char.encode(), len(x)), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, columns = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<cI", raw, at)
        x = np.frombuffer(raw, np.dtype(kind.decode()), n, at + 5)
        at += 5 + x.nbytes
        columns.append(x.astype(np.int64))
    return columns


def _blocks(codes: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Heads and blocks of a run's directory; codes ascend."""
    starts = range(0, len(codes), BLOCK)
    cut = [slice(s, s + BLOCK) for s in starts]
    return [int(codes[s]) for s in starts], [_packed(codes[c] - codes[c.start], *(x[c] for x in columns)) for c in cut]


def _block(head: int, data: bytes) -> list[np.ndarray]:
    codes, *columns = _unpacked(data)
    return [codes + head, *columns]


def _sums(codes: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
    return codes[starts], np.add.reduceat(totals, starts) if len(starts) else totals


class _Pairs:
    """Codes of id pairs: by radix of the id of B, then by B, then by A."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.n_a, self.share = n_a, -(-n_b // RADIX)
        if RADIX * self.share * n_a >= 1 << (63 - _DOC_BITS):
            raise ValueError("vocabularies are too large for the codes of pairs")

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b % RADIX * self.share + b // RADIX) * self.n_a + a

    def radix_starts(self) -> np.ndarray:
        return np.arange(RADIX + 1) * (self.share * self.n_a)


def _runs(keys: np.ndarray, pairs: _Pairs) -> Iterator[tuple]:
    """(radix, records, heads, blocks, posts) of a buffer's links, a number of pair and document each."""
    keys = np.sort(keys)
    keys, times = _sums(keys, np.ones(len(keys), dtype=np.int64))
    codes, docs = keys >> _DOC_BITS, keys & ((1 << _DOC_BITS) - 1)
    cuts = np.searchsorted(codes, pairs.radix_starts())
    for radix, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
        if s == e:
            continue
        own, n = codes[s:e], times[s:e]
        listed, total = _sums(own, n)
        _, n_docs = _sums(own, np.ones(e - s, dtype=np.int64))
        yield radix, int(e - s), *_blocks(listed, total, n_docs), _packed(docs[s:e], n)


def _spilled(docs: DataFrame, a, b, id_col: str, text_col: str, of_groups, groups_kind: str, buffer: int) -> DataFrame:
    """Rows of documents and of runs; a row is of the one or the other kind."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b))
    own = _DOCS.format(kind=docs.schema[id_col].dataType.simpleString(), groups=groups_kind)
    schema = _parse_datatype_string(f"{own}, {_RUNS}")
    arrow = to_arrow_schema(schema)
    blank = [None] * len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(*shared.value)
        pairs = _Pairs(len(align.a), len(align.b))
        number, in_buffer = TaskContext.get().partitionId() << 33, 0
        keys: list[np.ndarray] = []

        def given(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

        def spill() -> Iterator[pa.RecordBatch]:
            nonlocal number, in_buffer
            if keys:
                runs = _runs(np.concatenate(keys), pairs)
                rows = [[number, *blank[1:8], radix, number, *rest] for radix, *rest in runs]
                if rows:
                    yield given(rows)
            keys.clear()
            number, in_buffer = number + 1, 0

        def aligned(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal in_buffer
            counts, texts, doc, ids_a, ids_b = align([t for _, t in held if t])
            places = np.array([i for i, (_, t) in enumerate(held) if t], dtype=np.int64)
            keys.append(pairs.codes(ids_a, ids_b) << _DOC_BITS | (places[doc] + in_buffer))
            of = dict(zip(places.tolist(), zip(counts.T.tolist(), texts)))
            rows = []
            for i, (key, _) in enumerate(held):
                numbers, groups = of.get(i, ([0] * 4, b""))
                rows.append([number, in_buffer + i, key, *numbers, of_groups(groups) if groups else "", *blank[8:]])
            in_buffer += len(held)
            yield given(rows)
            if sum(map(len, keys)) >= buffer or in_buffer >= 1 << (_DOC_BITS - 1):
                yield from spill()

        for batch in batches:
            held, size = [], 0
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((key, value.as_py()))
                size += len(held[-1][1] or "")
                if size >= TEXT_SLICE:
                    yield from aligned(held)
                    held, size = [], 0
            if held:
                yield from aligned(held)
        yield from spill()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def merged(runs: list[tuple[list[int], list[bytes]]], pool: int = POOL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, totals), codes ascending and each once, of runs (heads, blocks)."""
    heap = [(heads[0], r, 0) for r, (heads, _) in enumerate(runs) if heads]
    heapify(heap)
    codes: list[np.ndarray] = []
    totals: list[np.ndarray] = []
    size, enough = 0, pool
    while heap:
        head, r, k = heappop(heap)
        heads, blocks = runs[r]
        code, total, *_ = _block(head, blocks[k])
        codes.append(code)
        totals.append(total)
        size += len(code)
        if k + 1 < len(heads):
            heappush(heap, (heads[k + 1], r, k + 1))
        if size >= enough or not heap:
            code, total = np.concatenate(codes), np.concatenate(totals)
            order = np.argsort(code, kind="stable")
            code, total = _sums(code[order], total[order])
            # no block to come begins before the next head
            cut = int(np.searchsorted(code, heap[0][0])) if heap else len(code)
            if cut:
                yield code[:cut], total[:cut]
            codes, totals, size = [code[cut:]], [total[cut:]], len(code) - cut
            enough = max(pool, 2 * size)


def with_best(parts: Iterator[tuple[np.ndarray, np.ndarray]], n_a: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Marks the most frequent pairs of each id of B, as soon as the next id begins."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for code, total in parts:
        code, total = np.concatenate([held[0], code]), np.concatenate([held[1], total])
        cut = int(np.searchsorted(code, code[-1] // n_a * n_a))
        held = code[cut:], total[cut:]
        if cut:
            yield code[:cut], total[:cut], _best(code[:cut], total[:cut], n_a)
    if len(held[0]):
        yield *held, _best(*held, n_a)


def _best(code: np.ndarray, total: np.ndarray, n_a: int) -> np.ndarray:
    side = code // n_a
    starts = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    most = np.maximum.reduceat(total, starts)
    return (total == np.repeat(most, np.diff(np.append(starts, len(code))))).astype(np.int64)


def _groups_of(table: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """The whole groups of a table sorted by keys."""
    values = [table[k].to_numpy() for k in keys]
    new = np.zeros(table.num_rows, dtype=bool)
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    starts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
    return (table.slice(s, e - s) for s, e in zip(starts[:-1], starts[1:]))


def _merge_groups(last: bool, n_a: int):
    def work(table: pa.Table) -> list:
        rows = []
        for group in _groups_of(table, ["radix", "part"]):
            runs = list(zip(group["heads"].to_pylist(), group["blocks"].to_pylist()))
            parts = merged(runs)
            heads, blocks = [], []
            for columns in with_best(parts, n_a) if last else parts:
                more = _blocks(*columns)
                heads += more[0]
                blocks += more[1]
            rows.append((group["radix"][0].as_py(), group["part"][0].as_py(), heads, blocks))
        return [list(c) for c in zip(*rows)]

    return work


def pair_counts(runs: DataFrame, n_buffers: int, n_a: int, kept: Scratch, fan: int = FAN) -> DataFrame:
    """One run per radix (radix, run, heads, blocks): codes, counts, whether most frequent of their id of B."""
    runs, left = runs.select("radix", "run", "heads", "blocks"), max(n_buffers, 1)
    while True:
        left = -(-left // fan)
        part = F.pmod(F.xxhash64("run"), F.lit(left))
        ddl = "radix long, run long, heads array<long>, blocks array<binary>"
        runs = kept(map_groups(runs.withColumn("part", part).drop("run"), ["radix", "part"], _merge_groups(left == 1, n_a), ddl))
        if left == 1:
            return runs


def _shares(table: pa.Table) -> list:
    """A row (buffer, share) for each run of the groups: numbers of documents, what the counts give them."""
    rows = []
    for group in _groups_of(table, ["radix", "slice"]):
        counts, runs = [], []
        for run, heads, blocks, posts in zip(*(group[k].to_pylist() for k in ("run", "heads", "blocks", "posts"))):
            if posts is None:
                counts = [np.concatenate(c) for c in zip(*(_block(h, d) for h, d in zip(heads, blocks)))]
            else:
                runs.append((run, heads, blocks, posts))
        for run, heads, blocks, posts in runs:
            code, _, n_docs = (np.concatenate(c) for c in zip(*(_block(h, d) for h, d in zip(heads, blocks))))
            docs, times = _unpacked(posts)
            at = np.searchsorted(counts[0], code)
            sums, best = (np.zeros(int(docs.max()) + 1, np.int64) for _ in "ab")
            np.add.at(sums, docs, np.repeat(counts[1][at], n_docs) * times)
            np.add.at(best, docs, np.repeat(counts[2][at], n_docs) * times)
            has = np.flatnonzero(sums)
            rows.append((run, _packed(has, sums[has], best[has])))
    return [list(c) for c in zip(*rows)] or [[], []]


def _documents(table: pa.Table) -> list:
    """Documents of whole buffers with the shares of their runs added up."""
    parts = []
    for group in _groups_of(table, ["buffer"]):
        is_doc = group["share"].is_null()
        docs = group.filter(is_doc)
        if not docs.num_rows:
            continue
        numbers = docs["doc_no"].to_numpy()
        sums, best = (np.zeros(int(numbers.max()) + 1, np.int64) for _ in "ab")
        for share in group["share"].drop_null().to_pylist():
            at, s, b = _unpacked(share)
            sums[at] += s
            best[at] += b
        own = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups"])
        parts.append(own.append_column("n_best", pa.array(best[numbers])).append_column("count_sum", pa.array(sums[numbers])))
    return [c.combine_chunks() for c in pa.concat_tables(parts).columns] if parts else [[]] * 8


def align(
    docs: DataFrame,
    a,
    b,
    id_col: str = "doc_id",
    text_col: str = "text",
    of_groups: tuple[Callable[[bytes], object], str] = (bytes.decode, "string"),
    buffer: int = BUFFER,
    fan: int = FAN,
    slice_records: int = SLICE,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of each row.

    ``groups`` is the alignment itself, ids of A | ids of B of each group (``a1,a2|b1;a3|b2,b3``);
    ``of_groups`` (function of its bytes, type) can put a digest in its place before it is moved.
    A link is best if no pair of its id of B has a greater count; ``count_sum`` adds up the counts of
    a document's links.
    """
    spark = docs.sparkSession
    with Scratch(spark) as kept:
        spilled = kept(_spilled(docs, a, b, id_col, text_col, *of_groups, buffer))
        runs = spilled.where("radix is not null").select("radix", "run", "n_records", "heads", "blocks", "posts")
        size = runs.agg(F.countDistinct("run").alias("buffers"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("records")).first()
        counts = pair_counts(runs, size["buffers"], len(a.token_bytes), kept, fan)
        n_slices = max(1, -(-size["records"] // (RADIX * slice_records)))
        slices = F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)).cast("array<long>"))
        columns = ["radix", "slice", "run", "heads", "blocks", "posts"]
        meeting = runs.withColumn("slice", F.pmod(F.xxhash64("run"), F.lit(n_slices))).select(*columns).union(
            counts.select("radix", slices.alias("slice"), "run", "heads", "blocks", F.lit(None).cast("binary"))
        )
        shares = kept(map_groups(meeting, ["radix", "slice"], _shares, "buffer long, share binary"))
        kind, groups = docs.schema[id_col].dataType.simpleString(), of_groups[1]
        own = [c.split()[0] for c in _DOCS.split(", ")]
        rows = spilled.where("radix is null").select(*own, F.lit(None).cast("binary").alias("share"))
        rows = rows.unionByName(shares, allowMissingColumns=True)
        ddl = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups {groups}, n_best long, count_sum long"
        return checkpointed(map_groups(rows, ["buffer"], _documents, ddl).withColumnRenamed("id", id_col))
