"""Passages that repeat across documents, by content-defined chunking.

A gear hash rolls over the bytes of a text: each step shifts it left and adds a random number of the
new byte. A chunk ends where the top ``BITS`` of the 16-bit hash are 0, so an end depends on the
last sixteen bytes only, and an insertion moves no end beyond itself. Ends closer than ``LEAST``
bytes to the candidate before are passed over; a stretch without an end is cut every ``MOST``
bytes. Chunks with equal 128-bit digests are one; the first occurrence by (doc_id, start) is kept.

Chunks of a document that also occur in another and follow each other form a passage; passages of
``WORDS`` words or more are reported. The partial chunks at both sides of a shared passage are not
whole in common, so this is less than the fifty words one looks for. A passage may hold kept chunks and
others: what of it can be cut are the stretches of chunks that are kept elsewhere, whatever their length.

Offsets are bytes of the UTF-8 text. Null and empty texts have no chunks. Rows that repeat a doc_id
are one document to this operator: what repeats only among them is no passage, passages lie within one of
their texts, and the lists of the id hold those of all. Rows with a null doc_id take no part and get an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountlens.llm.common import Scratch, checkpointed, map_arrow
from accountlens.llm.lines import text_key

#: A chunk ends once in 2 ** BITS bytes, before LEAST.
BITS = 4
LEAST = 12
MOST = 256
WORDS = 14
#: Bytes hashed at a time; what goes before is carried over.
_SLICE = 1 << 22
_WINDOW = 16
#: Bits that mark repeated digests: 16 MB.
MARKS = 1 << 27
#: Where a chunk stands; texts of one id are kept apart.
_PLACE = ("doc_id", "text_key", "start")
_GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)


def _candidates(data: np.ndarray) -> np.ndarray:
    """Offsets after which a chunk may end."""
    found = []
    for start in range(0, len(data), _SLICE):
        # the sum over sixteen bytes, each shifted by its age, doubled up: 1, 2, 4, 8 and 16 bytes
        lead = min(_WINDOW - 1, start)
        h = _GEAR[data[start - lead : start + _SLICE]]
        for k in (1, 2, 4, 8):
            older = np.zeros_like(h)
            older[k:] = h[:-k]
            h = h + (older << np.uint16(k))
        at = np.flatnonzero(h[lead:] >> np.uint16(16 - BITS) == 0)
        found.append(at + start + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunk_ends(data: bytes) -> np.ndarray:
    """End offsets of the chunks of a text."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    at = _candidates(np.frombuffer(data, np.uint8))
    at = at[np.diff(at, prepend=-LEAST) >= LEAST]
    ends = np.unique(np.r_[at[at < n], n])
    long = np.flatnonzero(np.diff(ends, prepend=0) > MOST)
    if len(long):
        before = np.r_[0, ends][long]
        ends = np.unique(np.concatenate([ends, *(np.arange(b + MOST, ends[i], MOST) for b, i in zip(before, long))]))
    return ends


def chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: np.ndarray | None = None, key: Column | None = None
) -> DataFrame:
    """(doc_id, text_key, start, end, digest_a, digest_b) of every chunk; text_key tells texts of an id apart.

    ``marked``: bits as of :func:`marked_digests`; only chunks whose bit is set are returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(marked) if marked is not None else None

    def make():
        bits = shared.value if shared is not None else None

        def work(batch: pa.RecordBatch) -> list:
            ids, keys, starts, ends, digests = [], [], [], [], []
            for i, value, key in zip(*(batch.column(k) for k in range(3))):
                data = (value.as_py() or "").encode()
                end = chunk_ends(data)
                start = np.r_[0, end[:-1]] if len(end) else end
                found = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist()))
                if bits is not None:
                    at = np.frombuffer(found, np.int64)[::2] & (MARKS - 1)
                    kept = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                    start, end = start[kept], end[kept]
                    found = np.frombuffer(found, np.int64).reshape(-1, 2)[kept].tobytes()
                digests.append(found)
                starts.append(start)
                ends.append(end)
                ids.append(np.full(len(end), i.as_py(), np.int64))
                keys.append(np.full(len(end), key.as_py(), np.int64))
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            join = lambda x: np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32)
            long = lambda x: np.concatenate(x) if x else []
            return [long(ids), long(keys), join(starts), join(ends), pairs[:, 0], pairs[:, 1]]

        return work

    return map_arrow(
        _texts(docs, id_col, text_col, key).where("doc_id is not null"), make,
        "doc_id long, text_key long, start int, end int, digest_a long, digest_b long",
    )


def _texts(docs: DataFrame, id_col: str, text_col: str, key: Column | None = None) -> DataFrame:
    key = text_key(docs, id_col, text_col) if key is None else key
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("text_key"))


def marked_digests(found: DataFrame) -> np.ndarray:
    """``MARKS`` bits, set where the first half of a digest falls that two documents have.

    A first look at the chunks, by half a digest and the id alone: what isn't marked is in one document
    only and needn't be moved again. A set of fixed size, whatever the corpus; a fuller one keeps out less.
    """
    repeated = found.groupBy("digest_a").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    at = F.col("digest_a").bitwiseAND(MARKS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = repeated.groupBy(F.shiftrightunsigned(at, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(MARKS // 64, np.int64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint64)


def repeated_chunks(found: DataFrame) -> DataFrame:
    """Chunks whose digest occurs in two documents or more; ``first`` marks the kept occurrence."""
    digest = ["digest_a", "digest_b"]
    shared = found.groupBy(*digest).agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(F.struct(*_PLACE)).alias("kept")
    )
    # a checkpoint lets the join deal both sides anew, so that a chunk of very many documents is split
    shared = checkpointed(shared.where("least < most").select(*digest, "kept"))
    return found.join(shared, digest).select(*_PLACE, "end", (F.col("kept") == F.struct(*_PLACE)).alias("first"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, later): runs of repeated chunks with enough words.

    ``later``: (start, end) of the stretches without a kept occurrence.
    """
    key = text_key(docs, id_col, text_col)
    marked = marked_digests(chunks(docs, id_col, text_col, key=key))
    with Scratch(docs.sparkSession) as scratch:
        found = scratch(chunks(docs, id_col, text_col, marked, key))
        runs = checkpointed(_runs(repeated_chunks(found)))
    by_doc = runs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "later"))).alias("runs"))
    texts = _texts(docs, id_col, text_col, key).where("doc_id is not null")
    alone = texts.where("text_key = 0")
    texts = alone.union(texts.where("text_key <> 0").dropDuplicates(["doc_id", "text_key"]))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def make():
        def work(batch: pa.RecordBatch) -> list:
            out: list[list] = [[], [], [], [], []]
            for i, value, listed in zip(*(batch.column(k) for k in range(3))):
                data = (value.as_py() or "").encode()
                for run in listed.as_py():
                    n = len(data[run["start"] : run["end"]].split())
                    if n >= words:
                        for column, v in zip(out, (i.as_py(), run["start"], run["end"], n, run["later"])):
                            column.append(v)
            return [*out[:4], pa.array(out[4], pa.list_(span))]

        return work

    met = by_doc.join(texts, ["doc_id", "text_key"]).select("doc_id", "text", "runs")
    return map_arrow(met, make, "doc_id long, start int, end int, n_words int, later array<struct<start: int, end: int>>")


def _runs(repeated: DataFrame) -> DataFrame:
    """Neighbouring chunks as one row, at least as long as the shortest passage can be."""
    order = Window.partitionBy("doc_id", "text_key").orderBy("start")
    new = F.col("start") != F.lag("end", 1, -1).over(order)
    turn = new | (F.col("first") != F.lag("first").over(order))
    return (
        repeated.distinct()
        .select("*", new.cast("int").alias("new"), turn.cast("int").alias("turn"))
        .select("*", F.sum("new").over(order).alias("run"), F.sum("turn").over(order).alias("part"))
        .groupBy("doc_id", "text_key", "run", "part")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"))
        .groupBy("doc_id", "text_key", "run")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.array_sort(F.collect_list(F.when(~F.col("first"), F.struct("start", "end")))).alias("later"),
        )
        .where(F.col("end") - F.col("start") >= 2 * WORDS - 1)
        .drop("run")
    )


def passages_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per doc_id: (doc_id, n_passages, repeated_words, passages, duplicate).

    ``passages`` lists start-end of each, ``duplicate`` the parts of them that are not the first
    occurrence; no kept chunk is in one.
    """
    span = F.struct("start", "end")
    found = repeated_passages(docs, id_col, text_col).distinct().groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("n_words").alias("words"), F.array_sort(F.collect_list(span)).alias("spans"),
        F.array_sort(F.flatten(F.collect_list("later"))).alias("later"),
    )
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    return ids.join(found, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("words", F.lit(0)).cast("long").alias("repeated_words"),
        text("spans").alias("passages"),
        text("later").alias("duplicate"),
    )
