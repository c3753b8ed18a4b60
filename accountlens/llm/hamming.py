"""Exact nearest neighbours of binary codes in Hamming distance, by multi-index hashing.

A code is cut into segments; each segment has a table from its value to the codes that hold it. A
query looks its segments up at radius 0, then 1, and so on, one segment at a time. Once segments up to
number a have been searched to radius s and the others to s - 1, every code within m * s + a of the
query has been seen, m being the number of segments. The search of a query ends when that bound reaches the
distance of its k-th verified neighbour: nothing unseen can be nearer.

Equal codes are one entry with the least k + 1 of their ids, which is all that a list of k with ties by id
can need. The index is cut into blocks of bounded size; a query searches each block and the
lists of the blocks are merged. A null code is neither asked for nor found, nor is a null id; rows that repeat
an id and a code are one. A query's own id is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlens.llm.common import checkpointed, map_arrow

K = 10
#: Rows whose id this divides are the queries.
QUERY_STEP = 20
BITS = 64
#: Codes of a block of the index, and queries that search it at a time.
BLOCK = 16_384
CHUNK = 4096
#: Ids of one code are first reduced in so many shares.
_SHARES = 16


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): bit j of the code says that component j is above 0. Null vectors have no code.

    Null and non-finite components count as not above 0, except infinity. At most 64 components.
    """

    def make():
        weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)

        def work(batch: pa.RecordBatch) -> list:
            codes = []
            for v in batch.column(1):
                if not v.is_valid:
                    codes.append(None)
                    continue
                x = np.array([c if c is not None else 0.0 for c in v.as_py()], np.float64)
                if len(x) > BITS:
                    raise ValueError(f"a code has at most {BITS} bits, the vector {len(x)} components")
                codes.append(int(np.bitwise_or.reduce(weights[: len(x)][x > 0], initial=np.uint64(0)).view(np.int64)))
            return [batch.column(0), codes]

        return work

    return map_arrow(vectors.select(F.col(id_col).cast("long"), vector_col), make, "id long, code long")


def _masks(width: int) -> list[np.ndarray]:
    """Values of so many bits, by number of bits set."""
    values = np.arange(1 << width, dtype=np.int64)
    ones = np.bitwise_count(values)
    return [values[ones == d] for d in range(width + 1)]


class MultiIndex:
    """Tables of the segments of distinct codes, each with a weight: how many ids it stands for."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.codes, self.weights = codes, weights
        width = min(16, max(4, int(np.log2(max(2, len(codes))))))
        self.segments = -(-BITS // width)
        bounds = np.linspace(0, BITS, self.segments + 1).astype(int)
        self.cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        self.masks = {hi - lo: _masks(hi - lo) for lo, hi in self.cuts}
        self.tables = []
        for lo, hi in self.cuts:
            values = self.part(codes, lo, hi)
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << (hi - lo)) + 1))
            self.tables.append((order, starts))
        self.seen = np.full(len(codes), -1, np.int64)

    @staticmethod
    def part(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((codes >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def search(self, query: np.uint64, mark: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries that hold the nearest ``need`` ids and all their ties, with distances."""
        found, distances = [], []
        count = np.zeros(BITS + 1, np.int64)
        for radius in range(BITS + 1):
            for a, (lo, hi) in enumerate(self.cuts):
                if radius <= hi - lo:
                    order, starts = self.tables[a]
                    values = int(self.part(query, lo, hi)) ^ self.masks[hi - lo][radius]
                    begin, n = starts[values], starts[values + 1] - starts[values]
                    full = n > 0
                    begin, n = begin[full], n[full]
                    at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                    entries = order[at]
                    entries = entries[self.seen[entries] != mark]
                    self.seen[entries] = mark
                    d = np.bitwise_count(self.codes[entries] ^ query).astype(np.int64)
                    found.append(entries)
                    distances.append(d)
                    count += np.bincount(d, self.weights[entries], BITS + 1).astype(np.int64)
                covered = self.segments * radius + a
                if count[: covered + 1].sum() >= need or covered >= BITS:
                    entries, d = np.concatenate(found), np.concatenate(distances)
                    kth = np.searchsorted(np.cumsum(count), min(need, count.sum()))
                    near = d <= kth
                    return entries[near], d[near]
        raise AssertionError("the last radius covers all codes")


def _searched(k: int):
    def work(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asked, entries, distances = [], [], []
        if len(index) and len(queries):
            ids = index["ids"].to_numpy()
            tables = MultiIndex(
                index["code"].to_numpy(np.int64).view(np.uint64), np.array([len(i) for i in ids], np.int64)
            )
            for mark, code in enumerate(queries["code"].to_numpy(np.int64)):
                at, d = tables.search(np.int64(code).view(np.uint64), mark, k + 1)
                pairs = sorted((x, i) for e, x in zip(at.tolist(), d.tolist()) for i in ids[e])[: k + 1]
                asked += [code] * len(pairs)
                distances += [x for x, _ in pairs]
                entries += [i for _, i in pairs]
        return pd.DataFrame(
            {
                "code": np.array(asked, np.int64),
                "neighbour_id": np.array(entries, np.int64),
                "distance": np.array(distances, np.int32),
            }
        )

    return work


def top_k(codes: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest of each id that ``step`` divides.

    ``codes`` has id and code (longs). Ties go by id. With fewer than k other ids, all of them.
    """
    rows = checkpointed(codes.where("id is not null and code is not null").select("id", "code").distinct())
    # the least k + 1 ids of a code, in two steps: one code may have most rows
    share = F.pmod(F.xxhash64("id"), F.lit(_SHARES))
    by_share = Window.partitionBy("code", "share").orderBy("id")
    by_code = Window.partitionBy("code").orderBy("id")
    least = (
        rows.withColumn("share", share)
        .withColumn("n", F.row_number().over(by_share))
        .where(f"n <= {k + 1}")
        .withColumn("n", F.row_number().over(by_code))
        .where(f"n <= {k + 1}")
    )
    index = checkpointed(least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = rows.where(F.col("id") % step == 0)
    queries = checkpointed(asked.select("code").distinct())
    blocks = max(1, -(-index.count() // BLOCK))
    chunks = max(1, -(-queries.count() // CHUNK))
    block = F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block")
    chunk = F.pmod(F.xxhash64("code", F.lit(1)), F.lit(chunks)).alias("chunk")
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    found = (
        index.select("code", "ids", block, each(chunks, "chunk"))
        .groupBy("block", "chunk")
        .cogroup(queries.select("code", chunk, each(blocks, "block")).groupBy("block", "chunk"))
        .applyInPandas(_searched(k), "code long, neighbour_id long, distance int")
    )
    # an id with two codes may be found twice: its nearer one counts
    found = found.groupBy("code", "neighbour_id").agg(F.min("distance").alias("distance"))
    best = F.row_number().over(Window.partitionBy("code").orderBy("distance", "neighbour_id"))
    lists = checkpointed(found.withColumn("n", best).where(f"n <= {k + 1}").drop("n"))
    met = (
        asked.withColumnRenamed("id", "query_id")
        .join(lists, "code")
        .where("query_id <> neighbour_id")
        .groupBy("query_id", "neighbour_id")
        .agg(F.min("distance").alias("distance"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return met.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "neighbour_id", "distance")
