"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

A document's ids and an end token are its tokens; only a document longer than a sequence is cut, from
its end, into pieces of a whole sequence, so that the first piece has the rest. Shorter pieces are
packed. The sequences that are open are known by their gaps. Each round

- opens sequences: so many as the pieces left need at least, beside the gaps there are;
- sorts pieces and gaps by size, largest first, over range partitions;
- sweeps each partition in that order: a piece goes to its successor, the smallest gap of the
  partition that holds it; the gap is smaller then and serves on;
- lets gaps that a partition has left serve the pieces that smaller partitions couldn't place. How
  many go where is a sweep over the partitions' counts; within them the piece and the gap of one rank
  meet (several pieces to a gap, where it holds so many of the longest);
- updates the gaps, and repeats while pieces are left.

Gaps and pieces of one size are spread over partitions by their ids, so no length can be hot. With a
single partition a round is exactly best-fit decreasing.

Null and empty texts have the end token only. Rows that repeat, and rows of null id, are documents of
their own. Which sequence a piece goes to depends on how the input is dealt; that all fit does not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.llm.byte_level import ByteLevelTokenizer
from accountlens.llm.common import Scratch, checkpointed, map_arrow, map_groups

CAPACITY = 2048
#: Pieces and gaps of a range partition, about.
PARTITION_ROWS = 200_000

_EVENT = "is_piece boolean, id long, size long"
_SWEPT = (
    "state byte, id long, size long, sequence_id long, offset long, part long, rank long"
)
_PLACED, _GAP, _PIECE = 0, 1, 2


def cut_pieces(
    docs: DataFrame,
    tokenizer: ByteLevelTokenizer,
    end_token: int = 0,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    of_ids: tuple[Callable[[np.ndarray], object], str, str] | None = None,
) -> DataFrame:
    """(piece_no, id, piece, start, length, ids) of each row's whole text; no shuffle.

    ``piece_no`` tells pieces apart within one run of the plan: write the frame before using it twice.
    ``of_ids``: (function, column, type) of a value to return in place of the ids themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    value_of, name, kind = of_ids or (np.ndarray.tolist, "ids", "array<int>")

    def make():
        encode = shared.value.ids
        made = TaskContext.get().partitionId() << 33

        def work(batch: pa.RecordBatch) -> list:
            nonlocal made
            columns: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_token], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    row = (made, key, piece, start, end - start, value_of(ids[start:end]))
                    made += 1
                    for column, value in zip(columns, row):
                        column.append(value)
            return columns

        return work

    id_kind = docs.schema[id_col].dataType.simpleString()
    cut = map_arrow(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        make,
        f"piece_no long, id {id_kind}, piece int, start long, length long, {name} {kind}",
    )
    return cut.withColumnRenamed("id", id_col)


def sweep(is_piece: np.ndarray, ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[list, list, list]:
    """(placed, gaps, pieces left) of events by descending size, a gap before a piece of its size.

    Placed: (piece, size, sequence, offset); the others: (id, size), pieces in the given order.
    """
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit s: gaps of size s
    placed, left = [], []
    for piece, i, size in zip(is_piece.tolist(), ids.tolist(), sizes.tolist()):
        if not piece:
            gaps[size].append(i)
            there |= 1 << size
            continue
        fitting = there >> size
        if not fitting:
            left.append((i, size))
            continue
        gap = size + (fitting & -fitting).bit_length() - 1
        sequence = gaps[gap].pop()
        if not gaps[gap]:
            there ^= 1 << gap
        placed.append((i, size, sequence, capacity - gap))
        if rest := gap - size:
            gaps[rest].append(sequence)
            there |= 1 << rest
    return placed, [(i, size) for size, held in enumerate(gaps) for i in held], left


def _sweep_partition(capacity: int):
    def run(batches):
        part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        sizes = table["size"].to_numpy()
        placed, gaps, left = sweep(table["is_piece"].to_numpy(), table["id"].to_numpy(), sizes, capacity)
        least = int(sizes[-1])
        # gaps that hold any piece of the partitions to come serve them, the smallest first
        serving = [g for g in gaps if g[1] >= least]
        others = [g for g in gaps if g[1] < least]
        rows = (
            [(_PLACED, *p, part, -1) for p in placed]
            + [(_GAP, *g, None, None, part, rank) for rank, g in enumerate(serving)]
            + [(_GAP, *g, None, None, part, -1) for g in others]
            + [(_PIECE, *p, None, None, part, rank) for rank, p in enumerate(left)]
        )
        for at in range(0, len(rows), 50_000):
            columns = zip(*rows[at : at + 50_000])
            kinds = (pa.int8(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
                "state", "id", "size", "sequence_id", "offset", "part", "rank"
            ])

    return run


def carry(parts: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Which gaps of larger partitions serve the pieces that smaller ones have left.

    ``parts``: (part, pieces left, longest, serving gaps, smallest) by part. Rows of the result:
    (part, first rank, end, gaps' part, first gap, pieces a gap); the nearest gaps come first.
    """
    stack: list[list[int]] = []
    found = []
    for part, pieces, longest, gaps, smallest in parts:
        at = 0
        while at < pieces and stack:
            source, gap, there, least = stack[-1]
            each = max(1, least // longest)
            used = min(there, -(-(pieces - at) // each))
            served = min(pieces - at, used * each)
            found.append((part, at, at + served, source, gap, each))
            at += served
            if used == there:
                stack.pop()
            else:
                stack[-1][1:3] = gap + used, there - used
        if gaps:
            stack.append([part, 0, gaps, smallest])
    return np.array(found, dtype=np.int64).reshape(-1, 6)


def _served(left: DataFrame, table: np.ndarray) -> DataFrame:
    """Pieces that were left, with the (part, rank) of the gap that serves them, or null."""
    # at most two rows a partition
    shared = left.sparkSession.sparkContext.broadcast(table)

    def make():
        rows = shared.value
        keys = rows[:, 0] << 40 | rows[:, 1]

        def work(batch: pa.RecordBatch) -> list:
            part, rank = (batch.column(k).to_numpy() for k in ("part", "rank"))
            at = np.searchsorted(keys, part << 40 | rank, "right") - 1
            row = rows[np.maximum(at, 0)]
            ok = (at >= 0) & (row[:, 0] == part) & (rank < row[:, 2])
            gap = row[:, 4] + (rank - row[:, 1]) // np.maximum(row[:, 5], 1)
            return [
                batch.column("id"), batch.column("size"), batch.column("part"), batch.column("rank"),
                pa.array(row[:, 3], pa.int64(), mask=~ok), pa.array(gap, pa.int64(), mask=~ok),
            ]

        return work

    ddl = "id long, size long, part long, rank long, gap_part long, gap_rank long"
    return map_arrow(left.select("id", "size", "part", "rank"), make, ddl)


def _meet(capacity: int):
    """Places the pieces of a gap (part, rank) one after another; the gap itself comes back smaller."""

    def work(table: pa.Table) -> list:
        f = table.to_pandas()
        f = f.sort_values(["part", "rank", "is_piece", "at"], kind="stable", ignore_index=True)
        gap = (~f["is_piece"]).cumsum() - 1
        heads = np.flatnonzero(~f["is_piece"])
        size = f["size"].where(f["is_piece"], 0)
        before = size.cumsum() - size
        offset = capacity - f["size"].iloc[heads].to_numpy()[gap] + (before - before.iloc[heads].to_numpy()[gap])
        total = np.bincount(gap, weights=size, minlength=len(heads)).astype(np.int64)
        sequence = f["id"].iloc[heads].to_numpy()[gap]
        is_piece = f["is_piece"].to_numpy()
        left = f["size"].to_numpy() - np.where(is_piece, 0, total[gap])
        n = len(f)
        return [
            pa.array(np.where(is_piece, _PLACED, _GAP), pa.int8()), f["id"].to_numpy(), left,
            pa.array(sequence, pa.int64(), mask=~is_piece), pa.array(offset.to_numpy(), pa.int64(), mask=~is_piece),
            f["part"].to_numpy(), np.full(n, -1),
        ]

    return work


def _to_open(pieces: dict[int, int], gaps: dict[int, int], capacity: int) -> int:
    """How many sequences pieces (size: number) need beside the gaps, whichever way they are packed."""
    total = sum(s * n for s, n in pieces.items()) - sum(s * n for s, n in gaps.items())
    large = sum(n for s, n in pieces.items() if 2 * s > capacity) - sum(n for s, n in gaps.items() if 2 * s > capacity)
    unfit = sum(s * n for s, n in pieces.items() if s > max(gaps, default=0))
    return max(-(-total // capacity), large, -(-unfit // capacity), 0)


def best_fit(items: DataFrame, capacity: int, kept: Scratch, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(id, sequence_id, offset) of items (id, length), 1 to ``capacity`` long, ids distinct.

    Reads the tables of ``kept``. The driver sees a count for each size, and counts of each range partition.
    """
    spark = items.sparkSession
    names = [c.split()[0] for c in _EVENT.split(", ")]
    pieces = items.select(F.lit(True), "id", F.col("length").cast("long")).toDF(*names)
    gaps = pieces.where(F.lit(False))
    opened, done = 0, []
    while True:
        # at most two rows for each size
        sizes = pieces.union(gaps).groupBy("is_piece", "size").count().collect()
        need, have = ({r["size"]: r["count"] for r in sizes if r["is_piece"] == kind} for kind in (True, False))
        if not need:
            break
        least = min(need)
        gaps, have = gaps.where(F.col("size") >= least), {s: n for s, n in have.items() if s >= least}
        new = _to_open(need, have, capacity)
        fresh = spark.range(opened, opened + new).select(F.lit(False), "id", F.lit(capacity).cast("long")).toDF(*names)
        opened += new
        n_parts = -(-(sum(need.values()) + sum(have.values()) + new) // partition_rows)
        order = [F.col("size").desc(), F.col("is_piece").asc(), F.xxhash64("id").asc(), F.col("id").asc()]
        events = pieces.union(gaps).union(fresh)
        # a partition's worth of rows needs no ranges
        events = events.repartitionByRange(n_parts, *order) if n_parts > 1 else events.coalesce(1)
        swept = kept(events.sortWithinPartitions(*order).mapInArrow(_sweep_partition(capacity), _SWEPT))
        is_gap, is_left = F.col("state") == _GAP, F.col("state") == _PIECE
        serving = is_gap & (F.col("rank") >= 0)
        parts = swept.groupBy("part").agg(
            F.count_if(is_left), F.max(F.when(is_left, F.col("size"))), F.count_if(serving), F.min(F.when(serving, F.col("size")))
        )
        found = carry(sorted(tuple(r) for r in parts.collect()))
        done.append(swept.where(F.col("state") == _PLACED))
        left = swept.where(is_left)
        gaps = swept.where(is_gap)
        if len(found):
            left = _served(left, found)
            meeting = gaps.where(serving).select(F.lit(False).alias("is_piece"), "id", "size", "part", "rank", F.lit(0).cast("long").alias("at"))
            meeting = meeting.union(
                left.where("gap_part is not null").select(F.lit(True), "id", "size", "gap_part", "gap_rank", "rank")
            )
            met = kept(map_groups(meeting, ["part", "rank"], _meet(capacity), _SWEPT))
            done.append(met.where(F.col("state") == _PLACED))
            gaps = gaps.where("rank < 0").union(met.where(is_gap))
            left = left.where("gap_part is null")
        pieces = left.select(F.lit(True), "id", "size").toDF(*names)
        gaps = gaps.select(F.lit(False), "id", "size").toDF(*names)
    placed = spark.range(0).select("id", F.col("id").alias("sequence_id"), F.col("id").alias("offset"))
    for d in done:
        placed = placed.union(d.select("id", "sequence_id", "offset"))
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``pieces`` (piece_no, length, and more), with sequence_id and offset in place of piece_no.

    A piece as long as a sequence is one by itself; its number is negative.
    """
    with Scratch(pieces.sparkSession) as kept:
        stored = kept(pieces)
        short = stored.where(F.col("length") < capacity)
        placed = best_fit(short.select(F.col("piece_no").alias("id"), "length"), capacity, kept, partition_rows)
        placed = placed.withColumnRenamed("id", "placed_no")
        met = short.join(placed.hint("merge"), F.col("piece_no") == F.col("placed_no")).drop("placed_no")
        whole = stored.where(F.col("length") >= capacity).withColumns(
            {"sequence_id": -1 - F.col("piece_no"), "offset": F.lit(0).cast("long")}
        )
        return checkpointed(met.unionByName(whole).drop("piece_no"))
