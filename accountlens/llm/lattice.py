"""Near-duplicate vectors: lattice hashing with E8, neighbouring cells probed, cosine verified.

Each of ``TABLES`` tables projects a unit vector at random to two blocks of eight numbers and decodes
each block to its nearest point of the lattice E8. The two points name a cell. A vector also enters
the cells next to its own that are nearest to it, ``PROBES`` in all, so a close pair shares a cell of
some table with high probability. Vectors that share a cell are compared in double precision, a block
against a block; a pair is counted in its first common cell only, and a task returns counts and one
star per group instead of pairs.

Vectors are compared only under equal labels. A null vector or label, a zero vector, null or
non-finite components, and a null vec_id link with nothing. Rows equal in id, label and vector are
one vector; other rows under one id add up their links and share a component, and aren't links of each
other. Equal vectors of different ids are one node, compared once, whose weight counts in the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlens.llm.common import checkpointed, map_arrow, map_groups, mixed
from accountlens.llm.graph import components

THRESHOLD = 0.93
TABLES = 8
PROBES = 4
#: Standard deviation of a projected unit vector's coordinates, in units of the lattice.
SCALE = 0.55
#: Rows of a cell that are compared at a time; larger cells are split into blocks.
BLOCK = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [
        np.eye(8)[i] * s + np.eye(8)[j] * t for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)
    ]
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([np.array(whole), signs[signs.prod(axis=1) == 1] / 2])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point of even sum: the worst rounding is turned round where the sum is odd."""
    near = np.round(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(odd))
    near[odd, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row of eight numbers: E8 is D8 and D8 moved by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


class LatticeHash:
    def __init__(self, dimensions: int, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> None:
        random = np.random.default_rng(dimensions)
        self.planes = random.standard_normal((tables, 2, dimensions, 8)) * scale
        self.tables, self.probes, self.roots = tables, probes, _roots()

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the nearest point and of the nearest of its neighbours, and their distances."""
        home = nearest_e8(x)
        rest = x - home
        own = (rest**2).sum(axis=1)
        away = own[:, None] + 2 - 2 * rest @ self.roots.T
        n = self.probes
        best = np.argpartition(away, n - 1, axis=1)[:, : n - 1]
        points = np.concatenate([home[:, None], home[:, None] + self.roots[best]], axis=1)
        key = np.zeros(points.shape[:2], np.uint64)
        for j in range(8):
            key = mixed((key + (2 * points[:, :, j]).astype(np.int64).view(np.uint64)) * _BASE)
        return key, np.concatenate([own[:, None], np.take_along_axis(away, best, axis=1)], axis=1)

    def cells(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Keys (rows, tables * probes); rows of different salt share none."""
        out = np.empty((len(unit), self.tables, self.probes), np.int64)
        for t in range(self.tables):
            (ka, da), (kb, db) = (self._near(unit @ self.planes[t, k]) for k in (0, 1))
            far = (da[:, :, None] + db[:, None, :]).reshape(len(unit), -1)
            best = np.argsort(far, axis=1, kind="stable")[:, : self.probes]
            key = (ka[:, :, None] * _BASE + kb[:, None, :]).reshape(len(unit), -1)
            key = np.take_along_axis(key, best, axis=1)
            out[:, t] = mixed(mixed(key + np.uint64(t)) + salt[:, None]).view(np.int64)
        return out.reshape(len(unit), -1)


def _prepared(vectors: DataFrame, hashing: dict) -> DataFrame:
    """(node, vec_id, unit, cells) of the vectors that can link; a node is a label and a vector."""

    def make():
        hashes: dict[int, LatticeHash] = {}

        def work(batch: pa.RecordBatch) -> list:
            by_length: dict[int, list] = {}
            for i, (v, label) in enumerate(zip(batch.column(1), batch.column(2))):
                if not v.is_valid or not label.is_valid or not len(v) or v.values.null_count:
                    continue
                x = v.values.to_numpy().astype(np.float64)
                top = np.abs(x).max()
                if not np.isfinite(top) or top == 0:
                    continue
                x = x / top
                by_length.setdefault(len(x), []).append((i, x / np.sqrt((x**2).sum())))
            index, units, cells, salts = [], [], [], []
            for length, found in by_length.items():
                lattice = hashes.setdefault(length, LatticeHash(length, **hashing))
                unit = np.array([x for _, x in found])
                rows = [i for i, _ in found]
                salt = np.array(
                    [xxhash.xxh3_64_intdigest(f"{length}:{batch.column(2)[i].as_py()}") for i in rows], np.uint64
                )
                index += rows
                units += list(unit)
                cells += list(lattice.cells(unit, salt))
                salts += salt.tolist()
            ids = batch.column(0).take(pa.array(index, pa.int64()))
            # the salt is the label's
            nodes = [xxhash.xxh3_64_intdigest(u.tobytes(), seed=n) - (1 << 63) for u, n in zip(units, salts)]
            return [nodes, ids, pa.array(units, pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int64()))]

        return work

    return map_arrow(
        vectors.where("vec_id is not null").select("vec_id", "embedding", "label"),
        make,
        "node long, vec_id long, unit array<double>, cells array<long>",
    )


def _compared(threshold: float, probes: int):
    def work(groups: pa.Table) -> list:
        """Per vector of each group: links first met here, and the least node it hangs together with."""
        cell, low, high, block = (groups.column(c).to_numpy() for c in ("cell", "low", "high", "block"))
        node, owner, weight = (groups.column(c).to_numpy() for c in ("node", "owner", "weight"))
        unit = np.stack(groups.column("unit").combine_chunks().flatten().to_numpy().reshape(len(node), -1)) if (
            len({len(u) for u in groups.column("unit")}) == 1
        ) else None
        cells = groups.column("cells").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        starts = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)])
        out: list[list] = [[], [], []]
        lists = None if unit is not None else groups.column("unit").combine_chunks()
        for a, b in zip(starts, [*starts[1:], len(node)]):
            if b - a < 2:
                continue
            u = unit[a:b] if lists is None else np.array([lists[int(i)].values.to_numpy() for i in range(a, b)])
            both = np.arange(b - a)
            left = both if low[a] == high[a] else np.flatnonzero(block[a:b] == low[a])
            right = both if low[a] == high[a] else np.flatnonzero(block[a:b] == high[a])
            i, j = np.nonzero(u[left] @ u[right].T >= threshold)
            i, j = left[i], right[j]
            keep = (i < j if low[a] == high[a] else i != j) & (node[a:b][i] != node[a:b][j])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            here = cell[a]
            k = cells[a:b]
            # a pair belongs to the first cell of its lesser node that the other has too, in the same table
            swap = node[a:b][i] > node[a:b][j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            first = np.ones(len(i), bool)
            place = (k == here).argmax(axis=1)
            for c in range(int(place.max())):
                before = c < place[i]
                table = c - c % probes
                first &= ~(before & (k[i, c][:, None] == k[j, table : table + probes]).any(axis=1))
            counted = first & (owner[a:b][i] != owner[a:b][j])
            x, y, w = i[counted], j[counted], weight[a:b]
            n = np.zeros(b - a, np.int64)
            np.add.at(n, x, w[y])
            np.add.at(n, y, w[x])
            least = node[a:b].copy()
            while True:
                was = least.copy()
                lower = np.minimum(least[i], least[j])
                np.minimum.at(least, i, lower)
                np.minimum.at(least, j, lower)
                if (was == least).all():
                    break
            met = np.unique(np.r_[i, j])
            for column, values in zip(out, (node[a:b][met], n[met], least[met])):
                column.append(values)
        return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]

    return work


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, **hashing) -> DataFrame:
    """One row per vec_id: (vec_id, n_links, component_id, kept).

    ``vectors`` has vec_id, embedding and label. ``hashing``: tables, probes, scale.
    """
    wanted = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    found = _prepared(wanted, hashing)
    several = F.count("*").over(Window.partitionBy("vec_id")) > 1
    # equal vectors of a label are one node of some weight; an id with several vectors has nodes of its own,
    # as its own vectors aren't links
    ids = checkpointed(
        found.select("vec_id", "node").distinct().withColumn("several", several)
        .select("vec_id", F.col("node").alias("shared"), F.when(F.col("several"), F.xxhash64("node", "vec_id")).otherwise(F.col("node")).alias("node"), "several")
    )
    weights = ids.groupBy("node", "shared").agg(
        F.count("*").alias("weight"), F.max(F.when(F.col("several"), F.col("vec_id"))).alias("own")
    ).withColumn("owner", F.coalesce("own", "node")).drop("own")
    once = found.select(F.col("node").alias("shared"), "unit", "cells").dropDuplicates(["shared"])
    rows = checkpointed(weights.join(once, "shared").drop("shared"))
    entries = rows.select("node", F.explode("cells").alias("cell")).distinct()
    crowded = checkpointed(
        entries.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select(
            "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
        )
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = (
        entries.join(crowded, "cell")
        .select("node", "cell", block.alias("block"), other)
        .select("node", "cell", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .join(rows, "node")
    )
    met = checkpointed(
        map_groups(placed, ["cell", "low", "high"], _compared(threshold, hashing.get("probes", PROBES)), "node long, n long, least long")
    )
    # rows of one id that differ hang together
    lead = ids.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    same = ids.join(lead, "vec_id").select("a", F.col("node").alias("b"))
    found = components(met.select(F.col("node").alias("a"), F.col("least").alias("b")).union(same))
    named = checkpointed(
        ids.join(found, "node", "left").select("vec_id", F.coalesce("component", "node").alias("component"))
    )
    least = checkpointed(named.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    of = named.join(least, "component").select("vec_id", "component_id").distinct()
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    copies = rows.select("node", (F.col("weight") - 1).alias("copies")).join(counts, "node", "left")
    links = (
        ids.join(copies, "node").groupBy("vec_id")
        .agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies")).alias("n"))
    )
    own = F.coalesce("component_id", "vec_id")
    return (
        wanted.select("vec_id")
        .distinct()
        .join(of, "vec_id", "left")
        .join(links, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            own.alias("component_id"),
            F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
