"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is due target / source_size copies: the whole part is taken for certain,
the fraction is an inclusion probability. The flight phase moves the probabilities through the null
space of the balancing constraints (a source's documents and its words), so that both totals keep
their expectation, until all but two documents of a group are decided; the largest are taken first, so
that those are small. It runs on cells of bounded size; what a cell leaves undecided meets the rest of its
source in wider cells, level by level. The last two documents of a source are the landing problem: they
are chosen, and few others of the last cell turned round, so that the words are nearest to what is due.

Size: words of a text, 0 of null. Sources rank by code point, null last, and weigh 1, 2, 3 by turns.
A source without words has target 0 and nothing of it is taken. The draw depends on ids and sizes
only, so reruns agree; rows that repeat, and rows of null id, are documents of their own, and equal rows
are spread over cells like others.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlens.llm.common import checkpointed, word_count

WEIGHTS = (1.0, 2.0, 3.0)
#: A target stops at so many times its source's size.
MOST = 3
#: So many sources are broadcast at most.
BROADCAST_SOURCES = 10_000
#: Documents of a cell of the first level, of all sources.
CELL = 4096
#: Cells that meet at the next level.
FAN = 64
#: Times that the landing turns documents round, two at most each time.
TURNS = 8
_EPS = 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, number, source_size, target) of documents (source, size).

    What a capped source can't take is shared again by weight until no target is above its cap. One
    round is one pass over a row per source; sources are ranked by a distributed sort.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sums = checkpointed(sums.withColumn("code", F.hex(F.encode("source", "UTF-8"))))
    # UTF-8 bytes order as code points; ranks: rows before a partition, then within it
    ordered = checkpointed(
        sums.repartitionByRange(F.col("code").asc_nulls_last()).sortWithinPartitions(F.col("code").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33).cast("int"))
        .withColumn("within", F.col("at").bitwiseAND((1 << 33) - 1))
    )
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = checkpointed(
        ordered.join(before, "part")
        .withColumn("number", F.col("before") + F.col("within"))
        .select("source", "number", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(share)
        row = ranked.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("taken"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("weights"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == capped or not row["weights"]:
            break
        capped = row["n"]
        share = (total - row["taken"]) / row["weights"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(share))
    return ranked.withColumn("target", target).drop("cap", "weight")


def flight(p: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: at most two are left between 0 and 1."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    held = open_[:3]
    rest = iter(open_[3:])
    while len(held) == 3:
        x, y, z = (float(size[i]) for i in held)
        # orthogonal to (1, 1, 1) and to the sizes
        u = (y - z, z - x, x - y)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(held, u) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(held, u) if d)
        step = up if random.random() * (up + down) < down else -down
        for i, d in zip(held, u):
            v = p[i] + step * d
            p[i] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
        held = [i for i in held if 0 < p[i] < 1]
        while len(held) < 3 and (nxt := next(rest, None)) is not None:
            held.append(nxt)
    return p


def landing(p: np.ndarray, size: np.ndarray, due: np.ndarray) -> np.ndarray:
    """Decides the last documents, two at most, and turns few others round, to come near the words due.

    ``due`` are the probabilities before the flight: only documents that were open then can turn. First
    the choice for the last ones whose words are nearest; then, as long as it helps, the one or two
    documents whose change brings the words nearest.
    """
    p = p.copy()
    held = np.flatnonzero((p > 0) & (p < 1))
    off = float(((p - due) * size).sum())
    if len(held):
        choices = np.array(list(itertools.product((1.0, 0.0), repeat=len(held))))
        words = off + (choices - p[held]) @ size[held].astype(float)
        p[held] = choices[np.argmin(np.abs(words))]
        off = float(words[np.argmin(np.abs(words))])
    free = np.flatnonzero((due > _EPS) & (due < 1 - _EPS) & (size > 0))
    for _ in range(TURNS):
        change = np.where(p[free] == 1, -size[free], size[free]).astype(float)
        order = np.argsort(change, kind="stable")
        ranked = change[order]
        best, turned = abs(off) - 0.5, None
        for wanted in (np.array([-off]), -off - ranked):
            at = np.searchsorted(ranked, wanted)
            for place in (np.maximum(at - 1, 0), np.minimum(at, len(ranked) - 1)):
                if not len(ranked):
                    break
                left = np.abs(ranked[place] - wanted)
                if len(wanted) > 1:
                    left[place == np.arange(len(ranked))] = np.inf
                i = int(np.argmin(left))
                if left[i] < best:
                    best, turned = float(left[i]), [place[i]] if len(wanted) == 1 else [place[i], i]
        if turned is None:
            break
        which = free[order[turned]]
        off += float(change[order[turned]].sum())
        p[which] = 1 - p[which]
    return p


def _decide(last: bool):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        # largest first: what the flight leaves open is small
        group = group.sort_values(["size", "key", "doc_id", "row"], ascending=[False, True, True, True], kind="stable", na_position="first")
        random = np.random.default_rng([int(group["number"].iat[0]), int(group["cell"].iat[0]), len(group)])
        due, size = group["p"].to_numpy(), group["size"].to_numpy()
        p = flight(due, size, random)
        if last:
            p = landing(p, size, due)
        return group.assign(p=p)

    return work


def _numbered(sized: DataFrame) -> DataFrame:
    """Rows with a number that tells equal ones apart; which is which doesn't matter.

    Equal rows are counted and dealt out again, in shares, so that no task makes or numbers them alone.
    """
    counted = sized.groupBy(*sized.columns).agg(F.count("*").alias("same"))
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("same") - 1) / CELL)))
    shared = counted.select("*", shares.alias("share")).repartition(*sized.columns, "share")
    start = F.col("share") * CELL
    return shared.select(
        *sized.columns, F.explode(F.sequence(start, F.least(start + CELL, F.col("same")) - 1)).alias("nth")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, source_size, target, copies, taken).

    ``row_col``: a column that tells rows of one id apart, returned as ``row``.
    """
    row = F.col(row_col) if row_col else F.lit(0)
    sized = checkpointed(
        _numbered(
            docs.select(
                F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                word_count(F.col(text_col)).alias("size"), row.alias("row"),
            )
        )
    )
    targets = checkpointed(source_targets(sized, weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # few sources are broadcast; many are met by a shuffle, where a source of many documents is split
    few = targets.count() <= BROADCAST_SOURCES
    met = sized["source"].eqNullSafe(targets["source"])
    due = sized.join(F.broadcast(targets) if few else targets.hint("merge"), met)
    due = due.select(
        sized["doc_id"], "number", "size", "row", F.xxhash64("doc_id", "size", "row", "nth").alias("key"),
        "source_size", "target", F.least(rate, F.lit(float(most))).alias("rate")
    )
    whole = F.floor(F.col("rate") + _EPS)
    n_cells = max(1, -(-sized.count() // CELL))
    state = due.select(
        "doc_id", "number", "size", "row", "key", "source_size", "target",
        whole.cast("long").alias("whole"),
        F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"),
        F.pmod(F.col("key"), F.lit(n_cells)).alias("cell"),
    )
    columns = (
        "doc_id {id}, number long, size long, row {row}, key long, source_size long, target double, whole long, "
        "p double, cell long"
    ).format(id=docs.schema[id_col].dataType.simpleString(), row=sized.schema["row"].dataType.simpleString())
    decided = []
    while True:
        last = n_cells == 1
        state = checkpointed(
            state.groupBy("number", "cell").applyInPandas(_decide(last), columns)
        )
        decided.append(state.where("p = 0 or p = 1"))
        if last:
            break
        n_cells = -(-n_cells // FAN)
        state = state.where("p > 0 and p < 1").withColumn("cell", F.floor(F.col("cell") / FAN))
    every = decided[0]
    for more in decided[1:]:
        every = every.union(more)
    copies = (F.col("whole") + F.col("p")).cast("long")
    own = ["row"] if row_col else []
    return every.select("doc_id", *own, "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
