"""Rows in a global order, without a window over any key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlens.session import checkpointed

_BITS = 33


def numbered(rows: DataFrame, order: Sequence[str], name: str = "_n") -> DataFrame:
    """``rows`` with consecutive numbers from 0 in ascending ``order`` (nulls first).

    One range exchange, whose ranges also divide a key that has most of the rows, and one aggregate
    to a row per partition. The frame is written to the shared folder, so the numbers stay what they
    are however often it is read; rows equal in all of ``order`` are numbered in any order.
    """
    at = F.monotonically_increasing_id()  # partition, then place in it
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part, within = F.shiftright("_at", _BITS), F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    parts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    starts = parts.select("_part", before.alias("_before"))
    # a row per partition: small, whatever the partitions hold
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*rows.columns, (F.col("_before") + within).alias(name))
    )
