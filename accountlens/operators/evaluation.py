"""Splits, unions and quality measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountlens.schema import LABEL

# --- fixed value ----------------------------------------------------------------------
SPLIT_SEED = 1800009193
TEST_PERCENT = 20


def label_union(classes: Mapping[float, DataFrame], label: str = LABEL) -> DataFrame:
    """Union by name of one frame per class, each marked with its label."""
    marked = [df.withColumn(label, F.lit(float(value))) for value, df in classes.items()]
    return reduce(lambda a, b: a.unionByName(b), marked)


def split_bucket(keys: Sequence[str], seed: int = SPLIT_SEED, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 of a row, from a hash of its keys.

    The first 8 hex digits of an MD5, so other engines can reproduce the split.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(number, F.lit(buckets)).cast("int")


def split_train_test(
    df: DataFrame, keys: Sequence[str], test_percent: int = TEST_PERCENT, seed: int = SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """(test, train) by key hash: the same row lands on the same side in every run,
    whatever the partitioning, and an account is never on both sides."""
    bucket = split_bucket(keys, seed)
    return df.where(bucket < test_percent), df.where(bucket >= test_percent)


def confusion_matrix(
    scored: DataFrame,
    label: str,
    prediction: str,
    classes: Sequence[float] = (0.0, 1.0, 2.0),
) -> DataFrame:
    """One row per true class with a count column per predicted class, in one pass.

    Classes without rows get zeros. The result is len(classes) rows.
    """
    columns = [f"pred_{int(c)}" for c in classes]
    cells = [
        F.count_if((F.col(label) == t) & (F.col(prediction) == p)).alias(f"c_{i}_{j}")
        for i, t in enumerate(classes)
        for j, p in enumerate(classes)
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias(label),
                *[F.col(f"c_{i}_{j}").alias(columns[j]) for j in range(len(classes))],
            )
            for i, t in enumerate(classes)
        ]
    )
    return scored.agg(*cells).select(F.inline(rows))


def accuracy(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of rows whose prediction is the label: one row, NULL without input."""
    return scored.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def fill_zero(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Null numbers to 0; other columns keep their nulls, and ``keys`` stay untouched
    (so a frame partitioned by them is still known to be)."""
    return df.fillna(0, [c for c in df.columns if c not in keys])
