"""Gap-series entropy as DataFrame operators.

Input frames hold one array per account, of a bounded number of gaps. Exploding it and grouping
again on (account, ...) needs no further shuffle while the frame is still partitioned by account,
as it is straight after :func:`accountlens.operators.gaps.first_gaps`. Series of any length, and all
lengths of patterns at once, are the business of :mod:`accountlens.operators.patterns`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlens.functions import series
from accountlens.operators import patterns
from accountlens.operators.gaps import SERIES_LENGTH, gap_series
from accountlens.session import checkpointed


def gap_symbols(
    gaps: DataFrame, keys: Sequence[str] = ("user_id",), series_col: str = "gaps", bins: int | None = None
) -> DataFrame:
    """Quantised series: (keys, symbols). All of the array is read; ``bins`` defaults to its length."""
    return gaps.select(*keys, series.symbolize(series_col, bins).alias("symbols"))


def pattern_counts(
    symbols: DataFrame, lengths: Sequence[int] | None = None, keys: Sequence[str] = ("user_id",)
) -> DataFrame:
    """Occurrences of every pattern of the asked lengths, or of all: (keys, l, pattern, occurrences)."""
    asked = F.sequence(F.lit(1), F.size("symbols")) if lengths is None else F.array(*[F.lit(n) for n in lengths])
    windows = symbols.select(*keys, "symbols", F.explode(asked).alias("l")).where(
        (F.size("symbols") > 0) & (F.size("symbols") >= F.col("l"))
    )
    return (
        windows.select(*keys, "l", F.explode(series.patterns("symbols", "l")).alias("pattern"))
        .groupBy(*keys, "l", "pattern")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def shannon_entropy(counts: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Entropy in nats and number of patterns seen once: (keys, l, h, singles, total)."""
    c = F.col("occurrences")
    total = F.sum(c)
    # -sum(p ln p) with p = c / total, in one pass over the counts.
    return counts.groupBy(*keys, "l").agg(
        (F.log(total) - F.sum(c * F.log(c)) / total).alias("h"),
        F.count_if(c == 1).alias("singles"),
        total.alias("total"),
    )


def conditional_entropy(entropies: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """H(L) - H(L-1) for consecutive lengths: (keys, l, ce, singles, total)."""
    by_length = Window.partitionBy(*keys).orderBy("l")
    return (
        entropies.withColumn("_h", F.lag("h").over(by_length))
        .withColumn("_l", F.lag("l").over(by_length))
        .where(F.col("_l") == F.col("l") - 1)
        .select(*keys, "l", (F.col("h") - F.col("_h")).alias("ce"), "singles", "total")
    )


def series_entropy(gap_rows: DataFrame, keys: Sequence[str] = ("user_id",), bins: int | None = None) -> DataFrame:
    """Corrected conditional entropy of whole gap series in long form: (keys, entropia).

    ``gap_rows`` (keys, pos, gap) as of :func:`accountlens.operators.gaps.gap_rows`; series of any
    length, none of which is ever held in a row.
    """
    return patterns.corrected_entropy(checkpointed(patterns.quantised(gap_rows, keys, bins=bins)), keys)


def corrected_entropy(
    gaps: DataFrame, keys: Sequence[str] = ("user_id",), length: int | None = SERIES_LENGTH
) -> DataFrame:
    """The account's entropy feature: (keys, entropia).

    It reads ``length`` gaps from the second on: 109 is what the feature is defined by, None takes
    the whole list that ``gaps`` holds.
    """
    chosen = gaps.select(*keys, gap_series(length=length).alias("_series"))
    return chosen.select(*keys, series.gap_entropy("_series").alias("entropia"))
