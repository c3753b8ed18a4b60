"""Patterns of symbol series of any length, in long form.

A series is rows (keys, pos, symbol), positions from 1 on without gaps; nothing ever holds a series in
one row or brings one together in a task. Windows are numbered by rank doubling: a pattern is named by
the first position it occurs at, and a window of k+1 to 2k symbols is the pair of the names of its first
and its last k symbols. Only windows that occur more than once are kept, as whatever contains a window
that occurs once occurs once itself; so the levels end at the first length whose patterns are all
unique, and everything beyond is arithmetic.

The rows of a level are (keys, l, pos): as many as repeated windows, which is n * l for a series that
repeats itself entirely. Levels are written to the shared folder. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountlens.session import checkpointed

Keys = Sequence[str]
_ACCOUNT = ("user_id",)


def symbol_rows(series: DataFrame, keys: Keys = _ACCOUNT, symbols_col: str = "symbols") -> DataFrame:
    """Series held as arrays, as rows (keys, pos, symbol)."""
    return series.select(*keys, F.posexplode(symbols_col).alias("_pos", "symbol")).select(
        *keys, (F.col("_pos") + 1).cast("long").alias("pos"), "symbol"
    )


def quantised(rows: DataFrame, keys: Keys = _ACCOUNT, value: str = "gap", bins: int | None = None) -> DataFrame:
    """Rows (keys, pos, value) as rows (keys, pos, symbol): right-closed bins of each series' range.

    ``bins`` defaults to the length of the series. Integer arithmetic, as in
    :func:`accountlens.functions.series.symbolize`.
    """
    bounds = rows.groupBy(*keys).agg(
        F.min(value).alias("_low"), (F.max(value) - F.min(value)).alias("_span"), F.count(F.lit(1)).alias("_n")
    )
    n = F.col("_n") if bins is None else F.lit(bins).cast("long")
    symbol = F.expr(f"greatest((({value} - _low) * _bins + _span - 1) div _span - 1, 0)")
    met = rows.join(bounds, list(keys)).withColumn("_bins", n)
    return met.select(*keys, "pos", F.when(F.col("_span") > 0, symbol).otherwise(0).cast("long").alias("symbol"))


def _repeated(windows: DataFrame, keys: Keys, name: Keys) -> DataFrame:
    """Windows (keys, l, pos, name) whose name occurs again, with its first position and count."""
    by = [*keys, "l", *name]
    groups = windows.groupBy(*by).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("occurrences"))
    met = windows.join(groups.where(F.col("occurrences") > 1), by)
    return met.select(*keys, "l", "pos", "first", "occurrences")


def repeated_windows(symbols: DataFrame, keys: Keys = _ACCOUNT) -> DataFrame:
    """(keys, l, pos, first, occurrences) of every window whose pattern occurs more than once."""
    level = checkpointed(_repeated(symbols.select(*keys, F.lit(1).alias("l"), "pos", "symbol"), keys, ["symbol"]))
    found, k = level, 1
    while True:
        named = level.where(F.col("l") == k)
        if named.isEmpty():
            return found
        lengths = F.explode(F.sequence(F.lit(k + 1), F.lit(2 * k)))
        heads = named.select(*keys, "pos", F.col("first").alias("head"), lengths.alias("l")).withColumn(
            "_at", F.col("pos") + F.col("l") - k
        )
        tails = named.select(*keys, F.col("pos").alias("_at"), F.col("first").alias("tail"))
        level = checkpointed(_repeated(heads.join(tails, [*keys, "_at"]), keys, ["head", "tail"]))
        found, k = found.union(level), 2 * k


def _upwards(start: Column, stop: Column) -> Column:
    """Whole numbers from start to stop; none if there are none."""
    return F.explode(F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>")))


def _lengths(symbols: DataFrame, keys: Keys) -> DataFrame:
    return symbols.groupBy(*keys).agg(F.max("pos").cast("int").alias("n"))


def pattern_counts(symbols: DataFrame, keys: Keys = _ACCOUNT, repeated: DataFrame | None = None) -> DataFrame:
    """Every pattern of every length, once: (keys, l, pos, occurrences), ``pos`` its first position.

    ``repeated``: what :func:`repeated_windows` found, if it is at hand.
    """
    repeated = repeated_windows(symbols, keys) if repeated is None else repeated
    again = repeated.where(F.col("pos") == F.col("first")).select(*keys, "l", "pos", "occurrences")
    # a position's windows are unique from one length on
    longest = repeated.groupBy(*keys, "pos").agg(F.max("l").alias("_longest"))
    beyond = _upwards(F.coalesce("_longest", F.lit(0)) + 1, (F.col("n") - F.col("pos") + 1).cast("int"))
    once = (
        symbols.select(*keys, "pos")
        .join(longest, [*keys, "pos"], "left")
        .join(_lengths(symbols, keys), list(keys))
        .select(*keys, beyond.alias("l"), "pos", F.lit(1).cast("long").alias("occurrences"))
    )
    return again.union(once)


def shannon_entropy(
    symbols: DataFrame, keys: Keys = _ACCOUNT, repeated: DataFrame | None = None, all_unique: bool = True
) -> DataFrame:
    """(keys, l, h, singles, total) of every length, from the repeated patterns alone.

    ``h`` = ln N - sum(c ln c) / N in nats, where patterns seen once add nothing. Without
    ``all_unique`` a series ends with the first length whose patterns are all unique.
    """
    repeated = repeated_windows(symbols, keys) if repeated is None else repeated
    c = F.col("occurrences")
    sums = (
        repeated.where(F.col("pos") == F.col("first"))
        .groupBy(*keys, "l")
        .agg(F.sum(c).alias("_seen"), F.sum(c * F.log(c)).alias("_w"))
    )
    lengths = _lengths(symbols, keys)
    if not all_unique:
        last = sums.groupBy(*keys).agg(F.max("l").alias("_last"))
        lengths = lengths.join(last, list(keys), "left").withColumn("last", F.least("n", F.coalesce("_last", F.lit(0)) + 1))
    else:
        lengths = lengths.withColumn("last", F.col("n"))
    total = (F.col("n") - F.col("l") + 1).cast("long")
    return (
        lengths.select(*keys, "n", F.explode(F.sequence(F.lit(1), "last")).alias("l"))
        .join(sums, [*keys, "l"], "left")
        .select(
            *keys, "l",
            (F.log(total) - F.coalesce("_w", F.lit(0.0)) / total).alias("h"),
            (total - F.coalesce("_seen", F.lit(0))).alias("singles"),
            total.alias("total"),
        )
    )


def conditional_entropy(entropies: DataFrame, keys: Keys = _ACCOUNT) -> DataFrame:
    """H(L) - H(L-1) where both lengths are there: (keys, l, ce, singles, total)."""
    before = entropies.select(*keys, (F.col("l") + 1).alias("l"), F.col("h").alias("_h"))
    met = entropies.join(before, [*keys, "l"])
    return met.select(*keys, "l", (F.col("h") - F.col("_h")).alias("ce"), "singles", "total")


def corrected_entropy(symbols: DataFrame, keys: Keys = _ACCOUNT) -> DataFrame:
    """(keys, entropia): the least H(L) - H(L-1) + singles(L) / total(L) * H(1) over L >= 2.

    From the first length L* without repeats on, the term is ln((n-L+1) / (n-L+2)) + H(1), least at
    L = n with H(1) - ln 2; so lengths up to L* are looked at. Series of one symbol have 0.0, those of
    fewer than three symbols null.
    """
    kinds = symbols.groupBy(*keys).agg(
        F.max("pos").alias("_n"), (F.min("symbol") < F.max("symbol")).alias("_varied")
    )
    varied = kinds.where(F.col("_varied") & (F.col("_n") > 2)).select(*keys)
    entropies = checkpointed(
        shannon_entropy(checkpointed(symbols.join(varied, list(keys), "left_semi")), keys, all_unique=False)
    )
    first = entropies.where(F.col("l") == 1).select(*keys, F.col("h").alias("_h1"))
    terms = conditional_entropy(entropies, keys).join(first, list(keys))
    least = terms.groupBy(*keys).agg(F.min(F.col("ce") + F.col("singles") / F.col("total") * F.col("_h1")).alias("_least"))
    tail = first.select(*keys, (F.col("_h1") - F.log(F.lit(2.0))).alias("_tail"))
    found = kinds.join(tail, list(keys), "left").join(least, list(keys), "left")
    value = F.when(F.col("_n") < 3, F.lit(None)).when(~F.col("_varied"), 0.0).otherwise(F.least("_tail", "_least"))
    return found.select(*keys, value.cast("double").alias("entropia"))
