"""Time between consecutive posts of an account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlens.operators.ordered import numbered

#: Shares of an account that are cut to their oldest posts before these meet.
SHARES = 512

# --- fixed values ---------------------------------------------------------------------
#: An account needs more than this many gaps to be looked at.
MIN_GAPS = 3
#: The entropy series is gaps 2..110 of the account, oldest first.
SERIES_START = 2
SERIES_LENGTH = 109
LAST_GAP = SERIES_START + SERIES_LENGTH - 1


def _dated(posts: DataFrame, key: str, seconds: str, order: tuple[str, ...]) -> DataFrame:
    """Posts with an account and a time, numbered by account, time and ``order``."""
    columns = list(dict.fromkeys([key, *order, seconds]))
    rows = posts.where(F.col(key).isNotNull() & F.col(seconds).isNotNull()).select(*columns)
    return numbered(rows, list(dict.fromkeys([key, seconds, *order])), "_n")


def _with_gap(rows: DataFrame, key: str, seconds: str) -> DataFrame:
    before = rows.select(key, (F.col("_n") + 1).alias("_n"), F.col(seconds).alias("_before"))
    return rows.join(before, [key, "_n"], "left").withColumn("gap", F.col(seconds) - F.col("_before"))


def post_gaps(
    posts: DataFrame,
    key: str = "user_id",
    seconds: str = "sec",
    order: tuple[str, ...] = ("sec", "id"),
) -> DataFrame:
    """Seconds since the account's previous post, per post: (key, *order, seconds, gap).

    The first post of an account has a null gap. Posts follow each other by ``seconds``;
    ``order`` decides within a second, where it only says which post gets the gap.

    Posts are numbered in one global order and each meets the one numbered before it, so neither
    an account nor a time can be hot: both exchanges are of single rows.
    """
    rows = _dated(posts, key, seconds, order)
    return _with_gap(rows, key, seconds).select(*[c for c in rows.columns if c != "_n"], "gap")


def gap_rows(
    posts: DataFrame, key: str = "user_id", seconds: str = "sec", min_gaps: int = MIN_GAPS, start: int = SERIES_START
) -> DataFrame:
    """Gaps of accounts with more than ``min_gaps`` of them, from gap ``start`` on: (key, pos, gap).

    ``pos`` counts from 1 in the order of time. The whole timeline, however long: no list is made.
    """
    rows = _dated(posts, key, seconds, (seconds,))
    accounts = rows.groupBy(key).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_posts"))
    long_ones = accounts.where(F.col("_posts") > min_gaps + 1)
    nth = F.col("_n") - F.col("_first")
    placed = _with_gap(rows, key, seconds).join(long_ones, key).where(nth >= start)
    return placed.select(key, (nth - start + 1).alias("pos"), "gap")


def first_gaps(
    posts: DataFrame,
    keys: tuple[str, ...] = ("user_id",),
    seconds: str = "sec",
    min_gaps: int = MIN_GAPS,
    last_gap: int = LAST_GAP,
) -> DataFrame:
    """Oldest gaps of each account with more than ``min_gaps`` of them: (keys, gaps).

    Each account is cut to its first ``last_gap + 1`` posts, so the collected list is
    bounded. The cut is made twice: among the posts of a share of the input partitions,
    then among what the shares leave. So a task receives at most ``SHARES`` times
    ``last_gap + 1`` posts of an account in the second step, however many input partitions
    there are. Posts of the same second tie freely: only their sorted seconds matter.
    """
    share = F.pmod(F.spark_partition_id(), F.lit(SHARES)).alias("_share")
    dated = posts.where(F.col(seconds).isNotNull()).select(*keys, F.col(seconds).alias("_s"), share)
    oldest = dated
    for group in ((*keys, "_share"), keys):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("_s"))
        oldest = oldest.withColumn("_rank", rank).where(F.col("_rank") <= last_gap + 1)
    times = oldest.groupBy(*keys).agg(F.sort_array(F.collect_list("_s")).alias("_times"))
    gaps = F.zip_with(
        F.slice("_times", 1, F.size("_times") - 1),
        F.slice("_times", 2, F.size("_times") - 1),
        lambda earlier, later: later - earlier,
    )
    return times.where(F.size("_times") > min_gaps + 1).select(*keys, gaps.alias("gaps"))


def gap_series(gaps: str = "gaps", length: int | None = SERIES_LENGTH):
    """The slice of the gap list that enters the entropy; without ``length`` all from the second gap on."""
    return F.slice(gaps, F.lit(SERIES_START), F.size(gaps) if length is None else F.lit(length))


def with_min_history(
    posts: DataFrame, key: str = "user_id", seconds: str = "sec", min_gaps: int = MIN_GAPS
) -> DataFrame:
    """Posts of accounts with more than ``min_gaps`` gaps (``min_gaps`` + 2 dated posts).

    A semi-join with the counted accounts; Spark splits the posts of a very large account.
    """
    counts = posts.groupBy(key).agg(F.count(seconds).alias("_dated"))
    return posts.join(counts.where(F.col("_dated") > min_gaps + 1).select(key), key, "left_semi").select(*posts.columns)
