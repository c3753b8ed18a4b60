"""Row-level functions as Spark column expressions (no Python UDF anywhere)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# --- fixed values: client-name rules of the data contract --------------------------
WEB_CLIENT = "Twitter Web Client"
MOBILE_CLIENTS = (
    "http://twitter.com/download/android",
    "Twitter for Android",
    "http://blackberry.com/twitter",
    "Twitter for BlackBerry",
    "https://mobile.twitter.com",
    "Mobile Web",
    "http://twitter.com/download/iphone",
    "iOS",
    "http://twitter.com/#!/download/ipad",
    "Huawei Social Phone",
    "Windows Phone",
    "Twitter for Nokia S40",
)
#: bucket -> literals, first bucket with a match wins, anything else is ``uso_terceros``.
CLIENT_RULES: Mapping[str, Sequence[str]] = {
    "uso_web": (WEB_CLIENT,),
    "uso_mobil": MOBILE_CLIENTS,
}
OTHER_CLIENT = "uso_terceros"

SECONDS_PER_DAY = 86_400


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time ---------------------------------------------------------------------------


def parse_created_at(text: ColumnOrName) -> Column:
    """``Tue Dec 15 00:06:30 +0000 2015`` -> timestamp; unparsable text gives NULL.

    The leading weekday is redundant and Spark's parser rejects it, so it is cut off.
    """
    return F.try_to_timestamp(F.substring(_col(text), 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))


def epoch_seconds(ts: ColumnOrName) -> Column:
    return F.unix_timestamp(_col(ts))


def utc_date(seconds: ColumnOrName) -> Column:
    return F.date_from_unix_date(
        F.floor(_col(seconds) / F.lit(SECONDS_PER_DAY)).cast("int")
    )


# Calendar parts are taken from epoch seconds, so they are the UTC ones whatever the
# session time zone is.
def year_of(seconds: ColumnOrName) -> Column:
    return F.year(utc_date(seconds))


def month_of(seconds: ColumnOrName) -> Column:
    return F.month(utc_date(seconds))


def weekday_of(seconds: ColumnOrName) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(utc_date(seconds))


def weekday_name(seconds: ColumnOrName) -> Column:
    return F.date_format(utc_date(seconds), "EEEE")


def hour_of(seconds: ColumnOrName) -> Column:
    return F.floor(F.pmod(_col(seconds), F.lit(SECONDS_PER_DAY)) / F.lit(3600)).cast("int")


# --- truthiness, sizes, guarded ratios ------------------------------------------------


def truthy_bool(c: ColumnOrName) -> Column:
    return F.coalesce(_col(c), F.lit(False)).cast("int")


def truthy_text(c: ColumnOrName) -> Column:
    return F.coalesce(F.length(_col(c)) > 0, F.lit(False)).cast("int")


def truthy_number(c: ColumnOrName) -> Column:
    return F.coalesce(_col(c) != 0, F.lit(False)).cast("int")


def size_or_zero(c: ColumnOrName) -> Column:
    return F.coalesce(F.size(_col(c)), F.lit(0))


def reputation(followers: ColumnOrName, friends: ColumnOrName) -> Column:
    """followers / (followers + friends), 0.0 when there are neither."""
    total = _col(followers) + _col(friends)
    return F.when(total > 0, _col(followers) / total).otherwise(F.lit(0.0))


def followers_ratio(followers: ColumnOrName, friends: ColumnOrName) -> Column:
    """followers / friends, 0.0 without friends."""
    return F.when(_col(friends) > 0, _col(followers) / _col(friends)).otherwise(F.lit(0.0))


# --- text -----------------------------------------------------------------------------


def char_diversity(text: ColumnOrName) -> Column:
    """Distinct characters over length; 0.0 for empty text."""
    c = _col(text)
    distinct = F.size(F.array_distinct(F.split(c, "")))
    return F.when(F.length(c) > 0, distinct / F.length(c)).otherwise(F.lit(0.0))


def words(text: ColumnOrName) -> Column:
    """Pieces between single spaces; runs of spaces give empty pieces, which count."""
    return F.split(_col(text), " ", -1)


def word_count(text: ColumnOrName) -> Column:
    return F.size(words(text))


def word_diversity(text: ColumnOrName) -> Column:
    return F.size(F.array_distinct(words(text))) / F.size(words(text))


def client_bucket(
    source: ColumnOrName,
    rules: Mapping[str, Sequence[str]] = CLIENT_RULES,
    otherwise: str = OTHER_CLIENT,
) -> Column:
    """Name of the first rule one of whose literals occurs in ``source``."""
    c = _col(source)
    bucket = F.lit(otherwise)
    for name, literals in reversed(list(rules.items())):
        hit = reduce(or_, (F.contains(c, F.lit(s)) for s in literals))
        bucket = F.when(hit, F.lit(name)).otherwise(bucket)
    return bucket
