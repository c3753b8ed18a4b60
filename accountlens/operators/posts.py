"""Per-post view and per-account aggregates over posts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountlens.functions import scalars
from accountlens.schema import ACCOUNT, CLIENTS, HOURS, WEEKDAYS


def nonempty(posts: DataFrame, text: str = "text") -> DataFrame:
    """Drop posts without text; null text goes too."""
    return posts.where(F.length(text) > 0)


def post_view(posts: DataFrame, *extra: Column | str) -> DataFrame:
    """Flat, narrow posts with text and an account: what every post feature is made from."""
    return nonempty(posts).where(F.col("user.id").isNotNull()).select(
        F.col("user.id").alias(ACCOUNT),
        "id",
        scalars.epoch_seconds(scalars.parse_created_at("created_at")).alias("sec"),
        "text",
        "source",
        "in_reply_to_status_id",
        F.col("entities.urls").alias("entities_url"),
        F.col("entities.hashtags").alias("entities_hashtags"),
        F.col("entities.user_mentions").alias("entities_user_mentions"),
        *extra,
    )


# Row measures: one number (or bucket name) per post, under the name of the feature its
# mean or share becomes. They are projected before any aggregate, so that no sort or
# shuffle carries text or arrays.

Columns = dict[str, Column]


def calendar_measures(seconds: str = "sec") -> Columns:
    return {"dia": scalars.weekday_of(seconds), "hora": scalars.hour_of(seconds)}


def text_measures(text: str = "text") -> Columns:
    return {
        "avg_diversidad_lex": scalars.char_diversity(text),
        "avg_long_tweets": F.length(text),
        "avg_palabras": scalars.word_count(text),
        "avg_diversidad_palabras": scalars.word_diversity(text),
    }


def entity_measures(
    urls: str = "entities_url",
    hashtags: str = "entities_hashtags",
    mentions: str = "entities_user_mentions",
) -> Columns:
    return {
        "url_ratio": scalars.size_or_zero(urls),
        "avg_hashtags": scalars.size_or_zero(hashtags),
        "mention_ratio": scalars.size_or_zero(mentions),
    }


def reply_measure(reply_to: str = "in_reply_to_status_id") -> Columns:
    return {"reply_ratio": scalars.truthy_number(reply_to)}


def _bucket_counts(column: str, buckets: Mapping[str, object]) -> Columns:
    # Not count_if: that projects one boolean per call below the aggregate, to be sorted along.
    return {
        name: F.expr(f"count(CASE WHEN {column} = {value!r} THEN 1 END)") for name, value in buckets.items()
    }


def weekday_counts(day: str = "dia") -> Columns:
    return _bucket_counts(day, {name: i for i, name in enumerate(WEEKDAYS)})


def hour_counts(hour: str = "hora") -> Columns:
    return _bucket_counts(hour, {name: i for i, name in enumerate(HOURS)})


def client_counts(bucket: str = "fuente", names: Sequence[str] = CLIENTS) -> Columns:
    return _bucket_counts(bucket, {name: name for name in names})


def sums_of(measures: Iterable[str]) -> Columns:
    return {name: F.sum(name) for name in measures}


def shares(
    rows: DataFrame, key: str, measures: Columns, aggregates: Columns, total: str = "nroTweets"
) -> DataFrame:
    """Aggregates of row measures over the group's row count, from one shuffle.

    A bucket without rows comes out as 0.
    """
    grouped = (
        rows.select(key, *[c.alias(k) for k, c in measures.items()])
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias(total), *[c.alias(k) for k, c in aggregates.items()])
    )
    return grouped.selectExpr(key, total, *[f"{k} / {total} AS {k}" for k in aggregates])


def account_post_count(view: DataFrame, key: str = ACCOUNT, text: str = "text") -> DataFrame:
    return view.groupBy(key).agg(F.count(text).alias("nroTweets"))


def weekday_profile(view: DataFrame, key: str = ACCOUNT, seconds: str = "sec") -> DataFrame:
    """Share of an account's posts on each weekday."""
    return shares(view, key, {"dia": scalars.weekday_of(seconds)}, weekday_counts())


def hour_profile(view: DataFrame, key: str = ACCOUNT, seconds: str = "sec") -> DataFrame:
    """Share of an account's posts in each hour of the day."""
    return shares(view, key, {"hora": scalars.hour_of(seconds)}, hour_counts())


def client_profile(
    view: DataFrame,
    key: str = ACCOUNT,
    source: str = "source",
    rules: Mapping[str, Sequence[str]] = scalars.CLIENT_RULES,
) -> DataFrame:
    """Share of an account's posts sent through each kind of client."""
    return shares(view, key, {"fuente": scalars.client_bucket(source, rules)}, client_counts())


def text_features(view: DataFrame, key: str = ACCOUNT, text: str = "text") -> DataFrame:
    """Mean length, word count and diversity of an account's texts."""
    measures = text_measures(text)
    return shares(view, key, measures, sums_of(measures))


def entity_ratios(view: DataFrame, key: str = ACCOUNT, **columns: str) -> DataFrame:
    """Links, hashtags and mentions per post."""
    measures = entity_measures(**columns)
    return shares(view, key, measures, sums_of(measures))


def reply_ratio(
    view: DataFrame, key: str = ACCOUNT, reply_to: str = "in_reply_to_status_id"
) -> DataFrame:
    """Share of posts that answer another one."""
    measures = reply_measure(reply_to)
    return shares(view, key, measures, sums_of(measures))


def prediction_rate(
    scored: DataFrame, key: str = ACCOUNT, prediction: str = "predicted_label"
) -> DataFrame:
    """Mean hard prediction per account."""
    return scored.groupBy(key).agg(F.avg(prediction).alias("avg_spam"))
