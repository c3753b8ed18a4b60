"""The sample tables read as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.functions import scalars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The tables hold zone-less times; UTC makes them the instants the engine expects.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_k(props: str = "props") -> Column:
    return F.from_json(props, "k long")["k"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their second and the number inside ``props``."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_id").alias("id"),
        "ts",
        scalars.epoch_seconds("ts").alias("sec"),
        "user_id",
        "event_type",
        "value",
        "props",
        event_k().alias("k"),
    )


def legacy_time(ts: Column) -> Column:
    return F.date_format(ts, "EEE MMM dd HH:mm:ss '+0000' yyyy")


#: Client names per event type: a web one, two mobile ones, one that only looks mobile
#: (rules are case-sensitive) and one that is both (web wins).
CLIENT_NAMES = {
    "click": '<a href="http://example.com">Twitter Web Client</a>',
    "view": '<a href="http://twitter.com/download/android">Twitter for Android</a>',
    "purchase": "Mobile Web (M2)",
    "signup": "ios app",
    "error": "Twitter Web Client for iOS",
}


def _matches(text: str, pattern: str, field: str) -> Column:
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, F.transform(found, lambda m: F.struct(m.alias(field))))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a post of the declared shape.

    The document of the same number is its text, otherwise the event's own words are;
    links, hashtags and mentions are those in the text. The profile attributes change
    from event to event, so that the newest snapshot matters.
    """
    # Both sides grow with the data: never broadcast the texts.
    texts = (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("event_id"), F.col("text").alias("body"))
        .hint("merge")
    )
    source = F.lit(None).cast("string")
    for kind, name in CLIENT_NAMES.items():
        source = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(source)
    k = F.col("k")
    return (
        events(spark, sf_dir)
        .join(texts, "event_id", "left")
        .withColumn("text", F.coalesce("body", F.concat("event_type", F.lit("  "), "props")))
        .select(
            "id",
            legacy_time(F.col("ts")).alias("created_at"),
            "text",
            source.alias("source"),
            F.when(F.col("event_type") != "error", k).alias("in_reply_to_status_id"),
            F.struct(
                _matches("text", "https?://", "expanded_url").alias("urls"),
                _matches("text", "#[A-Za-z0-9_]+", "text").alias("hashtags"),
                _matches("text", "@[A-Za-z0-9_]+", "screen_name").alias("user_mentions"),
            ).alias("entities"),
            F.struct(
                F.col("user_id").alias("id"),
                F.concat("event_type", F.col("user_id").cast("string")).alias("screen_name"),
                legacy_time(F.col("ts") - F.make_dt_interval(k * 30)).alias("created_at"),
                F.when(k % 5 == 0, F.lit("")).when(k % 5 != 1, F.col("props")).alias("description"),
                (F.col("event_type") == "purchase").alias("verified"),
                (F.col("value") > 50).alias("geo_enabled"),
                F.when(k % 3 != 0, k % 2 == 0).alias("default_profile_image"),
                (F.col("value") > 10).alias("profile_use_background_image"),
                k.alias("followers_count"),
                F.floor("value").alias("friends_count"),
                F.when(k % 7 != 0, F.col("id") % 1000).alias("favourites_count"),
                (k % 7).alias("listed_count"),
                F.col("id").alias("statuses_count"),
            ).alias("user"),
        )
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels: (id, text, source, n_chars, quality, toxic)."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    return docs.join(labels, "doc_id").withColumnRenamed("doc_id", "id")
