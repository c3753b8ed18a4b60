"""Reading posts: JSON lines from files or from a column, Parquet, labelled text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.schema import POST_SCHEMA, TEXT_SCHEMA


def read_posts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """JSON-lines timelines: a file, folder, glob or URI, or a list of those."""
    return spark.read.schema(POST_SCHEMA).json(paths if isinstance(paths, str) else list(paths))


def read_posts_table(
    spark: SparkSession, path: str, fmt: str = "parquet"
) -> DataFrame:
    """Posts already stored in a columnar format; absent fields come back null."""
    return spark.read.schema(POST_SCHEMA).format(fmt).load(path)


def ingest_posts(posts: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Store posts in a columnar format.

    Worth doing before scoring a large JSON corpus: the account pipeline scans its
    input twice, and the second scan (three columns) is cheap only on columnar files.
    """
    posts.write.format(fmt).mode(mode).save(path)


def posts_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Posts out of a string column holding one or more JSON lines per row."""
    line = F.explode(F.split(F.col(column), "\r?\n")).alias("line")
    return (
        lines.select(line)
        .where(F.length(F.trim("line")) > 0)
        .select(F.from_json("line", POST_SCHEMA).alias("post"))
        .select("post.*")
    )


def posts_from_text(spark: SparkSession, timeline: str) -> DataFrame:
    """One timeline handed over as a string (an on-demand request)."""
    return posts_from_lines(spark.createDataFrame([(timeline,)], "value string"))


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Only id and text of JSON-lines posts; the rest is never materialised."""
    return spark.read.schema(TEXT_SCHEMA).json(paths if isinstance(paths, str) else list(paths))
