"""The posts a stream has seen, as narrow measures, to score whole timelines from.

A table ``path/bucket=<n>/part=batch-<id>``: an account's posts are in one bucket, a batch adds a part to
the buckets of its accounts. A repeated batch overwrites its own parts. Merging the parts of a bucket
keeps their number bounded; each row keeps the batch it came with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from accountlens.schema import ACCOUNT
from accountlens.sources import parts as files

BUCKET, BATCH = "bucket", "batch_id"
#: Folders the accounts are spread over.
BUCKETS = 64
#: A bucket's parts are merged when there are more.
MOST_PARTS = 32
#: Size of a merged file, about.
FILE_BYTES = 256 << 20


def add(measures: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Store the measures of a batch, in place of an earlier attempt at it."""
    spark = measures.sparkSession
    files.recover(spark, path)
    name = f"batch-{batch_id}"
    # an attempt that had got further may have filled buckets that this one doesn't
    for folder in files.folders(spark, path):
        if name in files.parts(spark, path, folder):
            files.drop(spark, path, folder, name)
    bucket = F.pmod(F.xxhash64(ACCOUNT), F.lit(buckets)).cast("int")
    (
        measures.withColumns({BATCH: F.lit(batch_id).cast("long"), BUCKET: bucket, files.PART: F.lit(name)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET, files.PART)
        .parquet(path)
    )


def timelines_of_batch(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    """All posts, up to a batch, of the accounts that have posts in it.

    Only buckets that the batch has touched are read, and of its accounts only a column to find them.
    """
    name = f"{files.PART}=batch-{batch_id}"
    touched = [f for f in files.folders(spark, path) if name.removeprefix(f"{files.PART}=") in files.parts(spark, path, f)]
    if not touched:
        return spark.createDataFrame([], schema)
    stored = StructType([*schema.fields, StructField(BATCH, LongType())])
    read = lambda paths: spark.read.schema(stored).parquet(*paths)
    accounts = read([f"{path}/{f}/{name}" for f in touched]).select(ACCOUNT).distinct()
    posts = read([f"{path}/{f}/{files.PART}={p}" for f in touched for p in files.parts(spark, path, f)])
    return posts.where(F.col(BATCH) <= batch_id).join(accounts, ACCOUNT, "left_semi").drop(BATCH)


def compact(spark: SparkSession, path: str, below: int, most_parts: int = MOST_PARTS) -> list[str]:
    """Merge the parts of buckets that have more than ``most_parts``, of batches ``below`` a number."""
    files.recover(spark, path)
    old = {}
    for folder in files.folders(spark, path):
        names = files.parts(spark, path, folder)
        due = [n for n in names if not n.startswith("batch-") or int(n.removeprefix("batch-")) < below]
        if len(names) > most_parts and len(due) > 1:
            old[folder] = due
    if old:
        paths = {folder: [f"{path}/{folder}/{files.PART}={n}" for n in names] for folder, names in old.items()}
        largest = max(sum(files.size(spark, p) for p in own) for own in paths.values())
        rows = spark.read.option("basePath", path).parquet(*(p for own in paths.values() for p in own)).drop(files.PART)
        files.replace(spark, path, rows, BUCKET, old, f"merged-{uuid.uuid4().hex}", files=1 + largest // FILE_BYTES)
    return list(old)
