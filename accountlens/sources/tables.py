"""Stored tables: training sets, scored accounts, and their expiry."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from accountlens.functions import scalars
from accountlens.sources import parts as files

STAMP = "createdAt"
DAY = "created_date"
RUN = "run"
#: How the part of a day begins that holds the rows of several runs.
COMPACTED = "compacted-"
#: Size of a compacted file, about.
FILE_BYTES = 256 << 20


def _day(stamp: Column) -> Column:
    """UTC day, so that writers and readers in different session time zones agree."""
    return scalars.utc_date(scalars.epoch_seconds(stamp))


def write_training_set(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Replace the stored training set."""
    df.write.format(fmt).mode("overwrite").save(path)


def read_training_set(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    """Read a stored training set with its schema (no inference pass)."""
    return spark.read.schema(schema).format(fmt).load(path)


def store_run(
    df: DataFrame, path: str, run: str, fmt: str = "parquet", overwrite: bool = False
) -> None:
    """Add the stamped rows of one run to a table: ``path/created_date=<day>/part=<run>``.

    Days come first, so a reader of some days lists those alone. Partitions are overwritten
    dynamically: only the run's own parts are touched. A repeated run (``overwrite``) replaces all
    its rows, also those of other days and those that :func:`compact` has moved; else a run that
    is there already is an error.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if run.startswith(COMPACTED):
        raise ValueError(f"a run can't be called {run}")
    files.recover(spark, path)
    if overwrite:
        forget_run(spark, path, run, fmt)
    elif any(run in files.parts(spark, path, folder) for folder in files.folders(spark, path)):
        raise ValueError(f"run {run} is in {path} already")
    (
        df.withColumn(RUN, F.lit(run))
        .withColumns({DAY: _day(F.col(STAMP)), files.PART: F.lit(run)})
        .write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY, files.PART)
        .save(path)
    )


def _read(spark: SparkSession, path: str, fmt: str, schema: StructType | None, *below: str) -> DataFrame:
    reader = spark.read.format(fmt).option("basePath", path)
    if schema is not None:
        given = [f for f in schema.fields if f.name not in (RUN, DAY)]
        own = [StructField(RUN, StringType()), StructField(DAY, DateType()), StructField(files.PART, StringType())]
        reader = reader.schema(StructType([*given, *own]))
    return reader.load([f"{path}/{b}" for b in below] if below else path)


def read_rows(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """All rows of all runs, with their ``run`` and the ``created_date`` partition column.

    With the ``schema`` of the rows nothing is inferred from files or folder names.
    """
    return _read(spark, path.rstrip("/"), fmt, schema).drop(files.PART)


def read_run(
    spark: SparkSession, path: str, run: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """Rows of one run, from its own parts and compacted ones."""
    part = F.col(files.PART).cast("string")
    rows = _read(spark, path.rstrip("/"), fmt, schema).where((part == run) | part.startswith(COMPACTED))
    return rows.where(F.col(RUN) == run).drop(files.PART)


def forget_run(spark: SparkSession, path: str, run: str, fmt: str = "parquet") -> None:
    """Remove all rows of a run: its own parts, and its rows in the compacted parts that hold any."""
    path = path.rstrip("/")
    moved = {}
    for folder in files.folders(spark, path):
        names = files.parts(spark, path, folder)
        if run in names:
            files.drop(spark, path, folder, run)
        if compacted := [n for n in names if n.startswith(COMPACTED)]:
            moved[folder] = compacted
    if not moved:
        return
    rows = _read(spark, path, fmt, None, *_below(moved))
    days = rows.where(F.col(RUN) == run).select(F.col(DAY).cast("string")).distinct().collect()
    touched = {f"{DAY}={day}": moved[f"{DAY}={day}"] for (day,) in days}
    if touched:
        rows = _read(spark, path, fmt, None, *_below(touched))
        _rewrite(spark, path, rows.where(F.col(RUN) != run), touched, fmt)


def _below(parts: dict[str, list[str]]) -> list[str]:
    return [f"{folder}/{files.PART}={n}" for folder, names in parts.items() for n in names]


def _rewrite(spark: SparkSession, path: str, rows: DataFrame, old: dict[str, list[str]], fmt: str) -> None:
    """One part of few large files in place of some parts of each of some days, in one job."""
    largest = max(sum(files.size(spark, f"{path}/{folder}/{files.PART}={n}") for n in names) for folder, names in old.items())
    name = f"{COMPACTED}{uuid.uuid4().hex}"
    files.replace(spark, path, rows.drop(files.PART), DAY, old, name, fmt, 1 + largest // FILE_BYTES)


def compact(
    spark: SparkSession, path: str, before: date | None = None, fmt: str = "parquet"
) -> list[str]:
    """Merge the parts of each day (of those ``before``, if given) into one; returns those days.

    Rows keep their run, which can still be read and replaced. So the number of folders follows the
    days, not the batches; leave out the day that is being written to for less work, not for safety:
    parts added meanwhile stay as they are.
    """
    path = path.rstrip("/")
    files.recover(spark, path)
    there = {folder: files.parts(spark, path, folder) for folder in files.folders(spark, path)}
    old = {
        folder: names
        for folder, names in there.items()
        if len(names) > 1 and (before is None or folder.split("=", 1)[1] < before.isoformat())
    }
    if old:
        _rewrite(spark, path, _read(spark, path, fmt, None, *_below(old)), old, fmt)
    return [folder.split("=", 1)[1] for folder in old]


def _as_of(as_of: Column | datetime | None) -> Column:
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of) if isinstance(as_of, datetime) else as_of


def unexpired(
    df: DataFrame,
    ttl_seconds: int,
    as_of: Column | datetime | None = None,
    stamp: str = STAMP,
) -> DataFrame:
    """Rows stamped less than ``ttl_seconds`` before ``as_of`` (default: now).

    On a table written by :func:`store_run` the day predicate prunes partitions.
    """
    oldest = _as_of(as_of) - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))
    live = df.where(F.col(stamp) > oldest)
    return live.where(F.col(DAY) >= _day(oldest)) if DAY in df.columns else live


def _horizon(ttl_seconds: int, as_of: datetime) -> datetime:
    return as_of.astimezone(timezone.utc) - timedelta(seconds=ttl_seconds)


def drop_expired(spark: SparkSession, path: str, ttl_seconds: int, as_of: datetime) -> list[str]:
    """Delete the day partitions that lie wholly before the horizon; returns their days.

    A naive ``as_of`` is local time, as elsewhere in Python. Days are those of the folders' names:
    one listing, whatever they hold. Rows of the horizon's own day stay on disk and are hidden by
    :func:`unexpired`; :func:`expire` removes those as well.
    """
    path, horizon = path.rstrip("/"), _horizon(ttl_seconds, as_of).date().isoformat()
    files.recover(spark, path)
    dropped = []
    for folder in files.folders(spark, path):
        day = folder.split("=", 1)[1]
        if folder.startswith(f"{DAY}=") and day < horizon:
            files.drop(spark, path, folder)
            dropped.append(day)
    return dropped


def expire(
    spark: SparkSession, path: str, ttl_seconds: int, as_of: datetime, fmt: str = "parquet", stamp: str = STAMP
) -> list[str]:
    """Delete every row stamped ``ttl_seconds`` or longer before ``as_of``; returns the days that changed.

    Older days go as folders; the horizon's day alone is read, and rewritten if a row of it is due.
    """
    changed = drop_expired(spark, path, ttl_seconds, as_of)
    path, horizon = path.rstrip("/"), _horizon(ttl_seconds, as_of)
    folder = f"{DAY}={horizon.date().isoformat()}"
    names = files.parts(spark, path, folder)
    if names:
        rows = _read(spark, path, fmt, None, *_below({folder: names}))
        live = F.col(stamp) > F.timestamp_micros(F.lit(_micros(horizon)))
        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(live).alias("live")).first()
        if counts["live"] < counts["n"]:
            if counts["live"]:
                _rewrite(spark, path, rows.where(live), {folder: names}, fmt)
            else:
                files.drop(spark, path, folder)
            changed.append(horizon.date().isoformat())
    return changed


def _micros(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
