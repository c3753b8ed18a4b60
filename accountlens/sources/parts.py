"""Partition folders whose parts are replaced one folder at a time.

A table is ``root/<column>=<value>/part=<name>/files``. Appending adds a part; a rewrite (compaction,
expiry, the rows of a repeated run) makes one part out of others of the same folder, in steps that can
be taken up again: the new part is written beside the table, under a name that readers skip, with a list
of those it replaces; one rename makes it due; then it is moved in and the old ones go. What was
interrupted before the rename never counts, what was interrupted after it is finished by
:func:`recover`, which every writer calls first. Parts that others add meanwhile aren't touched. Between
the last two steps a reader may see rows twice, but none is ever missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.session import delete_path

PART = "part"
_STAGED, _READY, _REPLACES = "_staged-", "_ready-", "_replaces"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    """Folders directly under a path; none if it doesn't exist."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory())


def folders(spark: SparkSession, root: str) -> list[str]:
    """The table's partition folders, ``column=value``: one listing, not of their parts."""
    return [n for n in _names(spark, root) if "=" in n and not n.startswith(("_", "."))]


def parts(spark: SparkSession, root: str, folder: str) -> list[str]:
    """Names of a folder's parts."""
    prefix = f"{PART}="
    return [n.removeprefix(prefix) for n in _names(spark, f"{root}/{folder}") if n.startswith(prefix)]


def size(spark: SparkSession, path: str) -> int:
    fs, target = _file_system(spark, path)
    return fs.getContentSummary(target).getLength()


def stage(
    spark: SparkSession,
    root: str,
    rows: DataFrame | None,
    column: str,
    old: Mapping[str, Sequence[str]],
    name: str,
    fmt: str = "parquet",
    files: int = 1,
) -> str:
    """Write ``rows`` as the parts that will replace ``old`` (folder: parts); returns where they wait.

    ``rows`` have the partition ``column``, by whose value they go to their folders, all in one job, in
    ``files`` files a folder at most. A folder without rows only loses its old parts.
    """
    path = f"{root}/{_STAGED}{uuid.uuid4().hex}"
    if rows is not None:
        share = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
        dealt = rows.repartition(F.col(column), share) if files > 1 else rows.repartition(column)
        dealt.withColumn(PART, F.lit(name)).write.format(fmt).partitionBy(column, PART).save(path)
    fs, _ = _file_system(spark, path)
    at = lambda below: _file_system(spark, f"{path}/{below}")[1]
    for folder, parts_ in old.items():
        fs.mkdirs(at(folder))
        out = fs.create(at(f"{folder}/{_REPLACES}"))
        out.write("\n".join(parts_).encode())
        out.close()
    return path


def finish(spark: SparkSession, root: str, ready: str) -> None:
    """Move what waits under ``ready`` into the table and drop what it replaces; may be repeated."""
    fs, _ = _file_system(spark, root)
    at = lambda path: _file_system(spark, path)[1]
    for folder in folders(spark, ready):
        for part in _names(spark, f"{ready}/{folder}"):
            fs.mkdirs(at(f"{root}/{folder}"))
            if not fs.exists(at(f"{root}/{folder}/{part}")):
                fs.rename(at(f"{ready}/{folder}/{part}"), at(f"{root}/{folder}/{part}"))
        record = at(f"{ready}/{folder}/{_REPLACES}")
        old = []
        if fs.exists(record):
            listed = fs.open(record)
            old = bytes(listed.readAllBytes()).decode().split("\n")
            listed.close()
        for part in filter(None, old):
            fs.delete(at(f"{root}/{folder}/{PART}={part}"), True)
        if not _names(spark, f"{root}/{folder}"):
            fs.delete(at(f"{root}/{folder}"), True)
    fs.delete(at(ready), True)


def replace(
    spark: SparkSession,
    root: str,
    rows: DataFrame | None,
    column: str,
    old: Mapping[str, Sequence[str]],
    name: str,
    fmt: str = "parquet",
    files: int = 1,
) -> None:
    """Put ``rows`` in the place of parts of some folders, as :func:`stage` takes them."""
    staged = stage(spark, root, rows, column, old, name, fmt, files)
    ready = staged.replace(_STAGED, _READY)
    fs, target = _file_system(spark, staged)
    fs.rename(target, _file_system(spark, ready)[1])
    finish(spark, root, ready)


def recover(spark: SparkSession, root: str) -> None:
    """Finish the rewrites of a writer that was interrupted."""
    for name in _names(spark, root):
        if name.startswith(_READY):
            finish(spark, root, f"{root}/{name}")


def drop(spark: SparkSession, root: str, folder: str, part: str | None = None) -> None:
    """Delete a folder, or one of its parts (with the folder, if it was the last)."""
    if part is None:
        delete_path(spark, f"{root}/{folder}")
        return
    delete_path(spark, f"{root}/{folder}/{PART}={part}")
    if not _names(spark, f"{root}/{folder}"):
        delete_path(spark, f"{root}/{folder}")
