"""What the corpus operators share: checkpoints, word hashes, tasks over whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from accountlens.session import delete_path, new_path, shared_dir

#: Words a task remembers the hash of; a full memory is emptied and filled anew.
REMEMBERED_WORDS = 300_000
#: Characters of text that a task holds as words at a time.
TEXT_SLICE = 1_000_000


def checkpointed(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    A lost executor then costs a read of those files; Spark deletes them when nothing
    refers to the frame any more, if ``cleanCheckpoints`` is on. With ``tidy`` that, and the removal
    of shuffle files nothing refers to, happens now: see :func:`drop_unused`.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    written = df.checkpoint(eager=True)
    if tidy:
        drop_unused(df.sparkSession)
    return written


def drop_unused(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage, which it seldom does by itself.
    """
    spark.sparkContext._jvm.System.gc()



class Scratch:
    """Intermediate tables in the shared folder, deleted together on exit.

    They take less room than checkpoints. What leaves the block must not read them: checkpoint it.
    With ``tidy`` the shuffle files behind a table go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False) -> None:
        self.spark, self.path, self.tidy = spark, new_path(spark, "scratch"), tidy
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{len(self.tables)}"
        df.write.parquet(path)
        if self.tidy:
            drop_unused(self.spark)
        self.tables.append(self.spark.read.schema(df.schema).parquet(path))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more before the block ends."""
        for i, table in enumerate(self.tables):
            if any(table is t for t in tables):
                delete_path(self.spark, f"{self.path}/{i}")

    def __exit__(self, *_) -> None:
        delete_path(self.spark, self.path)


def map_arrow(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], ddl: str, most_rows: int | None = None
) -> DataFrame:
    """Rows of ``df`` through ``make()(batch) -> columns``, one call of ``make`` per task.

    ``most_rows``: what a call gets and gives at a time, if a batch of Spark's and its results are too much.
    """
    schema = _parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in (part for whole in batches for part in _parts(whole, most_rows)):
            columns = work(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, arrow)],
                schema=arrow,
            )

    return df.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, most_rows: int | None) -> list[pa.RecordBatch]:
    n = batch.num_rows
    return [batch.slice(i, most_rows) for i in range(0, n, most_rows)] if most_rows and n > most_rows else [batch]


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], list], ddl: str) -> DataFrame:
    """``work(table) -> columns`` over tables of whole groups, in order of the (long) keys.

    Groups must be of bounded size: a task holds one Arrow batch and one group.
    """
    schema = _parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)

    def last_group(batch: pa.RecordBatch) -> int:
        same = np.ones(batch.num_rows, dtype=bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        other = np.flatnonzero(~same)
        return int(other[-1]) + 1 if len(other) else 0

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = work(pa.Table.from_batches(held))
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, arrow)]
        yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            start = last_group(batch)
            if start == 0 and held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
                yield from done(held)
                held = []
            if start:
                yield from done([*held, batch.slice(0, start)])
                held = []
            held.append(batch.slice(start))
        if held:
            yield from done(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered for recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """The runs of characters other than space and TAB..CR, A-Z in lower case."""
    # bytes.lower and bytes.split know exactly these letters and separators
    return (text or "").encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers, well mixed and reversible."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
