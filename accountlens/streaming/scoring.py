"""Scoring timelines as they arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from accountlens.plans.features import features_from_measures, post_measures
from accountlens.plans.judge import score
from accountlens.schema import ACCOUNT, POST_SCHEMA
from accountlens.sources.tables import DAY, RUN, STAMP, read_rows, store_run
from accountlens.streaming import history as timelines


def score_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    judge_model: PipelineModel,
    spam_model: PipelineModel | None = None,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    history: str | None = None,
    buckets: int = timelines.BUCKETS,
) -> StreamingQuery:
    """Score accounts whenever posts of theirs arrive as files under ``source``; store the results.

    An account is scored from its whole timeline: a batch's posts are added, as narrow measures, to a
    table of all posts the stream has seen (``history``, by default inside the checkpoint), and the
    accounts it touches are scored from there. So posts may be dealt to files and batches in any way,
    and ``max_files_per_trigger`` changes how often an account is scored, not what its last score is.
    The spam detector sees each post once.

    Rows of a batch are stored as run ``<query>-<batch>``. A repeated batch replaces its posts and its
    rows, which makes the sink exactly-once. The query's id is kept in its checkpoint, so streams
    with checkpoints of their own can share a sink, and each has a history of its own.
    :func:`latest_scores` reads one row per account.
    """
    reader = spark.readStream.schema(POST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    seen = (history or f"{checkpoint.rstrip('/')}/posts").rstrip("/")

    def score_one(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        measures = post_measures(batch, spam_model)
        timelines.add(measures, seen, batch_id, buckets)
        whole = timelines.timelines_of_batch(own, seen, batch_id, measures.schema)
        scored = score(judge_model, features_from_measures(whole))
        store_run(scored, sink, f"{_query_id(own, checkpoint)}-{batch_id}", overwrite=True)
        timelines.compact(own, seen, batch_id)

    writer = reader.json(source).writeStream.foreachBatch(score_one).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_scores(spark: SparkSession, sink: str) -> DataFrame:
    """The newest row of each account in a sink of scores (ties: the run of the greatest name)."""
    rows = read_rows(spark, sink)
    newest = F.max_by(F.struct(*rows.columns), F.struct(STAMP, RUN)).alias("_row")
    return rows.groupBy(ACCOUNT).agg(newest).select("_row.*").drop(RUN, DAY)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the stream that owns a checkpoint; it outlives restarts."""
    return spark.read.json(f"{checkpoint}/metadata", schema="id string").first()["id"]
