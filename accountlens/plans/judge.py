"""Account classifier: train on labelled timelines, score unlabelled ones."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from accountlens.operators.evaluation import (
    SPLIT_SEED,
    accuracy,
    confusion_matrix,
    label_union,
    split_train_test,
)
from accountlens.plans.features import (
    account_features,
    features_from_measures,
    is_measured,
    post_measures,
)
from accountlens.plans.forest import MAX_DEPTH, NUM_TREES, best_forest, cross_validated_forest
from accountlens.schema import (
    ACCOUNT,
    BOT,
    CYBORG,
    FEATURE_COLUMNS,
    HUMAN,
    LABEL,
    POST_SCHEMA,
    PREDICTION_COLUMNS,
)
from accountlens.session import path_exists, stored
from accountlens.sources.posts import posts_from_text, read_posts
from accountlens.sources.tables import (
    read_run,
    read_training_set,
    store_run,
    write_training_set,
)

PREDICTION = "Predicted_categoria"
CLASSES = (HUMAN, BOT, CYBORG)


@dataclass(frozen=True)
class JudgeTraining:
    model: PipelineModel
    accuracy: float | None
    #: Rows are true classes, columns predicted ones; human, bot, cyborg.
    matrix: list[list[int]]
    cv_accuracy: list[float]
    #: Accounts that are labelled more than once: number of them by their labels.
    overlap: dict[tuple[float, ...], int] = field(default_factory=dict)


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features", handleInvalid="error")


def labelled_posts(humans: DataFrame, bots: DataFrame, cyborgs: DataFrame) -> DataFrame:
    return label_union({HUMAN: humans, BOT: bots, CYBORG: cyborgs}, LABEL)


def train_judge(
    humans: DataFrame,
    bots: DataFrame,
    cyborgs: DataFrame,
    spam_model: PipelineModel | None = None,
    num_trees: int = NUM_TREES,
    max_depth: int = MAX_DEPTH,
    training_set_path: str | None = None,
    training_sink: str | None = None,
    model_path: str | None = None,
    overwrite: bool = False,
    **forest_options,
) -> JudgeTraining:
    """Train from the posts of three account classes.

    Posts are read once, into narrow measures (or are such measures already, in a copy the caller
    keeps); the feature frame made from those is stored as well, and splitting, folds and evaluation read that copy. Accounts are split by a
    hash of their id, so none is in both halves. Accounts under several labels are reported, as
    they blur the classes.

    ``model_path`` saves the model. The training half can be kept as well: ``training_set_path``
    replaces a JSON training set, ``training_sink`` adds a run to a table of training rows. Nothing is
    replaced unless the training succeeded: an existing model is an error before any work without
    ``overwrite``, and the training set follows the model it belongs to.
    """
    posts = labelled_posts(humans, bots, cyborgs)
    measures = post_measures(posts, spam_model, labelled=True)
    if model_path and not overwrite and path_exists(posts.sparkSession, model_path):
        raise ValueError(f"{model_path} is there already")
    with (
        nullcontext(measures) if is_measured(posts) else stored(measures, "judge-measures") as measures,
        stored(features_from_measures(measures, labelled=True), "judge-training") as rows,
    ):
        test, training = split_train_test(rows, [ACCOUNT])
        vectors = assembler().transform(training).select(ACCOUNT, "features", LABEL)
        cv = cross_validated_forest(
            vectors, LABEL, PREDICTION, "features", SPLIT_SEED, [ACCOUNT], num_trees, max_depth, **forest_options
        )
        model = PipelineModel([assembler(), best_forest(cv)])
        scored = model.transform(test).select(LABEL, PREDICTION)
        matrix = _matrix(scored)
        overlap = _overlap(rows)
        if model_path:
            save_model(model, model_path, overwrite)
        if training_set_path:
            write_training_set(training, training_set_path)
        if training_sink:
            store_run(training, training_sink, uuid.uuid4().hex)
    return JudgeTraining(model, _accuracy(matrix), matrix, [float(m) for m in cv.avgMetrics], overlap)


def _overlap(rows: DataFrame) -> dict[tuple[float, ...], int]:
    """How many accounts have several labels, by their labels: a row for each set of classes."""
    by_account = rows.groupBy(ACCOUNT).agg(F.sort_array(F.collect_set(LABEL)).alias("labels"))
    counted = by_account.where(F.size("labels") > 1).groupBy("labels").count()
    return {tuple(r["labels"]): r["count"] for r in counted.collect()}


def needs_spam_model(model: PipelineModel) -> bool:
    """Whether the forest splits on the share of spam: without a detector that would be 0 everywhere."""
    return float(model.stages[-1].featureImportances[FEATURE_COLUMNS.index("avg_spam")]) > 0


def training_schema(spark: SparkSession) -> StructType:
    """Schema of a stored training set."""
    schema = StructType([*POST_SCHEMA.fields, StructField(LABEL, DoubleType())])
    return account_features(spark.createDataFrame([], schema), labelled=True).schema


def append_training_set(spark: SparkSession, training_set_path: str, training_sink: str) -> None:
    """Add a stored JSON training set to a table of training rows."""
    rows = read_training_set(spark, training_set_path, training_schema(spark))
    store_run(rows, training_sink, uuid.uuid4().hex)


def _matrix(scored: DataFrame) -> list[list[int]]:
    rows = confusion_matrix(scored, LABEL, PREDICTION, CLASSES).collect()
    by_class = {r[LABEL]: [int(r[f"pred_{int(c)}"]) for c in CLASSES] for r in rows}
    return [by_class[c] for c in CLASSES]


def _accuracy(matrix: list[list[int]]) -> float | None:
    total = sum(map(sum, matrix))
    return sum(matrix[i][i] for i in range(len(matrix))) / total if total else None


def evaluate_judge(model: PipelineModel, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accuracy, confusion matrix) of a model on labelled features, as frames."""
    scored = model.transform(features)
    return accuracy(scored, LABEL, PREDICTION), confusion_matrix(scored, LABEL, PREDICTION, CLASSES)


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Features, predicted class and class probabilities of each account."""
    return (
        model.transform(features)
        .withColumn("probabilidades", vector_to_array("probability"))
        .select(*PREDICTION_COLUMNS)
    )


def score_posts(
    posts: DataFrame,
    judge_model: PipelineModel,
    spam_model: PipelineModel | None = None,
    as_of: Column | None = None,
    stage_path: str | None = None,
) -> DataFrame:
    """Score the accounts behind some posts.

    ``stage_path`` keeps a narrow copy of the posts there (one pass over the input)
    and scores from it; the caller owns that path.
    """
    measures = post_measures(posts, spam_model)
    if stage_path:
        measures.write.mode("overwrite").parquet(stage_path)
        measures = posts.sparkSession.read.schema(measures.schema).parquet(stage_path)
    return score(judge_model, features_from_measures(measures, as_of=as_of))


def score_batch(
    spark: SparkSession,
    paths: str | Sequence[str],
    judge_model: PipelineModel,
    spam_model: PipelineModel | None = None,
    sink: str | None = None,
    stage_path: str | None = None,
) -> DataFrame:
    """Score the timelines in some files; with ``sink`` store the result there as a run.

    With a sink the input is read once, through a stage that is dropped afterwards, and
    the returned frame reads the stored rows: nothing is computed a second time.
    """
    return _scored(read_posts(spark, paths), judge_model, spam_model, sink, stage_path)


def score_timeline(
    spark: SparkSession,
    timeline: str,
    judge_model: PipelineModel,
    spam_model: PipelineModel | None = None,
    sink: str | None = None,
) -> DataFrame:
    """Score one timeline given as JSON lines in a string."""
    return _scored(posts_from_text(spark, timeline), judge_model, spam_model, sink)


def store_scores(
    posts: DataFrame,
    judge_model: PipelineModel,
    spam_model: PipelineModel | None,
    sink: str,
    run: str,
    overwrite: bool = False,
) -> None:
    """Score posts in one pass over them and store the rows as a run."""
    with stored(post_measures(posts, spam_model), "score-measures") as measures:
        scored = score(judge_model, features_from_measures(measures))
        store_run(scored, sink, run, overwrite=overwrite)


def _scored(
    posts: DataFrame,
    judge_model: PipelineModel,
    spam_model: PipelineModel | None,
    sink: str | None,
    stage_path: str | None = None,
) -> DataFrame:
    if sink is None:
        return score_posts(posts, judge_model, spam_model, stage_path=stage_path)
    run = uuid.uuid4().hex
    store_scores(posts, judge_model, spam_model, sink, run)
    return read_run(posts.sparkSession, sink, run).select(*PREDICTION_COLUMNS)


def verdicts(scored: DataFrame) -> DataFrame:
    """Account and probabilities only: (user_id, [human, bot, cyborg])."""
    return scored.select(ACCOUNT, "probabilidades")


def feature_importance(model: PipelineModel) -> DataFrame:
    """(feature, importance) of the forest, one row per vector slot (55)."""
    vector = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.builder.getOrCreate()
    return spark.createDataFrame(
        [(name, float(v)) for name, v in zip(FEATURE_COLUMNS, vector, strict=True)],
        "feature string, importance double",
    )


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
