"""Random forests chosen by cross-validation over ``maxBins``, repeatable on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountlens.operators.evaluation import split_bucket
from accountlens.session import checkpointed

# --- fixed values ---------------------------------------------------------------------
NUM_TREES = 20
MAX_DEPTH = 8
FOLDS = 5
MAX_BINS = (50, 100)

#: Rows of a partition of a training frame, about. The bootstrap samples depend on the partitions, so
#: their number follows from the rows alone.
PARTITION_ROWS = 20_000


def cross_validated_forest(
    training: DataFrame,
    label: str,
    prediction: str,
    features: str,
    seed: int,
    keys: Sequence[str],
    num_trees: int = NUM_TREES,
    max_depth: int = MAX_DEPTH,
    folds: int = FOLDS,
    max_bins: Sequence[int] = MAX_BINS,
    parallelism: int = 8,
    partition_rows: int = PARTITION_ROWS,
    keep_folds: bool = False,
) -> CrossValidatorModel:
    """Fit every candidate on every fold, several at a time; best by accuracy.

    ``training`` should be a stored frame with the feature vector already in it. ``keys`` name its
    rows: folds go by their hash, and rows are dealt by it and sorted, so the same rows give the same
    model however they were partitioned. They are dealt once, into a checkpoint that keeps the partitions
    and their order; every fold and candidate reads that. Rows that share their keys share a fold.
    ``keep_folds`` keeps the models of each fold, for :func:`out_of_fold`.
    """
    partitions = -(-training.count() // partition_rows)
    training = checkpointed(
        training.select(*dict.fromkeys([*keys, features, label]))
        .withColumn("fold", fold_of(keys, seed, folds))
        .repartition(max(1, partitions), *keys)
        .sortWithinPartitions(*keys, label)
    )
    forest = RandomForestClassifier(
        labelCol=label,
        predictionCol=prediction,
        featuresCol=features,
        seed=seed,
        maxDepth=max_depth,
        numTrees=num_trees,
    )
    evaluator = MulticlassClassificationEvaluator(
        labelCol=label, predictionCol=prediction, metricName="accuracy"
    )
    grid = ParamGridBuilder().addGrid(forest.maxBins, list(max_bins)).build()
    return CrossValidator(
        estimator=forest,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        seed=seed,
        parallelism=parallelism,
        collectSubModels=keep_folds,
    ).fit(training)


def fold_of(keys: Sequence[str], seed: int, folds: int = FOLDS) -> Column:
    """Fold of a row, from a hash of its keys."""
    return split_bucket(keys, seed, folds)


def out_of_fold(cv: CrossValidatorModel, training: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """``training`` once for each candidate, predicted by the model that hasn't seen the row's fold.

    Adds fold, candidate (its number in the grid) and max_bins to what the models add. One pass over
    the rows for each candidate and fold, none over another fold's.
    """
    rows = training.withColumn("fold", fold_of(keys, seed, len(cv.subModels)))
    found = None
    for fold, models in enumerate(cv.subModels):
        own = rows.where(F.col("fold") == fold)
        for candidate, model in enumerate(models):
            bins = cv.getEstimatorParamMaps()[candidate][cv.getEstimator().maxBins]
            part = model.transform(own).withColumns({"candidate": F.lit(candidate), "max_bins": F.lit(bins)})
            found = part if found is None else found.unionByName(part)
    return found


def fold_accuracy(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """(candidate, max_bins, accuracy): the mean over folds of each fold's accuracy."""
    hit = F.avg((F.col(label) == F.col(prediction)).cast("double"))
    by_fold = predicted.groupBy("candidate", "max_bins", "fold").agg(hit.alias("_accuracy"))
    return by_fold.groupBy("candidate", "max_bins").agg(F.avg("_accuracy").alias("accuracy"))


def best_forest(cv: CrossValidatorModel) -> RandomForestClassificationModel:
    return cv.bestModel
