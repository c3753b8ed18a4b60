"""Spam detector: hashed word counts into a random forest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.functions.hashing import hash_bucket
from accountlens.operators.evaluation import accuracy, label_union, split_train_test
from accountlens.plans.forest import MAX_DEPTH, NUM_TREES, best_forest, cross_validated_forest
from accountlens.session import stored

# --- fixed values ---------------------------------------------------------------------
BUCKETS = 140
SPAM, NOT_SPAM = 1.0, 0.0
SPAM_SEED = 100088121
PREDICTION = "predicted_label"


@dataclass(frozen=True)
class SpamTraining:
    model: PipelineModel
    accuracy: float | None
    #: Mean cross-validation accuracy per candidate, in grid order.
    cv_accuracy: list[float]


def text_stages(text: str = "text") -> list:
    """Lower-cased whitespace tokens, then their counts in hashed buckets."""
    return [
        Tokenizer(inputCol=text, outputCol="words"),
        HashingTF(inputCol="words", outputCol="rawFeatures", numFeatures=BUCKETS),
    ]


def tokenize(df: DataFrame, text: str = "text") -> DataFrame:
    return text_stages(text)[0].transform(df)


def hashed_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return PipelineModel(text_stages(text)).transform(df)


def bucket_counts(df: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Hashed word counts in long form: (keys, bucket, n), buckets without words left out.

    One projection, no shuffle: rows that repeat each give their own. A row whose text is null or has
    no words gives none.
    """
    texts = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    counts = hashed_counts(texts, "_text").select(*keys, F.posexplode(vector_to_array("rawFeatures")).alias("bucket", "_n"))
    return counts.where("_n > 0").select(*keys, "bucket", F.col("_n").cast("long").alias("n"))


def word_buckets(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(word, bucket) of every distinct word: the dictionary behind the hashed counts, by expression.

    It tells which words a forest's split on a bucket stands for, in any engine that has the hash.
    """
    words = tokenize(df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")), "_text")
    distinct = words.select(F.explode("words").alias("word")).distinct()
    return distinct.select("word", hash_bucket("word", buckets).alias("bucket"))


def train_spam(
    spam: DataFrame,
    not_spam: DataFrame,
    num_trees: int = NUM_TREES,
    max_depth: int = MAX_DEPTH,
    **forest_options,
) -> SpamTraining:
    """Train on two frames of (id, text); accuracy is that on the held-out fifth.

    The returned model takes any frame with a ``text`` column.
    """
    texts = label_union(
        {SPAM: spam.select("id", "text"), NOT_SPAM: not_spam.select("id", "text")}, "label"
    ).where(F.col("text").isNotNull())
    # Rows are split by post id; a text without one goes by its content.
    split_key = F.coalesce("id", F.xxhash64("text")).alias("id")
    hashed = hashed_counts(texts).select(split_key, "rawFeatures", "label")
    with stored(hashed, "spam-training") as rows:
        test, training = split_train_test(rows, ["id"])
        cv = cross_validated_forest(
            training, "label", PREDICTION, "rawFeatures", SPAM_SEED, ["id"], num_trees, max_depth, **forest_options
        )
        model = PipelineModel([*text_stages(), best_forest(cv)])
        held_out = accuracy(best_forest(cv).transform(test), "label", PREDICTION).first()[0]
    return SpamTraining(model, held_out, [float(m) for m in cv.avgMetrics])


def spam_rate(view: DataFrame, model: PipelineModel, key: str = "user_id") -> DataFrame:
    """Share of each account's posts that the detector calls spam."""
    return model.transform(view).groupBy(key).agg(F.avg(PREDICTION).alias("avg_spam"))
