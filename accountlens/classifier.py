"""The two models together, behind the operations a service would offer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from accountlens.plans import judge, spam
from accountlens.sources.posts import read_posts, read_texts

SPAM_MODEL, JUDGE_MODEL = 0, 1
Paths = str | Sequence[str]


class AccountClassifier:
    """Holds a spam detector and an account classifier for one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.spam_model: PipelineModel | None = None
        self.judge_model: PipelineModel | None = None
        #: Accounts with several labels in the last training, by their labels.
        self.overlap: dict[tuple[float, ...], int] = {}

    def train_spam(self, spam_paths: Paths, not_spam_paths: Paths, **options) -> float | None:
        """Train the detector from two sets of JSON lines; returns held-out accuracy."""
        result = spam.train_spam(
            read_texts(self.spark, spam_paths), read_texts(self.spark, not_spam_paths), **options
        )
        self.spam_model = result.model
        return result.accuracy

    def train_judge(
        self, humans: Paths, cyborgs: Paths, bots: Paths, model_path: str | None = None, **options
    ) -> tuple[float | None, list[list[int]]]:
        """Train from three sets of timelines; returns (accuracy, confusion matrix).

        With ``model_path`` the model is saved there and its training set next to it, in that
        order, once training has succeeded; a model that is there already needs ``overwrite=True``.
        ``overlap`` then tells how many accounts had several labels.
        """
        result = judge.train_judge(
            read_posts(self.spark, humans),
            read_posts(self.spark, bots),
            read_posts(self.spark, cyborgs),
            self.spam_model,
            training_set_path=f"{model_path}_trainingset" if model_path else None,
            model_path=model_path,
            **options,
        )
        self.judge_model, self.overlap = result.model, result.overlap
        return result.accuracy, result.matrix

    def score(self, paths: Paths, sink: str | None = None, stage_path: str | None = None) -> DataFrame:
        """Score timelines in files."""
        return judge.score_batch(
            self.spark, paths, self._for_scoring(), self.spam_model, sink=sink, stage_path=stage_path
        )

    def score_timeline(self, timeline: str, sink: str | None = None) -> DataFrame:
        """Score a timeline given as text."""
        return judge.score_timeline(self.spark, timeline, self._for_scoring(), self.spam_model, sink=sink)

    def feature_importance(self) -> DataFrame:
        return judge.feature_importance(self._judge())

    def save(self, kind: int, path: str) -> bool:
        """Save a model, 0 = spam detector, 1 = account classifier; False for another kind."""
        if kind == SPAM_MODEL and self.spam_model is not None:
            judge.save_model(self.spam_model, path)
        elif kind == JUDGE_MODEL:
            judge.save_model(self._judge(), path)
        else:
            return False
        return True

    def load(self, kind: int, path: str, training_sink: str | None = None) -> bool:
        """Load a model; with ``training_sink`` the training set kept next to an account
        classifier is added to that table."""
        if kind == SPAM_MODEL:
            self.spam_model = judge.load_model(path)
        elif kind == JUDGE_MODEL:
            if training_sink:
                judge.append_training_set(self.spark, f"{path}_trainingset", training_sink)
            self.judge_model = judge.load_model(path)
        else:
            return False
        return True

    def _judge(self) -> PipelineModel:
        if self.judge_model is None:
            raise ValueError("train or load the account classifier first")
        return self.judge_model

    def _for_scoring(self) -> PipelineModel:
        """The account classifier, if the spam detector it was trained with is there too."""
        model = self._judge()
        if self.spam_model is None and judge.needs_spam_model(model):
            raise ValueError("the account classifier was trained with a spam detector: load that as well")
        return model
