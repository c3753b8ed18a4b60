"""Account classification (human, bot, cyborg) from posting timelines, on Spark."""

from accountlens.classifier import AccountClassifier
from accountlens.plans.features import account_features, overlapping_accounts, post_features
from accountlens.plans.judge import (
    feature_importance,
    load_model,
    save_model,
    score_batch,
    score_posts,
    score_timeline,
    train_judge,
    verdicts,
)
from accountlens.plans.spam import train_spam
from accountlens.session import build_session
from accountlens.streaming.scoring import latest_scores, score_stream

__all__ = [
    "AccountClassifier",
    "account_features",
    "build_session",
    "feature_importance",
    "latest_scores",
    "load_model",
    "overlapping_accounts",
    "post_features",
    "save_model",
    "score_batch",
    "score_posts",
    "score_stream",
    "score_timeline",
    "train_judge",
    "train_spam",
    "verdicts",
]
