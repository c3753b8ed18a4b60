"""Account features: one aggregate over posts joined with one bounded gap series."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountlens.functions import scalars
from accountlens.operators import posts as post_ops
from accountlens.operators.entropy import corrected_entropy
from accountlens.operators.evaluation import fill_zero
from accountlens.operators.gaps import first_gaps
from accountlens.operators.profiles import latest, profile_columns, snapshot
from accountlens.schema import (
    ACCOUNT,
    CLIENTS,
    FEATURE_COLUMNS,
    HOURS,
    LABEL,
    POST_FEATURES,
    UNLABELLED,
    WEEKDAYS,
)

TOTAL = "nroTweets"
RATIOS = [*WEEKDAYS, *HOURS, *CLIENTS, *POST_FEATURES]

_RATIOS_OF_SUMS = [f"{k} / {TOTAL} AS {k}" for k in RATIOS]

#: Columns of the feature frame next to account, label and post count.
_DESCRIPTIVE = ["longitud_descripcion", "cuenta_creada", "nombre_usuario"]
ACCOUNT_COLUMNS = [ACCOUNT, LABEL, TOTAL, *FEATURE_COLUMNS, *_DESCRIPTIVE, "createdAt"]


def post_measures(
    posts: DataFrame, spam_model: PipelineModel | None = None, labelled: bool = False
) -> DataFrame:
    """Everything the account features need from each post, without its text.

    Columns: user_id [, categoria], id, sec, the row measures, avg_spam (the predicted
    spam label, 0.0 without a model) and the profile snapshot. A few dozen bytes per
    post: on a JSON corpus, write this once and build the features from the copy
    (``stage_path`` in :mod:`accountlens.plans.judge`) instead of parsing posts twice.
    Posts that are such measures already stay as they are, so one copy serves training and scoring;
    it must have been made with the same spam model.
    """
    carried = [LABEL] if labelled else []
    if is_measured(posts):
        return posts.select(ACCOUNT, *carried, *(c for c in posts.columns if c not in (ACCOUNT, LABEL)))
    view = post_ops.post_view(posts, *carried, snapshot().alias("perfil"))
    if spam_model is not None:
        view = spam_model.transform(view).withColumnRenamed("predicted_label", "avg_spam")
    else:
        view = view.withColumn("avg_spam", F.lit(0.0))
    measures = {
        **post_ops.calendar_measures(),
        "fuente": scalars.client_bucket("source"),
        **post_ops.text_measures(),
        **post_ops.entity_measures(),
        **post_ops.reply_measure(),
    }
    return view.select(
        ACCOUNT, *carried, "id", "sec", *[c.alias(k) for k, c in measures.items()], "avg_spam", "perfil"
    )


def is_measured(posts: DataFrame) -> bool:
    """Whether a frame is one of :func:`post_measures`, not of posts."""
    return {ACCOUNT, "sec", "avg_spam", "perfil"} <= set(posts.columns)


def _sums() -> post_ops.Columns:
    return {
        **post_ops.weekday_counts(),
        **post_ops.hour_counts(),
        **post_ops.client_counts(),
        **post_ops.sums_of(POST_FEATURES),
    }


def post_features(posts: DataFrame, spam_model: PipelineModel | None = None) -> DataFrame:
    """The features of an account's posts alone: no profile, no history rule."""
    sums = _sums()
    grouped = (
        post_measures(posts, spam_model)
        .groupBy(ACCOUNT)
        .agg(F.count(F.lit(1)).alias(TOTAL), *[c.alias(k) for k, c in sums.items()])
    )
    return grouped.selectExpr(ACCOUNT, TOTAL, *_RATIOS_OF_SUMS)


def features_from_measures(
    measures: DataFrame, labelled: bool = False, as_of: Column | None = None
) -> DataFrame:
    """One row per account (per account and label, if labelled) with all features.

    Two exchanges on the account, both after map-side reduction: partial sums with the
    newest profile, and at most 111 timestamps per account. Their join is co-partitioned
    and drops the accounts whose history is too short.

    An account labelled twice keeps one row per label, with that label's profile and
    entropy but the posts of both: a sum over at most one row per class.
    """
    keys = (ACCOUNT, LABEL) if labelled else (ACCOUNT,)
    sums = _sums()
    grouped = measures.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(TOTAL),
        *[c.alias(k) for k, c in sums.items()],
        latest("perfil", "sec", "id").alias("perfil"),
    )
    entropy = corrected_entropy(first_gaps(measures, keys), keys)
    accounts = grouped.join(entropy, list(keys))
    if labelled:
        whole = f"OVER (PARTITION BY {ACCOUNT})"
        accounts = accounts.selectExpr(
            *keys, "perfil", "entropia", *[f"sum({c}) {whole} AS {c}" for c in (TOTAL, *RATIOS)]
        )
    else:
        accounts = accounts.withColumn(LABEL, F.lit(UNLABELLED))
    flat = accounts.selectExpr(ACCOUNT, LABEL, TOTAL, "entropia", *_RATIOS_OF_SUMS, "perfil.*")
    complete = flat.withColumns(
        {**profile_columns(), "createdAt": F.current_timestamp() if as_of is None else as_of}
    )
    return fill_zero(complete, keys).selectExpr(*ACCOUNT_COLUMNS)


def account_features(
    posts: DataFrame,
    spam_model: PipelineModel | None = None,
    labelled: bool = False,
    as_of: Column | None = None,
) -> DataFrame:
    """Features of every account with enough history, straight from posts."""
    return features_from_measures(post_measures(posts, spam_model, labelled), labelled, as_of)


def overlapping_accounts(posts: DataFrame) -> DataFrame:
    """Accounts that occur under more than one label: (user_id, labels)."""
    return (
        posts.select(F.col("user.id").alias(ACCOUNT), LABEL)
        .groupBy(ACCOUNT)
        .agg(F.sort_array(F.collect_set(LABEL)).alias("labels"))
        .where(F.size("labels") > 1)
    )
