"""The physical plans are the ones meant for large inputs."""

import re
from functools import partial
from types import SimpleNamespace

import pytest
from conftest import timeline
from pyspark.ml.functions import array_to_vector

from accountlens.catalog import queries
from accountlens.catalog.tables import events, posts
from accountlens.operators import entropy, gaps
from accountlens.operators import posts as post_ops
from accountlens.operators.evaluation import label_union
from accountlens.plans import forest
from accountlens.plans.features import account_features, features_from_measures, post_measures
from accountlens.sources.posts import ingest_posts, read_posts_table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def columnar(spark, posts_of, tmp_path):
    path = str(tmp_path / "columnar")
    ingest_posts(posts_of(timeline(1, [5, 6, 7, 8, 9]) + timeline(2, [1] * 9)), path)
    return read_posts_table(spark, path)


def test_account_features_take_three_shuffles(spark, columnar):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(account_features(columnar))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 3  # sums and profile; oldest posts by share, then by account
    assert "WindowGroupLimit" in plan and "partial_sum" in plan and "partial_max_by" in plan
    for python in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert python not in plan


def test_no_text_below_the_first_aggregate(columnar):
    """Sort and shuffle of the aggregate carry the measures themselves, never the text."""
    measures = post_measures(columnar)
    plan = plan_of(features_from_measures(measures))
    partial = next(line for line in plan.splitlines() if "partial_max_by" in line)
    assert not re.search(r"\b(text|source|entities)#", partial)
    below = plan.splitlines()[plan.splitlines().index(partial) + 1 :]
    carried = next(line for line in below if "Project [" in line)
    outputs = carried.count(" AS ") + len(re.findall(r"[\[,] ?\w+#\d+L?(?=[,\]])", carried))
    assert outputs <= len(measures.columns)


def test_scans_read_only_what_they_use(columnar):
    plan = plan_of(gaps.first_gaps(post_ops.post_view(columnar)))
    schema = re.search(r"ReadSchema: (.*)", plan).group(1)
    assert "followers_count" not in schema and "entities" not in schema
    assert "PushedFilters: [IsNotNull(text)" in plan or "IsNotNull(text)" in plan


def test_entropy_operators_reuse_the_account_shuffle(spark):
    rows = events(spark, "/root/testdata/sf0.001")
    symbols = entropy.gap_symbols(gaps.first_gaps(rows))
    out = entropy.conditional_entropy(entropy.shannon_entropy(entropy.pattern_counts(symbols)))
    assert plan_of(out).count("Exchange hashpartitioning") == 2  # both of the rank


def test_training_rows_are_dealt_once(spark, monkeypatch):
    """Folds and candidates read the dealt rows; they don't shuffle and sort them again."""
    seen = []

    def fit(self, rows):
        seen.append((plan_of(rows), rows.rdd.glom().map(lambda part: [r["id"] for r in part]).collect()))

    monkeypatch.setattr(forest.CrossValidator, "fit", fit)
    rows = spark.range(100).selectExpr("id", "double(id % 2) AS label", "array(double(id)) AS v", "'x' AS other")
    rows = rows.select("id", "label", "other", array_to_vector("v").alias("features"))
    forest.cross_validated_forest(rows, "label", "p", "features", 7, ["id"], partition_rows=30)
    [(plan, parts)] = seen
    assert "Exchange" not in plan and "Sort" not in plan
    dealt = rows.repartition(4, "id").sortWithinPartitions("id", "label")
    assert parts == dealt.rdd.glom().map(lambda part: [r["id"] for r in part]).collect()


def test_measures_are_not_measured_again(spark, columnar):
    measures = post_measures(columnar)
    assert post_measures(measures).columns == measures.columns
    labelled = post_measures(label_union({0.0: measures, 1.0: measures.limit(0)}), labelled=True)
    assert labelled.columns == post_measures(label_union({0.0: columnar}), labelled=True).columns
    assert account_features(measures).drop("createdAt").collect() == account_features(columnar).drop("createdAt").collect()


def test_training_and_scoring_share_one_pass_over_posts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "posts", lambda *a: made.append(a) or posts(*a))
    monkeypatch.setattr(queries, "_spam_training", lambda *a: SimpleNamespace(model=None))
    monkeypatch.setattr(queries, "_JUDGES", {}, raising=False)
    monkeypatch.setattr(queries.judge, "train_judge", partial(queries.judge.train_judge, num_trees=2, max_depth=2, folds=2))
    scored = queries.verdicts(spark, "/root/testdata/sf0.01")
    assert len(made) == 1
    assert scored.count() == account_features(posts(spark, "/root/testdata/sf0.01")).count()


def test_batch_run_of_the_stream_parses_its_files_once(spark, monkeypatch):
    stages, score = [], queries.judge.score_posts
    monkeypatch.setattr(queries.judge, "score_posts", lambda *a, **k: stages.append(k.get("stage_path")) or score(*a, **k))
    monkeypatch.setattr(queries, "_spam_training", lambda *a: SimpleNamespace(model=None))
    monkeypatch.setattr(queries, "_JUDGES", {})
    monkeypatch.setattr(queries.judge, "train_judge", partial(queries.judge.train_judge, num_trees=2, max_depth=2, folds=2))
    rows = queries.score_stream(spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r["agrees"] for r in rows)
    assert len(stages) == 1 and stages[0]
