import json
import random
from datetime import timedelta

import pytest
from conftest import START, timeline, write_lines
from pyspark.sql import functions as F

from accountlens import (
    AccountClassifier,
    account_features,
    feature_importance,
    load_model,
    save_model,
    score_batch,
    score_posts,
    score_stream,
    score_timeline,
    verdicts,
)
from accountlens.operators import evaluation
from accountlens.plans import spam
from accountlens.plans.judge import evaluate_judge, needs_spam_model
from accountlens.schema import FEATURE_COLUMNS, PREDICTION_COLUMNS
from accountlens.sources import parts
from accountlens.sources.posts import read_posts
from accountlens.sources.tables import read_rows
from accountlens.streaming import history
from accountlens.streaming.scoring import latest_scores

SMALL = {"num_trees": 3, "max_depth": 2, "folds": 2}
N = 40
GOOD, BAD = "morning coffee friends walk book walk", "buy cheap now win money now"


def spam_texts(n=60):
    rng = random.Random(5)
    bad, good = ["buy", "cheap", "now", "win", "money"], ["morning", "coffee", "friends", "walk", "book"]

    def pick(words):
        return " ".join(rng.choice(words) for _ in range(6))

    make = lambda words, base: [{"id": base + i, "text": pick(words), "lang": "en"} for i in range(n)]
    return make(bad, 0), make(good, 1000)


def class_posts(kind, base):
    """Humans irregular by day, bots hourly around the clock, cyborgs a mix."""
    rng = random.Random(base)
    posts = []
    for i in range(N):
        account = base + i
        if kind == "human":
            gaps = [rng.randrange(600, 40_000) for _ in range(25)]
            posts += timeline(account, gaps, GOOD, "Twitter for Android", followers_count=50)
        elif kind == "bot":
            posts += timeline(account, [3600] * 30, BAD, "autoposter", followers_count=1, friends_count=900)
        else:
            gaps = [1800 if rng.random() < 0.6 else rng.randrange(10_000) for _ in range(30)]
            posts += timeline(account, gaps, [BAD, GOOD], "Twitter Web Client", verified=True)
    return posts


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    bad, good = spam_texts()
    paths = {"spam": write_lines(root / "spam", bad), "no_spam": write_lines(root / "no_spam", good)}
    for kind, base in (("human", 1000), ("bot", 2000), ("cyborg", 3000)):
        paths[kind] = write_lines(root / kind / "all", class_posts(kind, base))
    paths["root"] = str(root)
    return paths


@pytest.fixture(scope="module")
def trained(spark, data):
    classifier = AccountClassifier(spark)
    spam_accuracy = classifier.train_spam(data["spam"], data["no_spam"], **SMALL)
    model_path = data["root"] + "/judge"
    accuracy, matrix = classifier.train_judge(
        data["human"], data["cyborg"], data["bot"], model_path=model_path, **SMALL
    )
    return classifier, spam_accuracy, accuracy, matrix, model_path


def test_training_separates_the_classes(trained):
    _, spam_accuracy, accuracy, matrix, _ = trained
    assert spam_accuracy > 0.9
    assert accuracy > 0.9
    assert len(matrix) == 3 and all(len(r) == 3 for r in matrix)
    total = sum(map(sum, matrix))
    assert 0 < total < 3 * N and matrix[0][0] + matrix[1][1] + matrix[2][2] == pytest.approx(accuracy * total)


def test_scored_rows(spark, data, trained):
    classifier = trained[0]
    scored = classifier.score(data["bot"])
    assert scored.columns == PREDICTION_COLUMNS
    rows = scored.collect()
    assert len(rows) == N
    for r in rows:
        assert sum(r.probabilidades) == pytest.approx(1.0) and len(r.probabilidades) == 3
        assert r.probabilidades.index(max(r.probabilidades)) == int(r.Predicted_categoria)
        assert 0.0 <= r.avg_spam <= 1.0
    assert sum(r.Predicted_categoria == 1.0 for r in rows) > 0.9 * N
    assert verdicts(scored).columns == ["user_id", "probabilidades"]


def test_spam_share_of_accounts(spark, data, trained):
    model = trained[0].spam_model
    rates = {
        kind: account_features(read_posts(spark, data[kind]), model).agg(F.avg("avg_spam")).first()[0]
        for kind in ("bot", "human")
    }
    assert rates["bot"] > 0.9 and rates["human"] < 0.1


def test_training_set_is_kept_next_to_the_model(spark, trained):
    _, _, _, matrix, path = trained
    kept = spark.read.json(path + "_trainingset")
    assert kept.count() + sum(map(sum, matrix)) == 3 * N
    assert set(FEATURE_COLUMNS) <= set(kept.columns)


def test_save_and_load(spark, data, trained, tmp_path):
    classifier, *_, path = trained
    spam_path = str(tmp_path / "spam")
    assert classifier.save(0, spam_path) and not classifier.save(7, spam_path)
    other = AccountClassifier(spark)
    assert other.load(0, spam_path) and other.load(1, path) and not other.load(9, path)
    key = lambda r: r.user_id
    ours = sorted(verdicts(classifier.score(data["cyborg"])).collect(), key=key)
    assert sorted(verdicts(other.score(data["cyborg"])).collect(), key=key) == ours
    with pytest.raises(Exception):
        save_model(classifier.spam_model, spam_path)
    save_model(classifier.spam_model, spam_path, overwrite=True)
    assert load_model(spam_path).stages[-1].getNumTrees == SMALL["num_trees"]
    with pytest.raises(ValueError):
        AccountClassifier(spark).score(data["bot"])


def test_loading_can_append_the_training_set(spark, trained, tmp_path):
    *_, matrix, path = trained
    sink = str(tmp_path / "training-rows")
    for _ in range(2):
        assert AccountClassifier(spark).load(1, path, training_sink=sink)
    rows = read_rows(spark, sink)
    assert rows.count() == 2 * (3 * N - sum(map(sum, matrix)))
    assert rows.dropna(subset=FEATURE_COLUMNS).count() == rows.count()


def test_texts_without_an_id_are_split_too(spark):
    bad, good = spam_texts(200)
    frame = lambda rows: spark.createDataFrame([(None, r["text"]) for r in rows], "id long, text string")
    result = spam.train_spam(frame(bad), frame(good), **SMALL)
    assert result.accuracy > 0.9 and len(result.cv_accuracy) == 2


def test_training_is_repeatable(spark):
    bad, good = (spark.createDataFrame(x, "id long, text string, lang string") for x in spam_texts())
    found = []
    for parts in (1, 4, 7):
        t = spam.train_spam(bad.repartition(parts), good.repartition(parts + 1), **SMALL)
        found.append((t.cv_accuracy, t.model.stages[-1].toDebugString.split("\n", 1)[1]))
    assert found[0] == found[1] == found[2]


def test_feature_importance(trained):
    rows = feature_importance(trained[0].judge_model).collect()
    assert [r.feature for r in rows] == FEATURE_COLUMNS
    assert sum(r.importance for r in rows) == pytest.approx(1.0)


def test_sink_stage_and_single_timeline_agree(spark, data, trained, tmp_path):
    classifier = trained[0]
    sink = str(tmp_path / "sink")
    plain = {r.user_id: r.probabilidades for r in classifier.score(data["human"]).collect()}
    stored = score_batch(
        spark, data["human"], classifier.judge_model, classifier.spam_model, sink, str(tmp_path / "stage")
    )
    assert stored.columns == PREDICTION_COLUMNS
    assert {r.user_id: r.probabilidades for r in stored.collect()} == plain
    one = next(iter(plain))
    lines = [json.dumps(p) for p in class_posts("human", 1000) if p["user"]["id"] == one]
    single = score_timeline(spark, "\n".join(lines), classifier.judge_model, classifier.spam_model, sink)
    assert [(r.user_id, r.probabilidades) for r in single.collect()] == [(one, plain[one])]
    assert read_rows(spark, sink).count() == N + 1


def test_stream_equals_batch(spark, data, trained, tmp_path):
    classifier = trained[0]
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    posts = class_posts("cyborg", 3000)
    for part in range(3):
        write_lines(
            f"{source}/part{part}", [p for p in posts if p["user"]["id"] % 3 == part]
        )
    run = lambda: score_stream(
        spark, source, sink, checkpoint, classifier.judge_model, classifier.spam_model, max_files_per_trigger=1
    ).awaitTermination()
    run()
    expected = {r.user_id: r.probabilidades for r in classifier.score(data["cyborg"]).collect()}
    got = read_rows(spark, sink)
    assert {r.user_id: r.probabilidades for r in got.collect()} == expected
    assert got.select("run").distinct().count() == 3
    run()  # nothing new: nothing repeated
    assert read_rows(spark, sink).count() == N
    write_lines(f"{source}/late", timeline(77, [9, 99, 999, 9, 99], first=START + timedelta(days=1)))
    run()
    assert read_rows(spark, sink).count() == N + 1
    checkpoint = str(tmp_path / "other")  # a second stream, into the same sink
    run()
    assert read_rows(spark, sink).count() == 2 * (N + 1)


def test_scoring_without_a_spam_model(spark, data, trained):
    scored = score_posts(read_posts(spark, data["bot"]), trained[0].judge_model)
    assert scored.agg(F.max("avg_spam")).first()[0] == 0.0


def test_evaluation_frames(spark, trained, data):
    features = account_features(read_posts(spark, data["bot"]), trained[0].spam_model).withColumn(
        "categoria", F.lit(1.0)
    )
    accuracy, matrix = evaluate_judge(trained[0].judge_model, features)
    cells = {r.categoria: (r.pred_0, r.pred_1, r.pred_2) for r in matrix.collect()}
    assert cells[0.0] == cells[2.0] == (0, 0, 0)
    assert cells[1.0][1] / N == pytest.approx(accuracy.first()[0])


def test_hashed_counts(spark):
    df = spark.createDataFrame([("The the  cat\tTHE", 1)], "text string, id long")
    row = spam.hashed_counts(df).first()
    assert row.words == ["the", "the", "", "cat", "the"]
    assert row.rawFeatures.size == 140 and sum(row.rawFeatures.values) == 5
    assert max(row.rawFeatures.values) >= 3


def test_confusion_matrix_and_accuracy(spark):
    rows = [(0.0, 0.0), (0.0, 1.0), (2.0, 2.0), (2.0, 2.0)]
    df = spark.createDataFrame(rows, "y double, p double")
    matrix = evaluation.confusion_matrix(df, "y", "p").collect()
    assert [tuple(r) for r in matrix] == [(0.0, 1, 1, 0), (1.0, 0, 0, 0), (2.0, 0, 0, 2)]
    assert evaluation.accuracy(df, "y", "p").first()[0] == 0.75
    assert evaluation.accuracy(df.limit(0), "y", "p").first()[0] is None


def test_split_is_stable_and_disjoint(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    test, train = evaluation.split_train_test(df, ["k"])
    a = {r.k for r in test.collect()}
    b = {r.k for r in evaluation.split_train_test(df.repartition(5), ["k"])[0].collect()}
    assert a == b and not a & {r.k for r in train.collect()}
    assert len(a) + train.count() == 5000 and 0.17 < len(a) / 5000 < 0.23
    other = evaluation.split_train_test(df, ["k"], seed=1)[0]
    assert {r.k for r in other.collect()} != a


def test_label_union_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n long, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n long")
    rows = evaluation.label_union({1.0: a, 0.0: b}, "label").collect()
    assert sorted((r.n, r.s, r.label) for r in rows) == [(1, "x", 1.0), (2, "y", 0.0)]


def test_stream_scores_whole_timelines(spark, data, trained, tmp_path):
    """Every account's posts are dealt over all files; batches of one file, a merge on the way."""
    classifier = trained[0]
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    posts = class_posts("cyborg", 3000)
    run = lambda: score_stream(
        spark, source, sink, checkpoint, classifier.judge_model, classifier.spam_model, max_files_per_trigger=1, buckets=4
    ).awaitTermination()
    for part in range(3):
        write_lines(f"{source}/part{part}", posts[part::3])
    run()
    expected = {r.user_id: r.probabilidades for r in classifier.score(data["cyborg"]).collect()}
    last = lambda: {r.user_id: r.probabilidades for r in latest_scores(spark, sink).collect()}
    assert last() == expected
    seen = f"{checkpoint}/posts"
    before = [len(parts.parts(spark, seen, f)) for f in parts.folders(spark, seen)]
    assert max(before) == 3 and history.compact(spark, seen, 3, most_parts=1)
    assert [len(parts.parts(spark, seen, f)) for f in parts.folders(spark, seen)] == [1] * len(before)
    # one more post of one account: that account alone is scored again, from all its posts
    some = posts[0]["user"]["id"]
    own = [p for p in posts if p["user"]["id"] == some]
    extra = dict(own[0], id=own[0]["id"] + 50_000)
    write_lines(f"{source}/late", [extra])
    run()
    write_lines(f"{tmp_path}/whole/all", [*own, extra])
    again = {r.user_id: r.probabilidades for r in classifier.score(f"{tmp_path}/whole").collect()}
    assert last() == {**expected, **again}
    newest = read_rows(spark, sink).where(F.col("run").endswith("-3"))
    assert [r.user_id for r in newest.collect()] == [some]


def test_a_repeated_batch_replaces_its_posts(spark, tmp_path):
    path = str(tmp_path / "seen")
    rows = lambda ids: spark.createDataFrame([(a, i) for a, i in ids], "user_id long, id long")
    history.add(rows([(1, 1), (2, 2)]), path, 0, buckets=2)
    history.add(rows([(1, 3), (9, 4)]), path, 1, buckets=2)
    history.add(rows([(1, 5)]), path, 1, buckets=2)
    found = history.timelines_of_batch(spark, path, 1, rows([]).schema)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (1, 5)]
    first = history.timelines_of_batch(spark, path, 0, rows([]).schema)
    assert sorted(tuple(r) for r in first.collect()) == [(1, 1), (2, 2)]
    assert history.timelines_of_batch(spark, path, 7, rows([]).schema).count() == 0


def test_retraining_replaces_nothing_unless_it_may(spark, data, trained):
    *_, path = trained
    classifier = AccountClassifier(spark)
    classifier.spam_model = trained[0].spam_model
    kept = sorted(r.user_id for r in spark.read.json(path + "_trainingset").select("user_id").collect())
    fewer = f"{data['root']}/fewer"
    write_lines(f"{fewer}/all", class_posts("human", 1000)[: 20 * 26])
    with pytest.raises(ValueError, match="there already"):
        classifier.train_judge(fewer, data["cyborg"], data["bot"], model_path=path, **SMALL)
    assert sorted(r.user_id for r in spark.read.json(path + "_trainingset").select("user_id").collect()) == kept
    own = path + "-again"
    for overwrite in (False, True):
        classifier.train_judge(data["human"], data["cyborg"], data["human"], model_path=own, overwrite=overwrite, **SMALL)
    assert AccountClassifier(spark).load(1, own)
    # the same accounts as humans and bots
    assert classifier.overlap == {(0.0, 1.0): N}
    assert trained[0].overlap == {}


def test_a_judge_that_knows_spam_needs_the_detector(spark, data, trained):
    classifier, *_, path = trained
    alone = AccountClassifier(spark)
    assert alone.load(1, path)
    if needs_spam_model(classifier.judge_model):
        with pytest.raises(ValueError, match="spam detector"):
            alone.score(data["bot"])
    alone.spam_model = classifier.spam_model
    assert alone.score(data["bot"]).count() == N


def test_only_a_split_on_spam_needs_the_detector():
    class Forest:
        def __init__(self, weight):
            self.featureImportances = [0.0] * len(FEATURE_COLUMNS)
            self.featureImportances[FEATURE_COLUMNS.index("avg_spam")] = weight

    class Model:
        def __init__(self, weight):
            self.stages = [Forest(weight)]

    assert needs_spam_model(Model(0.1)) and not needs_spam_model(Model(0.0))
