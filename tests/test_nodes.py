"""Forests as node tables, hashed counts in long form, out-of-fold predictions: against the models."""

import random

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from accountlens.functions.hashing import hash_bucket, murmur3
from accountlens.plans import forest, nodes, spam

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    made = []
    for i in range(400):
        x = [rnd.random(), float(rnd.randrange(4)), rnd.random() ** 2, 0.0]
        made.append((i, float((x[0] > 0.6) + (x[1] > 1 and x[2] > 0.3)), Vectors.dense(x)))
    return spark.createDataFrame(made, ["id", "label", "features"])


@pytest.fixture(scope="module")
def model(rows):
    return RandomForestClassifier(labelCol="label", numTrees=7, maxDepth=5, seed=4).fit(rows)


def test_nodes_score_as_the_model(spark, rows, model):
    table = nodes.forest_nodes(spark, model)
    listed = nodes.read_nodes(table)
    assert len(listed) == model.totalNumNodes
    wide = model.transform(rows).withColumn("x", vector_to_array("features"))
    scored = nodes.score_by_nodes(wide, listed, lambda i: F.col("x")[i], "p", "by_nodes").collect()
    for r in scored:
        assert r["p"] == pytest.approx(list(r["probability"]), abs=1e-12)
        assert r["by_nodes"] == r["prediction"]


def test_nodes_survive_storage(spark, model, tmp_path):
    table = nodes.forest_nodes(spark, model)
    table.write.parquet(str(tmp_path / "nodes"))
    again = nodes.read_nodes(spark.read.parquet(str(tmp_path / "nodes")))
    assert sorted(again, key=lambda n: (n.tree, n.node)) == sorted(nodes.read_nodes(table), key=lambda n: (n.tree, n.node))


def test_importances_equal_the_model(spark, model):
    found = {r["feature"]: r["importance"] for r in nodes.node_importances(nodes.forest_nodes(spark, model), NAMES).collect()}
    expected = model.featureImportances.toArray()
    assert list(found) != [] and [found[n] for n in NAMES] == pytest.approx(list(expected), abs=1e-9)
    leaf = nodes.node_table(spark, [nodes.Node(0, 0, None, None, None, None, None, (3.0, 1.0))])
    assert {r["importance"] for r in nodes.node_importances(leaf, NAMES).collect()} == {0.0}


def test_missing_values_go_right(spark):
    tree = [
        nodes.Node(0, 0, 0, 1.5, 1, 2, 0.1, (2.0, 2.0)),
        nodes.Node(0, 1, None, None, None, None, None, (2.0, 0.0)),
        nodes.Node(0, 2, None, None, None, None, None, (0.0, 2.0)),
    ]
    df = spark.createDataFrame([(1.5,), (1.6,), (float("nan"),), (None,)], "x double")
    scored = nodes.score_by_nodes(df, tree, lambda i: F.col("x"), "p", "c").collect()
    assert [r["c"] for r in scored] == [0.0, 1.0, 1.0, 1.0]


def test_a_tie_goes_to_the_least_class(spark):
    leaf = [nodes.Node(0, 0, None, None, None, None, None, (1.0, 1.0))]
    assert nodes.score_by_nodes(spark.range(1), leaf, lambda i: F.col("id"), "p", "c").first()["c"] == 0.0


WORDS = ["", "a", "ab", "abc", "abcd", "abcde", "word", "straße", "日本語", "🙂", "x" * 50, "é", "\x00\x7f", "The"]


def test_murmur3_of_known_texts(spark):
    known = {"": 0x087FCD5C, "a": None}
    df = spark.createDataFrame([(w,) for w in [*WORDS, None]], "w string").select("w", murmur3("w").alias("h"))
    found = {r["w"]: r["h"] for r in df.collect()}
    assert found[""] == known[""] and found[None] is None
    assert all(0 <= found[w] < 1 << 32 for w in WORDS)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_long_form_equals_the_transformer(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rnd = random.Random(6)
        texts = [" ".join(rnd.choices(WORDS, k=rnd.randint(1, 40))) for _ in range(60)] + ["", "   ", "one", "one one", None]
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bucket string")
        found = {}
        for r in spam.bucket_counts(df).collect():
            found.setdefault(r["doc_id"], {})[r["bucket"]] = r["n"]
        whole = spam.hashed_counts(df.where("text is not null")).select("doc_id", "rawFeatures").collect()
        assert {r["doc_id"]: dict(zip(map(int, r["rawFeatures"].indices), r["rawFeatures"].values)) for r in whole if len(r["rawFeatures"].indices)} == found
        words = {r["word"]: r["bucket"] for r in spam.word_buckets(df).collect()}
        for word in {w for t in texts if t for w in t.lower().split(" ")}:
            if word:
                own = spam.bucket_counts(spark.createDataFrame([(1, word)], "doc_id long, text string").limit(1))
                assert [words[word]] == [r["bucket"] for r in own.collect()]
        single = spark.range(1).select(hash_bucket("cast(id as string)", 140).alias("b")).first()["b"]
        assert 0 <= single < 140
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_out_of_fold_predictions_give_the_cross_validated_accuracy(spark, rows):
    options = {"num_trees": 3, "max_depth": 3, "folds": 3, "keep_folds": True}
    cv = forest.cross_validated_forest(rows, "label", "prediction", "features", 11, ["id"], **options)
    predicted = forest.out_of_fold(cv, rows, 11, ["id"])
    assert predicted.groupBy("max_bins").count().orderBy("max_bins").collect() == [(50, 400), (100, 400)]
    found = {r["candidate"]: r["accuracy"] for r in forest.fold_accuracy(predicted, "label", "prediction").collect()}
    assert [found[i] for i in range(2)] == pytest.approx(cv.avgMetrics, abs=1e-12)
    # a row is predicted by the model of its own fold, which was fitted without it
    one = predicted.where("candidate = 1").orderBy("id").collect()
    for fold, models in enumerate(cv.subModels):
        own = {r["id"]: r["prediction"] for r in models[1].transform(rows).collect()}
        assert all(own[r["id"]] == r["prediction"] for r in one if r["fold"] == fold)
