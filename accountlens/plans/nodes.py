"""Forests as tables of their nodes: stored, applied and summed up without the model.

A node is (tree, node, feature, threshold, left, right, gain, counts): ``counts`` the (weighted)
training rows of each class that reached it. A leaf has no feature. A row goes left where its feature is
at most the threshold. A forest's size is that of its parameters (trees, depth), not of any data, so its
nodes can be read to the driver, where they are compiled into one column expression: scoring with it is a
projection that any plan can hold, streaming ones too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.session import delete_path, new_path

NODES = (
    "tree int, node int, feature int, threshold double, left int, right int, gain double, counts array<double>"
)


@dataclass(frozen=True)
class Node:
    tree: int
    node: int
    feature: int | None
    threshold: float | None
    left: int | None
    right: int | None
    gain: float | None
    counts: tuple[float, ...]


def forest_nodes(spark: SparkSession, model: PipelineModel | RandomForestClassificationModel) -> DataFrame:
    """The nodes of a trained forest (the last stage of a pipeline). Splits must be on numbers."""
    forest = model.stages[-1] if isinstance(model, PipelineModel) else model
    path = new_path(spark, "forest")
    try:
        forest.save(path)
        data = F.col("nodeData")
        inner, split = data["leftChild"] >= 0, data["split"]
        rows = spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), data["id"].alias("node"), split["numCategories"].alias("kinds"),
            *(
                F.when(inner, value).alias(name)
                for name, value in (
                    ("feature", split["featureIndex"]), ("threshold", split["leftCategoriesOrThreshold"][0]),
                    ("left", data["leftChild"]), ("right", data["rightChild"]), ("gain", data["gain"]),
                )
            ),
            data["impurityStats"].alias("counts"),
        ).collect()
    finally:
        delete_path(spark, path)
    if any(r["feature"] is not None and r["kinds"] >= 0 for r in rows):
        raise ValueError("the forest splits on categories")
    return node_table(spark, [Node(*(r[c.split()[0]] for c in NODES.split(", "))) for r in rows])


def node_table(spark: SparkSession, nodes: Sequence[Node]) -> DataFrame:
    return spark.createDataFrame(
        [(n.tree, n.node, n.feature, n.threshold, n.left, n.right, n.gain, list(n.counts)) for n in nodes], NODES
    )


def read_nodes(table: DataFrame) -> list[Node]:
    return [Node(**{**r.asDict(), "counts": tuple(r["counts"])}) for r in table.collect()]


def forest_probabilities(nodes: Sequence[Node], feature: Callable[[int], Column]) -> Column:
    """Class probabilities by a forest, as an array of doubles: the mean of its trees' leaves.

    ``feature`` gives the column of a feature's number. A missing value goes right, as every
    comparison with it fails.
    """
    by_tree: dict[int, dict[int, Node]] = {}
    for n in nodes:
        by_tree.setdefault(n.tree, {})[n.node] = n

    def shares(n: Node) -> Column:
        total = sum(n.counts)
        return F.array(*[F.lit(c / total if total else 0.0) for c in n.counts])

    def below(tree: dict[int, Node], number: int) -> Column:
        n = tree[number]
        if n.feature is None:
            return shares(n)
        goes_left = feature(n.feature) <= F.lit(n.threshold)
        return F.when(goes_left, below(tree, n.left)).otherwise(below(tree, n.right))

    trees = F.array(*[below(tree, 0) for _, tree in sorted(by_tree.items())])
    classes = len(nodes[0].counts)
    sums = lambda votes: F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda c: F.aggregate(votes, F.lit(0.0), lambda acc, leaf: acc + leaf[c]) / F.lit(float(len(by_tree))),
    )
    # the votes are worked out once, as a variable, not once for each class
    return F.transform(F.array(trees), sums)[0]


def predicted_class(probabilities: Column) -> Column:
    """The most probable class as a double (ties: the least), as the model predicts."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("double")


def score_by_nodes(
    rows: DataFrame, nodes: Sequence[Node], feature: Callable[[int], Column],
    probability: str = "probabilidades", prediction: str | None = None,
) -> DataFrame:
    """``rows`` with the forest's probabilities, and its prediction if a column is named for it."""
    scored = rows.withColumn(probability, forest_probabilities(nodes, feature))
    return scored.withColumn(prediction, predicted_class(F.col(probability))) if prediction else scored


def node_importances(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, importance) of each feature, an aggregate over a node table.

    In a tree a feature weighs the gain times the training rows of the nodes that split on it; trees
    are normalised, added up and normalised again. A forest without splits has only zeros.
    """
    rows = F.aggregate("counts", F.lit(0.0), lambda acc, c: acc + c)
    gains = table.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * rows).alias("_gain"))
    trees = gains.groupBy("tree").agg(F.sum("_gain").alias("_tree"))
    shares = gains.join(trees, "tree").where("_tree > 0").groupBy("feature").agg(F.sum(F.col("_gain") / F.col("_tree")).alias("_share"))
    # each tree with a split adds 1 in all
    n_trees = trees.where("_tree > 0").agg(F.count(F.lit(1))).first()[0]
    listed = table.sparkSession.createDataFrame(list(enumerate(names)), "number int, name string")
    found = listed.join(shares, listed["number"] == shares["feature"], "left")
    value = F.coalesce(F.col("_share"), F.lit(0.0)) / F.lit(float(max(n_trees, 1)))
    return found.select(F.col("name").alias("feature"), value.alias("importance"))
