"""Connected components of a graph too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.llm.common import checkpointed

#: A node's edges are spread over so many keys when its smallest neighbour is sent to them.
_SALTS = 16


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) for pairs (u, v): m is the least of u and all its v. One u may have most pairs."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS)).cast("int"))
    return salted.join(least.select("u", "m", salts), ["u", "salt"]).select("u", "v", "m")


def _only_stars(state: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u; v < u makes it the least of its component then."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(state.select("v", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return ends.where("ups > 1 or ups = 1 and least = 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of edges (a, b), the least node it is connected with.

    Large-star and small-star steps by turns, until every edge joins a node with the least of its
    component, which one aggregate tells. Each round is checkpointed. Nodes are longs; edges with a
    null end and loops say nothing.
    """
    state = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        tidy=True,
    )
    while not _only_stars(state):
        both = state.union(state.select("v", "u")).toDF("u", "v")
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        state = checkpointed(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", "m"))
            .where("u <> v")
            .distinct(),
            tidy=True,
        )
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select("v", "v").distinct()
    )
