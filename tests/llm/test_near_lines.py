"""Line dedup: near copies are settled by the sets next to them, and words move once."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from accountlens.llm import lines  # noqa: E402


def _place(spark, sets):
    """Rows of all words of sets of numbers, as where they stand."""
    rows = [(at, len(words), 0, 0, pos, word) for at, words in enumerate(sets) for pos, word in enumerate(words)]
    return spark.createDataFrame(rows, "at long, n int, parity long, half long, pos int, word long")


def test_a_near_copy_meets_the_one_before_it(spark):
    # the earliest set of the words 0..8 is unlike all others; these are near copies in two groups by turns
    sets = [list(range(2, 12))] + [list(range(9)) + [100 + i % 2] for i in range(8)]
    sets[0][8:] = [50, 51]
    met = {(r["at"], r["at_1"]) for r in lines._met_near(_place(spark, sets), 0.8).collect()}
    assert {(i, i - 2) for i in range(3, 9)} <= met
    assert len(met) <= 3 * len(sets)  # not every pair


def test_both_sides_of_the_join_are_moved_once(spark, tmp_path):
    _place(spark, [[1, 2, 3, 4, 5], [1, 2, 3, 4, 6]]).write.parquet(f"{tmp_path}/place")
    place = spark.read.parquet(f"{tmp_path}/place")
    with_join = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = lines._met_all(place, 0.6)
        assert {(r["at"], r["at_1"]) for r in met.collect()} == {(1, 0)}
        assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_join)


def test_removed_sets_meet_no_earlier_ones_but_later_ones_meet_them(spark):
    place = _place(spark, [[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 3, 4, 7]])
    place = place.withColumn("pos", F.when(F.col("at") == 1, -1 - F.col("pos")).otherwise(F.col("pos")))
    met = {(r["at"], r["at_1"]) for r in lines._met_all(place, 0.6).collect()}
    assert met == {(2, 0), (2, 1)}


def test_array_of_longs_as_one_constant(spark):
    import numpy as np

    values = np.array([0, -5, 1 << 62], np.int64)
    assert spark.range(1).select(lines._constant(values).alias("a")).first().a == values.tolist()


def test_words_of_a_line_are_made_once(spark, monkeypatch):
    plans = []
    scratch = lines.Scratch.__call__

    def kept(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return scratch(self, df)

    monkeypatch.setattr(lines.Scratch, "__call__", kept)
    docs = spark.createDataFrame([(1, "a b c\n \t\n"), (2, "a b c\x0b"), (3, "\n\r"), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed, r.removed) for r in lines.line_report(docs).collect()]
    assert sorted(got) == [(1, 0, []), (2, 1, [0]), (3, 0, []), (4, 0, [])]
    assert plans[0].count("array_distinct(") == 1
