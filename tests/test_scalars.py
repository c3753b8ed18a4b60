from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from accountlens.functions import scalars as S


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_parse_created_at(spark):
    rows = [("Tue Dec 15 00:06:30 +0000 2015",), ("not a date at all, no",), (None,)]
    got = values(spark, rows, "s string", S.epoch_seconds(S.parse_created_at("s")))
    expected = int(datetime(2015, 12, 15, 0, 6, 30, tzinfo=timezone.utc).timestamp())
    assert got == [(expected,), (None,), (None,)]


@pytest.mark.parametrize("zone", ["UTC", "America/Caracas", "Asia/Kolkata"])
def test_calendar_parts_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        sec = S.epoch_seconds(S.parse_created_at("s"))
        df = spark.createDataFrame([("Tue Dec 15 23:59:59 +0000 2015",)], "s string").select(sec.alias("t"))
        row = df.select(
            S.year_of("t"), S.month_of("t"), S.weekday_of("t"), S.weekday_name("t"), S.hour_of("t")
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == (2015, 12, 1, "Tuesday", 23)


def test_truthiness(spark):
    assert values(spark, [(True,), (False,), (None,)], "b boolean", S.truthy_bool("b")) == [(1,), (0,), (0,)]
    assert values(spark, [("x",), ("",), (None,), (" ",)], "s string", S.truthy_text("s")) == [
        (1,), (0,), (0,), (1,)
    ]
    assert values(spark, [(5,), (0,), (None,), (-1,)], "n long", S.truthy_number("n")) == [
        (1,), (0,), (0,), (1,)
    ]


def test_sizes(spark):
    rows = [([1, 2],), ([],), (None,)]
    assert values(spark, rows, "a array<int>", S.size_or_zero("a")) == [(2,), (0,), (0,)]


def test_guarded_ratios(spark):
    rows = [(30, 10), (0, 0), (5, 0), (0, 5)]
    got = values(spark, rows, "a long, b long", S.reputation("a", "b"), S.followers_ratio("a", "b"))
    assert got == [(0.75, 3.0), (0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]


def test_text(spark):
    texts = ["a  b a", "", "aab", "😀😀x", "one\ntwo"]
    got = values(
        spark, [(t,) for t in texts], "s string", S.char_diversity("s"), S.word_count("s"), S.word_diversity("s")
    )
    for text, (chars, n, diversity) in zip(texts, got):
        words = text.split(" ")
        assert chars == pytest.approx(len(set(text)) / len(text) if text else 0.0)
        assert n == len(words)
        assert diversity == pytest.approx(len(set(words)) / len(words))


def test_client_bucket(spark):
    rows = [
        ('<a href="x">Twitter Web Client</a>',),
        ("Twitter Web Client for iOS",),
        ("Twitter for Android",),
        ("twitter for android",),
        ("http://twitter.com/#!/download/ipad",),
        ("",),
    ]
    assert [r[0] for r in values(spark, rows, "s string", S.client_bucket("s"))] == [
        "uso_web", "uso_web", "uso_mobil", "uso_terceros", "uso_mobil", "uso_terceros",
    ]


def test_client_rules_are_a_parameter(spark):
    rules = {"a": ("x",), "b": ("y",)}
    got = values(spark, [("xy",), ("y",), ("z",)], "s string", S.client_bucket("s", rules, "none"))
    assert got == [("a",), ("b",), ("none",)]


def test_no_python_in_the_plan(spark):
    df = spark.range(1).select(F.lit("a b").alias("s"))
    plan = df.select(S.char_diversity("s"), S.word_diversity("s"), S.client_bucket("s"))
    assert "Python" not in plan._jdf.queryExecution().toString()
