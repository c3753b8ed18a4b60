import json
import os
from datetime import date, datetime, timedelta

import pytest
from conftest import timeline, write_lines
from pyspark.sql import functions as F

from accountlens.sources import parts, tables
from accountlens.session import delete_path, new_path, shared_dir, stored
from accountlens.sources.posts import (
    ingest_posts,
    posts_from_lines,
    posts_from_text,
    read_posts,
    read_posts_table,
    read_texts,
)
from accountlens.sources.tables import (
    drop_expired,
    read_rows,
    read_run,
    read_training_set,
    store_run,
    unexpired,
    write_training_set,
)


def test_read_file_folder_glob_and_list(spark, tmp_path):
    a = write_lines(tmp_path / "in" / "a", timeline(1, [1, 2]))
    b = write_lines(tmp_path / "in" / "b", timeline(2, [1]))
    folder = str(tmp_path / "in")
    for paths, n in ((a, 3), (folder, 5), (folder + "/*", 5), ([a, b], 5)):
        assert read_posts(spark, paths).count() == n
    assert read_texts(spark, folder).columns == ["id", "text"]


def test_absent_fields_are_null_and_extra_ones_ignored(spark, tmp_path):
    path = write_lines(tmp_path / "p", [{"id": 5, "text": "x", "geo": {"a": 1}}])
    row = read_posts(spark, path).first()
    assert row.id == 5 and row.user is None and row.entities is None and "geo" not in row


def test_lines_in_strings(spark):
    posts = timeline(1, [10, 20], text="tab\tnew\nline 😀")
    text = "\r\n".join(json.dumps(p) for p in posts) + "\n\n"
    got = posts_from_text(spark, text)
    assert [r.text for r in got.collect()] == ["tab\tnew\nline 😀"] * 3
    lines = spark.createDataFrame([(json.dumps(p),) for p in posts], "body string")
    assert posts_from_lines(lines, "body").count() == 3


def test_ingest(spark, posts_of, tmp_path):
    posts = posts_of(timeline(1, [10, 20]))
    path = str(tmp_path / "columnar")
    ingest_posts(posts, path)
    back = read_posts_table(spark, path)
    assert sorted(back.collect(), key=str) == sorted(posts.collect(), key=str)


def test_training_set_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "user_id long, x double")
    for fmt in ("json", "parquet"):
        path = str(tmp_path / fmt)
        for _ in range(2):
            write_training_set(df, path, fmt)
        assert sorted(read_training_set(spark, path, df.schema, fmt).collect()) == sorted(df.collect())


def stamped(spark, days):
    base = datetime(2024, 1, 31, 12)
    rows = [(i, base - timedelta(days=d)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "user_id long, createdAt timestamp")


def test_runs_are_added_and_repeated_ones_replaced(spark, tmp_path):
    path = str(tmp_path / "scores")
    store_run(stamped(spark, [0, 1]), path, "a")
    store_run(stamped(spark, [0]), path, "b")
    assert read_rows(spark, path).count() == 3
    assert read_run(spark, path, "b").count() == 1
    with pytest.raises(Exception):
        store_run(stamped(spark, [0]), path, "b")
    store_run(stamped(spark, [3, 4]), path, "b", overwrite=True)
    assert sorted(str(r.created_date) for r in read_rows(spark, path).where("run = 'b'").collect()) == [
        "2024-01-27", "2024-01-28"
    ]


def test_retention(spark, tmp_path):
    path = str(tmp_path / "scores")
    store_run(stamped(spark, [0, 1, 2, 5]), path, "a")
    store_run(stamped(spark, [1, 6]), path, "b")
    as_of, ttl = datetime(2024, 1, 31, 12), 2 * 86_400
    live = unexpired(read_rows(spark, path), ttl, F.lit("2024-01-31 12:00:00").cast("timestamp"))
    assert live.count() == 3  # exactly two days old is expired
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
    assert drop_expired(spark, path, ttl, as_of) == ["2024-01-25", "2024-01-26"]
    assert read_rows(spark, path).count() == 4
    assert drop_expired(spark, path, ttl, as_of) == []


def test_retention_across_session_time_zones(spark, tmp_path):
    path = str(tmp_path / "scores")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Honolulu")
        stamps = ["2024-01-30 15:00:00", "2024-01-30 13:59:00"]  # 01:00 and 23:59 in UTC
        df = spark.createDataFrame([(s,) for s in stamps], "s string").select(
            F.col("s").cast("timestamp").alias("createdAt")
        )
        store_run(df, path, "a")
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        as_of = F.timestamp_seconds(F.lit(1_706_666_400))  # 2024-01-31 02:00 UTC
        assert unexpired(read_rows(spark, path), 2 * 3600, as_of).count() == 1
        assert unexpired(read_rows(spark, path), 3 * 3600, as_of).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_unexpired_without_partitions(spark):
    df = stamped(spark, [0, 1, 2])
    assert unexpired(df, 86_401, F.lit("2024-01-31 12:00:00").cast("timestamp")).count() == 2


def test_stored_frames_live_in_the_shared_folder_and_go_away(spark):
    df = spark.range(10)
    with stored(df, "x") as copy:
        path = copy.inputFiles()[0]
        assert shared_dir(spark).removeprefix("file:") in path and copy.count() == 10
    assert not delete_path(spark, path)
    assert new_path(spark, "x") != new_path(spark, "x")


def runs_of(spark, path):
    return sorted((r.run, r.user_id) for r in read_rows(spark, path).collect())


def test_a_compacted_day_keeps_its_runs(spark, tmp_path):
    path = str(tmp_path / "scores")
    for run in "abc":
        store_run(stamped(spark, [0, 1]), path, run)
    before = runs_of(spark, path)
    assert tables.compact(spark, path, before=date(2024, 1, 31)) == ["2024-01-30"]
    names = {f: parts.parts(spark, path, f) for f in parts.folders(spark, path)}
    assert names["created_date=2024-01-31"] == ["a", "b", "c"] and len(names["created_date=2024-01-30"]) == 1
    assert runs_of(spark, path) == before and read_run(spark, path, "b").count() == 2
    # folders follow the days, however many batches come and go
    for batch in range(4):
        store_run(stamped(spark, [0, 1]), path, f"more-{batch}")
        tables.compact(spark, path)
        assert [len(parts.parts(spark, path, f)) for f in parts.folders(spark, path)] == [1, 1]
    assert read_rows(spark, path).count() == 14


def test_a_repeated_run_replaces_compacted_rows(spark, tmp_path):
    path = str(tmp_path / "scores")
    store_run(stamped(spark, [0, 1, 1]), path, "a")
    store_run(stamped(spark, [1]), path, "b")
    tables.compact(spark, path)
    store_run(stamped(spark, [2]), path, "a", overwrite=True)
    assert runs_of(spark, path) == [("a", 0), ("b", 0)]
    assert read_run(spark, path, "a").select(F.col("created_date").cast("string")).first()[0] == "2024-01-29"
    with pytest.raises(ValueError):
        store_run(stamped(spark, [2]), path, "compacted-1")


def test_a_day_predicate_lists_one_day(spark, tmp_path):
    path = str(tmp_path / "scores")
    schema = stamped(spark, [0]).schema
    for run in ("1", "2"):
        store_run(stamped(spark, [0, 1, 2]), path, run)
    day = read_rows(spark, path, schema=schema).where("created_date = date '2024-01-30'")
    assert [f for f in day.inputFiles() if "2024-01-30" in f] and day.count() == 2
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
    kinds = dict(read_rows(spark, path, schema=schema).dtypes)
    assert kinds["run"] == "string" and kinds["created_date"] == "date" and "part" not in kinds


def test_expiry_to_the_row(spark, tmp_path):
    path = str(tmp_path / "scores")
    base = datetime(2024, 1, 29, 12)
    rows = [(h, base + timedelta(hours=h)) for h in (-40, -30, -3, -1, 0, 1, 5, 30)]
    df = spark.createDataFrame(rows, "user_id long, createdAt timestamp")
    store_run(df.where("user_id % 2 = 0"), path, "a")
    store_run(df.where("user_id % 2 <> 0"), path, "b")
    as_of, ttl = datetime(2024, 1, 31, 12), 2 * 86_400
    assert tables.expire(spark, path, ttl, as_of) == ["2024-01-27", "2024-01-28", "2024-01-29"]
    assert runs_of(spark, path) == [("a", 30), ("b", 1), ("b", 5)]
    untouched = parts.parts(spark, path, "created_date=2024-01-30")
    assert untouched == ["a"] and tables.expire(spark, path, ttl, as_of) == []
    assert tables.expire(spark, path, ttl, as_of + timedelta(hours=5)) == ["2024-01-29"]
    assert parts.folders(spark, path) == ["created_date=2024-01-30"]
    assert tables.expire(spark, str(tmp_path / "absent"), ttl, as_of) == []


@pytest.mark.parametrize("done", ["staged", "ready", "moved"])
def test_an_interrupted_rewrite_loses_and_repeats_nothing(spark, tmp_path, done):
    path = str(tmp_path / "scores")
    store_run(stamped(spark, [0]), path, "a")
    store_run(stamped(spark, [0]), path, "b")
    folder = "created_date=2024-01-31"
    rows = spark.read.option("basePath", path).parquet(f"{path}/{folder}").drop("part")
    staged = parts.stage(spark, path, rows, "created_date", {folder: ["a", "b"]}, "compacted-x")
    assert read_rows(spark, path).count() == 2
    if done != "staged":
        ready = staged.replace("_staged", "_ready")
        os.rename(staged, ready)
        if done == "moved":
            os.rename(f"{ready}/{folder}/part=compacted-x", f"{path}/{folder}/part=compacted-x")
    store_run(stamped(spark, [0]), path, "c")  # the next writer takes it up
    assert runs_of(spark, path) == [("a", 0), ("b", 0), ("c", 0)]
    assert parts.parts(spark, path, folder) == (["a", "b", "c"] if done == "staged" else ["c", "compacted-x"])
