import random
import re
from collections import Counter

from pyspark.sql import functions as F

from accountlens.operators import gaps


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, sec long, id long")


def brute_gaps(rows):
    out = []
    by_user = {}
    for user, sec, pid in rows:
        if sec is not None:
            by_user.setdefault(user, []).append((sec, pid))
    for user, posts in by_user.items():
        previous = None
        for sec, pid in sorted(posts):
            out.append((user, pid, None if previous is None else sec - previous))
            previous = sec
    return Counter(out)


def sample(seed, users=6, posts=60, span=400_000):
    """Ties within a second, several empty days, one account with a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(posts * users):
        user = 0 if rng.random() < 0.35 else rng.randrange(users)
        sec = 1_450_000_000 + rng.choice([rng.randrange(span), rng.randrange(20)])
        rows.append((user, sec, i))
    return rows


def test_post_gaps_against_brute_force(spark):
    rows = sample(1) + [(3, None, 99_999)]
    expected = brute_gaps(rows)
    out = gaps.post_gaps(frame(spark, rows))
    assert Counter((r.user_id, r.id, r.gap) for r in out.collect()) == expected


def test_post_gaps_keep_every_copy_of_a_post(spark):
    rows = sample(2, users=3, posts=20) + [(1, 1_450_000_007, 5_000)] * 40
    expected = brute_gaps(rows)
    out = gaps.post_gaps(frame(spark, rows))
    got = Counter((r.user_id, r.id, r.gap) for r in out.collect())
    assert sum(got.values()) == len(rows)
    assert got == expected


def test_post_gaps_without_post_ids(spark):
    rows = [(u, sec, None) for u, sec, _ in sample(6, users=2, posts=30)]
    expected = Counter(
        (u, None, g) for (u, _, g) in brute_gaps([(u, s, i) for i, (u, s, _) in enumerate(rows)]).elements()
    )
    out = gaps.post_gaps(frame(spark, rows))
    assert Counter((r.user_id, r.id, r.gap) for r in out.collect()) == expected


def test_order_decides_within_a_second_only(spark):
    rows = [(1, 300, 1), (1, 100, 2), (1, 650, 3), (1, 300, 0), (1, 90_000, 4)]
    for order in (("id",), ("sec", "id")):
        got = {r.id: r.gap for r in gaps.post_gaps(frame(spark, rows), order=order).collect()}
        assert got == {2: None, 0: 200, 1: 0, 3: 350, 4: 89_350}


def test_accounts_are_not_gathered(spark):
    """No window over an account or an hour: posts are numbered by ranges and meet one by one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = gaps.post_gaps(frame(spark, sample(3)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the one window is over a row per range partition, which is also all that is broadcast
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("user_id" not in line and "_rows" in line for line in windows)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all("_n#" in d or "_part" in d for d in dealt if "user_id" in d)
    assert any("user_id" in d and "_n#" in d for d in dealt)


def test_first_gaps_bounds_and_history(spark):
    rows = [(1, 100 + 7 * i, i) for i in range(5)]  # 4 gaps: kept
    rows += [(2, 100 + 7 * i, i) for i in range(4)]  # 3 gaps: dropped
    rows += [(3, 100 + i * i, i) for i in range(500)]
    rows += [(4, 100, i) for i in range(9)]  # all in one second
    rows += [(5, None, i) for i in range(50)]
    got = {r.user_id: list(r.gaps) for r in gaps.first_gaps(frame(spark, rows)).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1] == [7, 7, 7, 7]
    assert got[3] == [2 * i + 1 for i in range(110)]
    assert got[4] == [0] * 8


def test_series_skips_the_first_gap_and_ends_at_110(spark):
    df = spark.createDataFrame([(list(range(1, 200)),)], "gaps array<long>")
    assert list(df.select(gaps.gap_series()).first()[0]) == list(range(2, 111))


def test_rank_limit_runs_before_the_shuffle(spark, tmp_path):
    frame(spark, sample(4)).write.parquet(str(tmp_path / "t"))
    plan = gaps.first_gaps(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert plan.count("Exchange hashpartitioning") == 2 and "_share" in plan


def test_many_gaps_keep_the_rank(spark):
    rows = [(1, 10 * i, i) for i in range(1500)]
    got = gaps.first_gaps(frame(spark, rows).repartition(8), last_gap=1200).first()
    assert list(got.gaps) == [10] * 1200


def test_min_history_against_counts(spark):
    rows = sample(5, users=40, posts=6)
    sizes = Counter(r[0] for r in rows)
    expected = Counter((u, i) for u, _, i in rows if sizes[u] > 4)
    assert 0 < len(expected) and min(sizes.values()) <= 4
    out = gaps.with_min_history(frame(spark, rows))
    assert out.columns == ["user_id", "sec", "id"]
    assert Counter((r.user_id, r.id) for r in out.collect()) == expected


def test_min_history_keeps_every_copy(spark):
    rows = [(1, 100, 7)] * 300 + [(2, 100 + i, i) for i in range(5)] + [(3, 100, 1)] * 4
    out = gaps.with_min_history(frame(spark, rows).repartition(8))
    assert Counter(r.user_id for r in out.collect()) == {1: 300, 2: 5}


def test_undated_posts_do_not_count_as_history(spark):
    rows = [(1, 100 + i, i) for i in range(4)] + [(1, None, 9)]
    assert gaps.with_min_history(frame(spark, rows)).count() == 0
    assert gaps.first_gaps(frame(spark, rows)).count() == 0
    assert gaps.post_gaps(frame(spark, rows)).where(F.col("gap").isNotNull()).count() == 3
