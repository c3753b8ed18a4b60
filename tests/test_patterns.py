"""Long-form patterns and entropies against brute force, on series of any length."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from accountlens.operators import entropy, gaps, patterns
from accountlens.operators.ordered import numbered
from test_entropy import blocks, brute_cce, symbols_of


def long_form(spark, cases, value="symbol"):
    rows = [(key, i, int(v)) for key, series in cases.items() for i, v in enumerate(series, 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, f"user_id string, pos long, {value} long").repartition(5)


@pytest.fixture(scope="module")
def cases():
    rnd = random.Random(5)
    return {
        "one": [3],
        "two": [1, 1],
        "same": [4] * 9,
        "alternating": [0, 1] * 15,
        "three": [rnd.randrange(3) for _ in range(60)],
        "sparse": [rnd.randrange(40) for _ in range(70)],
        "twice": list(range(20)) * 2 + [99],
    }


def test_every_pattern_is_counted(spark, cases):
    found = defaultdict(dict)
    for r in patterns.pattern_counts(long_form(spark, cases)).collect():
        assert r["l"] not in found[r["user_id"]] or r["pos"] not in found[r["user_id"]][r["l"]]
        found[r["user_id"]].setdefault(r["l"], {})[r["pos"]] = r["occurrences"]
    for key, q in cases.items():
        for length in range(1, len(q) + 1):
            windows = [tuple(q[i : i + length]) for i in range(len(q) - length + 1)]
            counts = Counter(windows)
            assert found[key][length] == {windows.index(w) + 1: c for w, c in counts.items()}
        assert set(found[key]) == set(range(1, len(q) + 1))


def test_entropies_of_all_lengths(spark, cases):
    symbols = long_form(spark, cases)
    h = {(r["user_id"], r["l"]): r for r in patterns.shannon_entropy(symbols).collect()}
    ce = {(r["user_id"], r["l"]): r for r in patterns.conditional_entropy(patterns.shannon_entropy(symbols)).collect()}
    for key, q in cases.items():
        for length in range(1, len(q) + 1):
            expected, singles, total = blocks(q, length)
            row = h[key, length]
            assert row["h"] == pytest.approx(expected, abs=1e-12) and (row["singles"], row["total"]) == (singles, total)
            if length > 1:
                assert ce[key, length]["ce"] == pytest.approx(expected - blocks(q, length - 1)[0], abs=1e-12)
    assert len(h) == sum(map(len, cases.values())) and len(ce) == len(h) - len(cases)


def test_whole_series_equal_the_full_search(spark):
    rnd = random.Random(9)
    series = {
        "short": [5, 7],
        "least": [1, 2, 3],
        "constant": [60] * 50,
        "alternating": [10 if j % 2 else 90 for j in range(120)],
        "random": [int(rnd.expovariate(1 / 5000)) for _ in range(400)],
        "squares": [j * j for j in range(400)],
        "spike": [0] * 100 + [10**9],
    }
    rows = long_form(spark, series, "gap")
    found = {r["user_id"]: r["entropia"] for r in entropy.series_entropy(rows).collect()}
    for key, g in series.items():
        assert found[key] == (None if len(g) < 3 else pytest.approx(brute_cce(g), abs=1e-9)), key


def test_five_thousand_gaps(spark):
    rnd = random.Random(2)
    g = [int(rnd.expovariate(1 / 5000)) for _ in range(5000)]
    found = entropy.series_entropy(long_form(spark, {"a": g}, "gap")).first()["entropia"]
    q = symbols_of(g)
    h = {length: blocks(q, length) for length in range(1, 41)}
    assert h[40][1] == h[40][2]  # unique: longer patterns only lower the term towards the tail
    terms = [h[k][0] - h[k - 1][0] + h[k][1] / h[k][2] * h[1][0] for k in range(2, 41)]
    import math

    assert found == pytest.approx(min(*terms, h[1][0] - math.log(2)), abs=1e-9)


def test_fixed_bins_and_no_rows(spark):
    rows = long_form(spark, {"a": [0, 5, 10, 10, 2]}, "gap")
    assert [r["symbol"] for r in patterns.quantised(rows, bins=2).orderBy("pos").collect()] == [0, 0, 1, 1, 0]
    none = rows.where("pos < 0")
    assert entropy.series_entropy(none).collect() == []
    assert patterns.pattern_counts(patterns.quantised(none)).collect() == []


def test_gap_rows_follow_the_whole_timeline(spark):
    rnd = random.Random(3)
    times = {1: [rnd.randrange(10**6) for _ in range(700)], 2: [5, 5, 5, 9], 3: [1, 2, 3, 4, 9], 4: [7]}
    rows = [(k, t, i) for k, ts in times.items() for i, t in enumerate(ts)] + [(None, 3, 0), (1, None, 9)]
    posts = spark.createDataFrame(rows, "user_id long, sec long, id long").repartition(6)
    found = defaultdict(dict)
    for r in gaps.gap_rows(posts).collect():
        found[r["user_id"]][r["pos"]] = r["gap"]
    for k in (1, 3):
        s = sorted(times[k])
        expected = [b - a for a, b in zip(s, s[1:])][1:]
        assert [found[k][i] for i in range(1, len(expected) + 1)] == expected and len(found[k]) == len(expected)
    assert set(found) == {1, 3}


def test_post_gaps_of_a_hot_hour(spark):
    posts = spark.range(3000).select(
        (F.col("id") % 7 > 5).cast("long").alias("user_id"), (F.col("id") / 2).cast("long").alias("sec"), "id"
    )
    rows = [(r["user_id"], r["sec"], r["id"]) for r in posts.collect()]
    expected = {}
    for user in (0, 1):
        mine = sorted((s, i) for u, s, i in rows if u == user)
        expected |= {i: None if not n else s - mine[n - 1][0] for n, (s, i) in enumerate(mine)}
    assert {r["id"]: r["gap"] for r in gaps.post_gaps(posts.repartition(8)).collect()} == expected


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 7 % 50, str(i % 3)) for i in range(50)], "a long, b string").repartition(9)
    found = numbered(rows, ["b", "a"]).orderBy("_n").collect()
    assert [r["_n"] for r in found] == list(range(50))
    assert [(r["b"], r["a"]) for r in found] == sorted((r["b"], r["a"]) for r in found)
    assert numbered(rows.where("a < 0"), ["a"]).count() == 0
