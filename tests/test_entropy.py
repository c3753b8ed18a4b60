import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from accountlens.functions import series as S
from accountlens.operators import entropy


def symbols_of(g):
    n, low, span = len(g), min(g), max(g) - min(g)
    return [max(math.ceil((v - low) * n / span) - 1, 0) for v in g] if span else [0] * n


def blocks(q, length):
    total = len(q) - length + 1
    counts = Counter(tuple(q[i : i + length]) for i in range(total))
    h = -sum(c / total * math.log(c / total) for c in counts.values())
    return h, sum(c == 1 for c in counts.values()), total


def brute_cce(g):
    if min(g) == max(g):
        return 0.0
    q = symbols_of(g)
    h = {length: blocks(q, length) for length in range(1, len(q) + 1)}
    return min(h[k][0] - h[k - 1][0] + h[k][1] / h[k][2] * h[1][0] for k in range(2, len(q) + 1))


def cce(spark, all_series):
    rows = list(enumerate(all_series))
    df = spark.createDataFrame(rows, "i long, g array<bigint>").select("i", S.gap_entropy("g").alias("e"))
    return [r.e for r in sorted(df.collect(), key=lambda r: r.i)]


def special_series():
    rng = random.Random(7)
    yield from ([7] * 3, [7] * 109, [0, 0, 1], [1, 2, 3], [5, 5, 9, 5])
    for n in (8, 50, 109, 127, 128, 150, 400):
        yield [j % 2 for j in range(n)]
        yield [100 if j % 3 else 7 for j in range(n)]
        yield [j * j for j in range(n)]
        yield [rng.randrange(3) for _ in range(n)]
        yield [int(rng.expovariate(1 / 5000)) for _ in range(n)]
        yield [0] * (n - 1) + [1_000_000_000]


def test_entropy_equals_the_full_search(spark):
    cases = list(special_series())
    for got, g in zip(cce(spark, cases), cases):
        assert got == pytest.approx(brute_cce(g), abs=1e-12)


def test_constant_series_and_too_short_ones(spark):
    assert cce(spark, [[4, 4, 4], [1, 2], [], [1]]) == [0.0, None, None, None]


def test_alternating_series_has_its_minimum_below_the_last_length(spark):
    g = [10 if j % 2 else 90 for j in range(60)]
    tail = blocks(symbols_of(g), 1)[0] - math.log(2)
    assert cce(spark, [g])[0] < tail - 1e-6 or brute_cce(g) == pytest.approx(tail)
    assert cce(spark, [g])[0] == pytest.approx(brute_cce(g), abs=1e-12)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2_000_000), min_size=3, max_size=60), min_size=20, max_size=40))
def test_entropy_property(spark, cases):
    for got, g in zip(cce(spark, cases), cases):
        assert got == pytest.approx(brute_cce(g), abs=1e-12)


def test_symbols_are_exact(spark):
    rng = random.Random(3)
    cases = [[rng.randrange(10**rng.randrange(1, 9)) for _ in range(rng.randrange(3, 110))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(cases)), "i long, g array<bigint>")
    for r in df.select("g", S.symbolize("g").alias("q")).collect():
        g = list(r.g)
        low, span, n = min(g), max(g) - min(g), len(g)
        exact = [max(-(-(v - low) * n // span) - 1, 0) if span else 0 for v in g]
        assert list(r.q) == exact and max(r.q) < n


def test_set_based_operators_agree_with_brute_force(spark):
    rng = random.Random(11)
    cases = {i: [rng.randrange(50) ** 2 for _ in range(rng.choice([5, 30, 110, 150]))] for i in range(12)}
    gaps = spark.createDataFrame(list(cases.items()), "user_id long, gaps array<bigint>")
    counts = entropy.pattern_counts(entropy.gap_symbols(gaps), (1, 2, 3, 4))
    shannon = {(r.user_id, r.l): (r.h, r.singles, r.total) for r in entropy.shannon_entropy(counts).collect()}
    conditional = {
        (r.user_id, r.l): r.ce for r in entropy.conditional_entropy(entropy.shannon_entropy(counts)).collect()
    }
    final = {r.user_id: r.entropia for r in entropy.corrected_entropy(gaps).collect()}
    for user, all_gaps in cases.items():
        q = symbols_of(all_gaps)
        for length in (1, 2, 3, 4):
            h, singles, total = blocks(q, length)
            assert shannon[user, length][0] == pytest.approx(h, abs=1e-12)
            assert shannon[user, length][1:] == (singles, total)
            if length > 1:
                assert conditional[user, length] == pytest.approx(h - blocks(q, length - 1)[0], abs=1e-12)
        assert final[user] == pytest.approx(brute_cce(all_gaps[1:110]), abs=1e-12)


def test_lengths_beyond_the_series_are_skipped(spark):
    gaps = spark.createDataFrame([(1, [3, 1, 4, 1])], "user_id long, gaps array<bigint>")
    counts = entropy.pattern_counts(entropy.gap_symbols(gaps), (2, 50))
    assert {r.l for r in counts.collect()} == {2}


def test_conditional_entropy_needs_consecutive_lengths(spark):
    gaps = spark.createDataFrame([(1, [3, 1, 4, 1, 5, 9, 2, 6])], "user_id long, gaps array<bigint>")
    counts = entropy.pattern_counts(entropy.gap_symbols(gaps), (1, 3, 4))
    assert {r.l for r in entropy.conditional_entropy(entropy.shannon_entropy(counts)).collect()} == {4}
