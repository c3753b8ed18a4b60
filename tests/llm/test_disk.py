"""What intermediate tables leave on disk, and what line dedup moves."""

import random
import time

from pyspark.sql import functions as F

from accountlens.llm import lines, minhash


def _shuffles(spark) -> set[int]:
    """Shuffles that have files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_")}


def test_minhash_drops_shuffle_files_as_it_goes(spark):
    draw = random.Random(1)
    texts = [" ".join(draw.choices("abcdefgh", k=30)) for _ in range(20)]
    docs = spark.createDataFrame([(i, texts[i % 20] + (" x" if i % 3 else "")) for i in range(60)], "doc_id long, text string")
    first = spark.sparkContext._jsc.sc().newShuffleId()
    found = minhash.near_duplicates(docs)
    made = spark.sparkContext._jsc.sc().newShuffleId() - first
    time.sleep(3)
    # the cleaner has dropped what the rounds shuffled, not waited for the driver's memory to fill
    assert len([s for s in _shuffles(spark) if s > first]) < made / 3
    assert found.count() == 60


def _sets(spark, words):
    """Sets of numbers as the rows of their prefixes."""
    rows = spark.createDataFrame([(at, sorted(w)) for at, w in enumerate(words)], "at long, words array<long>")
    own = rows.select(
        "at", F.size("words").alias("n"), lines._parity(F.col("words")).alias("parity"),
        lines._half_parity(F.col("words")).alias("half"), F.slice("words", 1, lines._prefix(F.size("words"), 0.8)).alias("prefix"),
    )
    return own.select("at", "n", "parity", "half", F.posexplode("prefix").alias("pos", "word"))


def test_long_sets_that_share_a_word_alone_do_not_meet(spark):
    """64 parity bits say nothing of two sets of 150 words; 128 do."""
    draw = random.Random(2)
    words = [{7, *(draw.getrandbits(58) | 1 << 40 for _ in range(149))} for _ in range(30)]
    words.append({*sorted(words[0])[:-10], *(draw.getrandbits(58) | 1 << 40 for _ in range(10))})
    sets = _sets(spark, words)
    other = sets.select("word", *(F.col(c).alias(f"{c}_1") for c in ("at", "n", "parity", "half", "pos")))
    met = {(r["at"], r["at_1"]) for r in lines._met(sets, other, 0.8).collect()}
    assert (30, 0) in met
    assert len(met) <= 5


def test_passes_find_what_one_join_finds(spark, tmp_path):
    """Near copies around the length from which sets have 128 bits."""
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for n in (3, 10, 60, 66, 80, 150):
        for _ in range(4):
            base = draw.sample(vocabulary, n)
            texts += [" ".join([*base[: n - k], *draw.sample(vocabulary, k)]) for k in (0, max(1, n // 12), max(1, n // 9), n // 5)]
    docs = spark.createDataFrame([(i, "\n".join(texts[i::10])) for i in range(10)], "doc_id long, text string")
    place = [(i, j, set(t.split())) for i in range(10) for j, t in enumerate(texts[i::10])]
    expected = {
        (i, j) for a, (i, j, s) in enumerate(place) if any(5 * len(s & t) >= 4 * len(s | t) for _, _, t in place[:a])
    }
    got = {(r["doc_id"], r["line_no"]) for r in lines.removed_lines(docs).collect()}
    assert got == expected
    assert len(expected) > 20
