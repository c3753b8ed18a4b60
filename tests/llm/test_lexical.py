"""Lexical search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("accountlens.llm")
from accountlens.llm import lexical  # noqa: E402

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k):
    bags = [(i, split(t)) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    found = []
    for item, text in items:
        wanted, scored = set(split(text)), []
        for i, b in bags:
            tf, m = Counter(b), 50 + 50 * len(b) * n_docs // max(length, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
                for t in wanted
                if tf[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        found += [(item, n, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    words = ["the", "Of", "straße", "naïve", "x1", "9", "日本", "É", "alpha", "beta", "gamma", *(f"w{i}" for i in range(60))]
    make = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    base = [make(rnd.randint(1, 60)) for _ in range(60)]
    texts = base + [base[0]] * 70 + [base[1].upper()] * 5 + [make(3000), None, "", " -- ", "only these", "only these"]
    rnd.shuffle(texts)
    docs = [(None if i % 17 == 0 else i // 2, t) for i, t in enumerate(texts)]
    items = [(i // 2, make(rnd.randint(1, 12))) for i in range(9)] + [(90, None), (91, "--"), (92, "absent"), (None, "the w1"), (93, base[0])]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"k": 3}, {"k": 7, "block_pairs": 20}])
def test_equals_brute_force(spark, corpus, sizes):
    docs, items = corpus
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, bag string, n int").repartition(7)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    rows = lexical.search(d, i, **sizes).collect()
    found = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str)
    assert found == brute_force(docs, items, sizes.get("k", 50))


def test_many_classes_are_met_by_a_shuffle(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lexical, "SCORES", 30)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((tuple(r) for r in lexical.search(d, i, k=5).collect()), key=str)
    assert found == brute_force(docs, items, 5)


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_no_rows(spark, empty):
    rows = [(1, "some words")]
    d = spark.createDataFrame([] if empty == "docs" else rows, "doc_id long, text string")
    i = spark.createDataFrame([] if empty == "items" else rows, "item_id long, text string")
    assert lexical.search(d, i).collect() == []
