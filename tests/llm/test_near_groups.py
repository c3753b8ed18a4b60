"""Near copies within large groups: of one text that few members are next to, and of many texts of one mould."""

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("accountlens.llm")

from accountlens.llm import minhash  # noqa: E402

DDL = "doc_id long, text string"


def shingles(text: str) -> set:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a: set, b: set) -> bool:
    return 100 * len(a & b) >= 75 * len(a | b)


def got_components(spark, texts) -> list[int]:
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DDL)).collect()
    return [c for _, c in sorted((r.doc_id, r.component_id) for r in rows)]


def test_copies_that_only_the_first_text_links(spark):
    draw = random.Random(1)
    first = [f"w{draw.randrange(5000)}" for _ in range(300)]
    texts = []
    for k in range(400):
        words = list(first)
        for at in draw.sample(range(4, 296, 5), 7):
            words[at] = f"own{k}_{at}"
        texts.append(" ".join(words))
    at = 237  # neither the least nor the greatest id
    texts.insert(at, " ".join(first))
    sets = [shingles(t) for t in texts]
    assert all(alike(s, sets[at]) for s in sets)
    assert np.mean([alike(a, b) for a, b in itertools.combinations(sets[:60], 2)]) < 0.05
    assert got_components(spark, texts) == [0] * len(texts)


def test_small_groups_that_share_all_buckets_with_others(spark):
    """Texts of 16 parts with two of their own: those with the same two changed are linked, all others nearly."""
    draw = random.Random(2)
    parts = [[f"w{p}_{i}" for i in range(40)] for p in range(16)]
    texts = []
    for g, changed in enumerate(itertools.combinations(range(16), 2)):
        for k in range(3):
            words = [[f"own{g}_{k}_{p}_{i}" for i in range(40)] if p in changed else parts[p] for p in range(16)]
            texts.append((draw.random(), g, " ".join(itertools.chain(*words))))
    texts.sort()
    group = [g for _, g, _ in texts]
    sets = [shingles(t) for _, _, t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if alike(sets[a], sets[b])]
    assert links and all(group[a] == group[b] for a, b in links)
    root = list(range(len(sets)))
    for _ in range(3):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert len(set(root)) < len(root) / 2
    assert got_components(spark, [t for _, _, t in texts]) == root


def test_signatures_of_links_are_never_told_apart():
    rnd = np.random.default_rng(3)
    for n in (1, 4, 30, 300, 3000, 30_000):
        shared = -(-6 * n // 7)
        a, b, total = [], [], []
        for _ in range(60):
            x = rnd.integers(0, 2**64, 2 * n - shared, np.uint64)
            s, t = np.sort(x[:n]), np.sort(x[n - shared :])
            a.append(np.frombuffer(minhash.signature(s), np.uint8))
            b.append(np.frombuffer(minhash.signature(t), np.uint8))
            total.append(len(s) + len(t))
        assert minhash.could_share(np.array(a), np.array(b), np.array(total)).all()
        # half of the union is told apart
        x = rnd.integers(0, 2**64, 3 * n, np.uint64)
        far = [np.frombuffer(minhash.signature(np.sort(p)), np.uint8)[None] for p in (x[: 2 * n], x[n:])]
        assert n < 300 or not minhash.could_share(*far, np.array([4 * n])).any()
