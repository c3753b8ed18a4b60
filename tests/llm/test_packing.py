"""Packing: every token placed once, gapless, in few sequences, however many partitions sweep."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("accountlens.llm")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from accountlens.llm import packing, queries  # noqa: E402
from accountlens.llm.common import Scratch  # noqa: E402


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for size in sorted(sizes, reverse=True):
        fitting = [g for g in gaps if g >= size]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - size)
        else:
            gaps.append(capacity - size)
    return len(gaps)


def checked(rows, capacity):
    """Number of sequences of (length, sequence, offset) rows, each filled without gaps from 0."""
    by = defaultdict(list)
    for length, sequence, offset in rows:
        by[sequence].append((offset, length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


CASES = {
    "short": [random.Random(1).randint(1, 30) for _ in range(3000)],
    "mixed": [min(100, int(random.Random(i).lognormvariate(3, 1)) + 1) for i in range(3000)],
    "one length": [34] * 2500 + [33] * 300,
    "over half": [random.Random(i).randint(51, 100) for i in range(800)] + [7] * 900,
    "ones": [1] * 1500,
    "single": [100],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("partition_rows", [10_000, 150])
def test_sequences_are_full(spark, case, partition_rows):
    sizes = CASES[case]
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, length long")
    with Scratch(spark) as kept:
        rows = packing.best_fit(items, 100, kept, partition_rows).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(sizes)))
    n = checked([(sizes[r["id"]], r["sequence_id"], r["offset"]) for r in rows], 100)
    best = best_fit_decreasing(sizes, 100)
    assert n <= best + max(2, best // 50)


def test_gaps_of_larger_partitions_serve_smaller_ones():
    # parts: (part, pieces left, longest, serving gaps, smallest)
    found = packing.carry([(0, 0, None, 3, 60), (1, 2, 50, 1, 40), (2, 5, 20, 0, None)])
    assert found.tolist() == [[1, 0, 2, 0, 0, 1], [2, 0, 2, 1, 0, 2], [2, 2, 5, 0, 2, 3]]


def test_pieces_equal_the_library(spark, tmp_path):
    texts = [None, "", "a", "x <|endoftext|> y", "é 🙂 \x1c", "word " * 5000, "y" * 9000, "tie", "tie"]
    texts += ["".join(random.Random(i).choices("ab c\n1'", k=2047)) for i in range(5)]
    ids = [None if i % 4 == 1 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame(
        list(zip(ids, texts, [1] * len(texts), [2] * len(texts))), "doc_id long, text string, length long, piece_no long"
    )
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    checksum = (lambda x: zlib.crc32(x.astype("<u4").tobytes()), "ids_crc32", "long")
    rows = packing.pack(packing.cut_pieces(docs, queries.byte_level(), of_ids=checksum), partition_rows=5).collect()
    expected = []
    for key, text in zip(ids, texts):
        whole = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(whole) % 2048 or 2048
        cuts = [0, *range(first, len(whole) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((key, piece, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())))
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    order = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(found, key=order) == sorted(expected, key=order)
    checked([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 2048)
    assert {type(r["ids"]) for r in packing.cut_pieces(docs.limit(1), queries.byte_level()).collect()} == {list}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    rows = packing.pack(packing.cut_pieces(docs, queries.byte_level()))
    assert rows.collect() == [] and {"sequence_id", "offset", "ids"} <= set(rows.columns)


def test_query_places_every_token(spark):
    rows = queries.QUERIES["op13_packing"](spark, "/root/testdata/sf0.001").collect()
    n = checked([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 2048)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert n <= least * 1.02 + 1
