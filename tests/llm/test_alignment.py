"""Alignment and its counts against a byte-by-byte brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("accountlens.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from accountlens.llm import alignment, queries  # noqa: E402
from accountlens.llm.byte_level import byte_alphabet  # noqa: E402

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.fixture(scope="module")
def sides():
    model = public_tokenizers.path("piece_bpe_32k.model")
    return alignment.SpacedByteLevel(queries.byte_level()), alignment.PieceTokenizer(model)


def brute_force(texts):
    """Rows of COLUMNS by the libraries, a token and a byte at a time."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = byte_alphabet()
    found, counts = [], Counter()
    for text in texts:
        tokens_a, tokens_b = [], []
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            tokens_a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                tokens_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
            raw = b" " + text.encode()
            if any(b"".join(x for _, x in t) != raw for t in (tokens_a, tokens_b)):
                tokens_a, tokens_b = [], []
        owner = [[n for n, (_, x) in enumerate(tokens) for _ in x] for tokens in (tokens_a, tokens_b)]
        links = Counter((tokens_a[i][0], tokens_b[j][0]) for i, j in set(zip(*owner)))
        counts += links
        ends = [set(itertools.accumulate(len(x) for _, x in t)) for t in (tokens_a, tokens_b)]
        both = ends[0] & ends[1]
        groups = []
        for side, tokens in enumerate((tokens_a, tokens_b)):
            at, n = 0, 0
            for i, x in tokens:
                if n == len(groups):
                    groups.append(([], []))
                groups[n][side].append(str(i))
                at += len(x)
                n += at in both
        groups = [[",".join(side) for side in g] for g in groups]
        found.append((len(tokens_a), len(tokens_b), len(groups), links, ";".join("|".join(g) for g in groups)))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (
            n_a, n_b, n_groups, sum(links.values()),
            sum(n for (x, y), n in links.items() if counts[x, y] == most[y]),
            sum(n * counts[p] for p, n in links.items()), groups,
        )
        for n_a, n_b, n_groups, links, groups in found
    ]


def texts():
    rnd = random.Random(4)
    words = ["the", "token", "ization", "über", "naïve", "🙂", "x1", "don't", "  ", "\n", "▁", "日本", "zzyzx", "<s>", "<0x41>", "ﬁ", "é", "\x00", "\t"]
    made = [" ".join(rnd.choices(words[:10], k=rnd.randint(1, 40))) for _ in range(60)]
    made += ["".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(80)]
    odd = [None, "", " ", "\n\n", "a", "<|endoftext|> and </s>", "lead " * 600, " two  spaces ", "same text", "same text", "same text"]
    return made + odd


@pytest.mark.parametrize("sizes", [{}, {"buffer": 60, "fan": 3, "slice_records": 2}])
def test_equals_brute_force(spark, sides, sizes):
    listed = texts()
    rows = [(None if i % 9 == 0 else i // 2, t, 5, b"x") for i, t in enumerate(listed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run long, share binary").repartition(5)
    found = [(r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.align(docs, *sides, **sizes).collect()]
    expected = [(r[0], *b) for r, b in zip(rows, brute_force(listed))]
    assert sorted(map(str, found)) == sorted(map(str, expected)) and any(r[4] for r in found)


def test_sample_equals_brute_force(spark):
    rows = queries.QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect()
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS[:-1]) + (r["groups_sha256"],) for r in rows}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest() if text else ""
    expected = brute_force([r["text"] for r in docs])
    assert found == {r["doc_id"]: (*e[:-1], digest(e[-1])) for r, e in zip(docs, expected)}


def test_merge_of_runs():
    rnd = np.random.default_rng(3)
    runs, sums = [], Counter()
    for n in (0, 1, 30_000, 9_000, 9_000):
        codes = np.unique(rnd.integers(0, 50_000, n))
        totals = rnd.integers(1, 9, len(codes))
        runs.append(alignment._blocks(codes, totals))
        sums.update(dict(zip(codes.tolist(), totals.tolist())))
    parts = list(alignment.merged(runs, pool=5000))
    assert len(parts) > 3
    codes = np.concatenate([c for c, _ in parts]).tolist()
    assert codes == sorted(sums) and np.concatenate([t for _, t in parts]).tolist() == [sums[c] for c in codes]
    marked = list(alignment.with_best(iter(parts), 100))
    most = defaultdict(int)
    for c, t in sums.items():
        most[c // 100] = max(most[c // 100], t)
    for codes, totals, best in marked:
        assert best.tolist() == [int(t == most[c // 100]) for c, t in zip(codes.tolist(), totals.tolist())]
    assert sum(len(c) for c, _, _ in marked) == len(sums)


def test_no_documents(spark, sides):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align(docs, *sides).collect() == []
