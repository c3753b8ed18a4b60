"""The corpus operators against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("accountlens.llm")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from accountlens.llm import (  # noqa: E402
    bpe, chunks, graph, hamming, lattice, licences, lines, minhash, mixing, secrets, toxicity,
)

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, node long"


def documents(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    rows = [(i if t != "no id" else None, t, None, s, None, 7, "x", 1) for i, (t, s) in enumerate(zip(texts, sources))]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def sentence(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd(words):
    """Null, empty, blank, no id, very long, copies, near copies, repeated lines."""
    rnd = random.Random(2)
    base = [sentence(rnd, words, n) for n in (3, 5, 60, 200, 40)]
    near = base[3].split()
    near[100] = "changed"
    more = [base[2] + "\n" + base[4], base[4] + "\n\n" + base[2], " ".join(near), "A", "a", "é ß 🙂 \x1c x"]
    return [None, "", " \n\t", "no id", *base, *base[2:4], *more, sentence(rnd, words, 30_000), "y" * 70_000]


def components_of(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_bpe_equals_tiktoken(spark, odd):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    v = bpe.Vocabulary.read(path)
    assert sorted(v.hash.lookup(v.tokens).tolist()) == list(range(len(v.tokens)))
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(v.tokens, v.ids.tolist())), special_tokens={}
    )
    rows = bpe.decode(bpe.encode(documents(spark, odd), path, public_tokenizers.PATTERN), path).collect()
    assert len(rows) == len(odd)
    for r in rows:
        text = "no id" if r.doc_id is None else odd[r.doc_id] or ""
        assert r.ids == known.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_long_text_is_cut_between_pieces(monkeypatch):
    v = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    e = bpe.Encoder(v, public_tokenizers.PATTERN)
    text = "ab  cd\n\n it's 12 éé, " * 50
    whole = e.encode([text])[0]
    monkeypatch.setattr(bpe, "TEXT_SLICE", 37)
    assert e.encode_long(text) == whole


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(70, 90)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links + [(3, 3)], "a long, b long")).collect()}
    want = components_of(100, links)
    assert all(want[n] == c for n, c in got.items()) and set(got) == {x for p in links if p[0] != p[1] for x in p}


def test_minhash_against_all_pairs(spark, odd, words):
    rnd = random.Random(7)
    texts = list(odd)
    for n in (8, 20, 50, 120):  # pairs about the threshold
        for k in range(8):
            w = sentence(rnd, words, n).split()
            texts.append(" ".join(w))
            for at in rnd.sample(range(n), max(1, n // 40 + k % 2)):
                w[at] = "new"
            texts.append(" ".join(w).upper())
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [
        (a, b) for a, b in itertools.combinations(range(len(texts)), 2)
        if sets[a] and texts[a] != "no id" != texts[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = components_of(len(texts), links)
    rows = minhash.near_duplicates(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is None:
            assert (r.component_id, r.kept, r.n_shingles) == (None, True, 1)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_repeated_ids_hang_together(spark, words):
    rnd = random.Random(3)
    a, b = sentence(rnd, words, 30), sentence(rnd, words, 30)
    docs = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (5, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (5, 1)}


def test_lines_against_all_pairs(spark, odd, words):
    rnd = random.Random(4)
    texts = [t for t in odd if t is None or len(t) < 10_000]
    for n in (1, 2, 5, 9, 20, 150):
        for _ in range(6):
            w = sentence(rnd, words, n).split()
            v = list(w)
            v[rnd.randrange(n)] = "other"
            rnd.shuffle(v)
            texts.append(" ".join(w) + "\r\n" + " ".join(v) + "\n" + " ".join(w))
    seen, gone = [], set()
    order = sorted(range(len(texts)), key=lambda i: (texts[i] != "no id", i))
    for i in order:
        for k, line in enumerate((texts[i] or "").split("\n")):
            s = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if s and any(len(s & t) >= 0.8 * len(s | t) - 1e-9 for t in seen):
                gone.add((None if texts[i] == "no id" else i, k))
            if s:
                seen.append(s)
    docs = documents(spark, texts)
    rows = lines.line_report(docs).collect()
    assert {(r.doc_id, k) for r in rows for k in r.removed} == gone and len(rows) == len(texts)
    left = {r.doc_id: r.text for r in lines.without_repeats(docs).collect()}
    for i, t in enumerate(texts):
        kept = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone]
        if t != "no id" and any(x.strip() for x in kept):
            assert left[i] == "\n".join(kept)
    assert left[0] is None and left[1] == ""


def test_rows_without_id_keep_their_own_lines(spark, words):
    rnd = random.Random(14)
    a, b, c, d, e = (sentence(rnd, words, 12) for _ in range(5))
    texts = [f"{a}\n{a}", f"{b}\n{c}", f"{d}\n{c}\n{e}"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    left = [r.text for r in lines.without_repeats(docs).collect()]
    assert sorted("\n".join(left).split("\n")) == sorted([a, b, c, d, e]) and len(left) == 3


def test_mix_balances(spark):
    rnd = random.Random(6)
    texts = ["w " * rnd.randint(0, 60) for _ in range(3000)] + [None, ""]
    sources = [rnd.choice(["a", "a", "a", "b", "c", None, "é"]) for _ in texts]
    rows = mixing.mix(documents(spark, texts, sources)).collect()
    assert len(rows) == len(texts)
    names = sorted({s for s in sources if s is not None}, key=lambda s: s.encode()) + [None]
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources) if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, total, open_ = {}, sum(size.values()), set(names)
    while True:
        share = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * share for s in open_}
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = sources[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 180 for s in names)
    again = {r.doc_id: r.taken for r in mixing.mix(documents(spark, texts, sources).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_pipeline_takes_rows_without_id_one_by_one(spark):
    import corpus_pipeline

    rnd = random.Random(16)
    rows = [(None if i % 3 == 0 else i, f"n{i} " + "w " * rnd.randint(0, 60), "aaab"[i % 4]) for i in range(900)]
    rows += [(None, "same " * 20, "a")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source_size: r.target for r in mixing.mix(docs).select("source_size", "target").distinct().collect()}
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    for s in "ab":
        taken = sum(len(r.text.split()) for r in got if r.source == s)
        assert abs(taken - target[size[s]]) <= 180


def test_flight_keeps_the_totals():
    random_ = np.random.default_rng(1)
    p, size = np.full(500, 0.37), random_.integers(1, 90, 500)
    q = mixing.flight(p, size, random_)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-4


def test_hamming_against_brute_force(spark):
    rnd = random.Random(8)
    codes = [rnd.getrandbits(64) - 2**63 for _ in range(300)]
    codes += [codes[0]] * 40 + [codes[1] ^ 1, None]
    rows = hamming.top_k(spark.createDataFrame(list(enumerate(codes)) + [(None, 5)], "id long, code long")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
    for q in range(0, 342, 20):
        near = sorted((((codes[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in enumerate(codes) if c is not None and i != q)[:10]
        assert sorted(got[q]) == [(k + 1, *x) for k, x in enumerate(near)]


def test_lattice_points_are_nearest_and_recall_holds():
    random_ = np.random.default_rng(2)
    x = random_.standard_normal((200, 8)) * 2
    p = lattice.nearest_e8(x)
    away = x[:, None] - (p[:, None] + lattice._roots()[None])
    assert (((x - p) ** 2).sum(1)[:, None] <= (away**2).sum(2) + 1e-9).all()
    u = random_.standard_normal((2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    d = random_.standard_normal(u.shape)
    d -= (d * u).sum(1)[:, None] * u
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * d / np.linalg.norm(d, axis=1)[:, None]
    h, salt = lattice.LatticeHash(64), np.zeros(2000, np.uint64)
    found = [bool(set(a) & set(b)) for a, b in zip(h.cells(u, salt).tolist(), h.cells(v, salt).tolist())]
    assert np.mean(found) >= 0.97  # at the threshold itself, where it is least


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)  # so that cells are split
    random_ = np.random.default_rng(3)
    base = random_.standard_normal((6, 64))
    vectors = [(base[k % 6] + random_.standard_normal(64) * 0.05).tolist() for k in range(90)]
    vectors += [vectors[0]] * 30 + [[0.0] * 64, None, [1.0, None], [float("nan")] * 64]
    labels = [k % 2 for k in range(120)] + [0, 0, 0, 0]
    labels[5] = None
    rows = list(zip(range(len(vectors)), vectors, labels))
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    fit = {i: np.array(v) / np.linalg.norm(v) for i, v, l in rows[:120] if l is not None}
    links = [(a, b) for a, b in itertools.combinations(fit, 2) if labels[a] == labels[b] and fit[a] @ fit[b] >= 0.93]
    want = components_of(len(rows), links)
    n = np.bincount([x for p in links for x in p], minlength=len(rows))
    assert {tuple(r) for r in got} == {(i, int(n[i]), want[i], want[i] == i) for i in range(len(rows))}


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [
        f"user: bob password: hunter2 at https://db.example.org/x\n\nhttps://alone.example.org login=x1y2",
        f'{key} "API_KEY" : "abcdefghijklmnop" ſecret=abcdefghijklmnop token=short {"0af" * 6}',
        "🙂 token: secret: abcdefghijklmnopq", None, "", "password=tiny1",
    ]
    rows = {r.doc_id: r for r in secrets.find_secrets(documents(spark, texts)).collect()}
    kinds = lambda i: [(s.kind, texts[i][s.start : s.end]) for s in rows[i].spans]
    assert kinds(0) == [("login", "user: bob"), ("weak_secret", "password: hunter2"), ("endpoint", "https://db.example.org/x")]
    assert [k for k, _ in kinds(1)] == ["access", "assign", "weak_secret", "hex"] and kinds(1)[0][1] == key
    assert [s.kind for s in rows[2].base] == [] and all(not rows[i].spans for i in (3, 4, 5))


def test_secrets_of_compound_names(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [
        "DB_HOST=db.internal\nDB_USER=admin\nDB_PASSWORD=short\nMYSQL_PWD=tiny\nsecret_key= 'abcd'",
        f"[default]\naws_access_key_id = {key}\naws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
        "monkey: banana keyboard: qwerty passage: third ghost: casper\nuser: bob",
        "DB_PASSWORD=short", "-" * 200_000 + " user=" + "user_" * 40_000,
    ]
    rows = {r.doc_id: r for r in secrets.find_secrets(documents(spark, texts)).collect()}
    kinds = lambda i: [(s.kind, texts[i][s.start : s.end]) for s in rows[i].spans]
    assert kinds(0) == [
        ("endpoint", "DB_HOST=db.internal"), ("login", "DB_USER=admin"), ("weak_secret", "DB_PASSWORD=short"),
        ("weak_secret", "MYSQL_PWD=tiny"), ("weak_secret", "secret_key= 'abcd"),
    ]
    assert kinds(1) == [
        ("login", f"aws_access_key_id = {key}"), ("access", key),
        ("weak_secret", "aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    ]
    assert not kinds(2) and not kinds(3) and not kinds(4)


def test_long_values_are_covered_whole(spark):
    texts = ["user=" + "u" * 90 + " password=" + "!p" * 60, "user=bob " + "secret=" * 100_000]
    rows = {r.doc_id: r for r in secrets.find_secrets(documents(spark, texts)).collect()}
    assert [(s.start, s.end) for s in rows[0].spans] == [(0, 95), (96, len(texts[0]))]
    assert [(s.start, s.end) for s in rows[1].spans] == [(0, 8), (9, len(texts[1]))]


def test_chunks_find_shared_passages(spark, words):
    rnd = random.Random(9)
    texts = [sentence(rnd, words, 300) for _ in range(60)]
    for k in range(0, 40, 2):  # the same passage at different places, in clean surroundings
        passage = sentence(rnd, words, 60)
        for i in (k, k + 1):
            w = texts[i].split()
            at = rnd.randrange(200)
            texts[i] = " ".join(w[:at] + [passage] + w[at:])
    rows = {r.doc_id: r for r in chunks.passages_by_document(documents(spark, [*texts, None, "", "no id"])).collect()}
    assert len(rows) == 63
    assert sum(rows[i].n_passages > 0 for i in range(40)) >= 39 and not any(rows[i].n_passages for i in range(40, 62))
    data = random.Random(1).randbytes(5000)
    ends = chunks.chunk_ends(data)
    assert ends[-1] == 5000 and (np.diff(ends, prepend=0) <= chunks.MOST).all()
    moved = chunks.chunk_ends(b"inserted" + data) - 8
    assert len(set(ends.tolist()) - set(moved.tolist())) <= 3


def test_duplicates_hold_no_kept_chunk(spark, words):
    rnd = random.Random(10)
    p, q, r = (sentence(rnd, words, 80) for _ in range(3))
    common = r.encode()[slice(*chunks.chunk_ends(r.encode())[[4, 5]])].decode()
    texts = [
        sentence(rnd, words, 30), *(f"{sentence(rnd, words, 30)} {x} {sentence(rnd, words, 30)}" for x in (p, p + " " + q, q)),
        r[: r.index(common)][-40:] + common + sentence(rnd, words, 30), *(f"{sentence(rnd, words, 30)} {r} {sentence(rnd, words, 30)}" for _ in "ab"),
    ]
    docs = documents(spark, texts)
    kept = {(c.doc_id, c.start, c.end): c.first for c in chunks.repeated_chunks(chunks.chunks(docs)).collect()}
    rows = {x.doc_id: x for x in chunks.passages_by_document(docs).collect()}
    spans = lambda s: [tuple(map(int, x.split("-"))) for x in s.split(",") if x]
    for i, row in rows.items():
        inside = lambda a, b, listed: any(x <= a and b <= y for x, y in spans(listed))
        for (d, a, b), first in kept.items():
            if d == i and inside(a, b, row.passages):
                assert inside(a, b, row.duplicate) == (not first)
    cut = {i: [texts[i].encode()[a:b].decode() for a, b in spans(x.duplicate)] for i, x in rows.items()}
    assert cut[1] == [] and len(cut[2]) == 1 and cut[2][0] in p and len(cut[3]) == 1 and cut[3][0] in q
    assert any(d == 5 and not f for (d, _, _), f in kept.items())
    assert sum(map(len, cut[5])) < 100 < sum(map(len, cut[6]))


def test_licences(spark, words):
    rnd = random.Random(11)
    texts = [sentence(rnd, words, 50) + "\n" + sentence(rnd, words, 20) for _ in range(80)]
    texts[1] += "\nReleased under the MIT License."
    texts[2] = "Licensed under the Apache License, Version 2.0."
    texts[3] += "\nthe license plate of the public car is under the general version"
    docs = documents(spark, [*texts, None, "", "no id"])
    rows = {r.doc_id: [f.family for f in r.found] for r in licences.scan(docs, licences.train(docs)).collect()}
    assert rows[1] == ["mit"] and rows[2] == ["apache-2.0"]
    assert all(not f for i, f in rows.items() if i not in (1, 2)) and len(rows) == 83


def test_chain_on_held_out_rows(spark, words):
    rnd = random.Random(12)
    bad, junk = ["grrz", "blargh", "zzok"], ["###", "$$$"]
    texts, rows = [], []
    for i in range(600):
        w = sentence(rnd, words, rnd.randint(20, 80)).split()
        toxic, low = rnd.random() < 0.2, rnd.random() < 0.2
        for _ in range(4 * toxic):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        for _ in range(6 * low):
            w.insert(rnd.randrange(len(w)), rnd.choice(junk))
        texts.append(" ".join(w))
        rows.append((i, int(low), int(toxic)))
    docs = documents(spark, [*texts, None, "", "no id"])
    labels = spark.createDataFrame(rows[:400] + [(0, None, None), (9999, 1, 1)], "doc_id long, low long, toxic long")
    chain = toxicity.train(docs, labels, ["low", "toxic"])
    assert len(chain.weights[1]) == len(chain.features) + 2
    got = {r.doc_id: r.toxicity.toxic >= 0.5 for r in toxicity.score(docs, chain).collect()}
    assert np.mean([got[i] == bool(t) for i, _, t in rows[400:]]) >= 0.97
    assert not got[600] and not got[601] and len(got) == 603


def test_empty_tables(spark):
    docs = documents(spark, [])
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    labels = spark.createDataFrame([], "doc_id long, toxic long")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    for df in (
        bpe.encode(docs, path, public_tokenizers.PATTERN), minhash.near_duplicates(docs), lines.line_report(docs),
        lines.without_repeats(docs), mixing.mix(docs), secrets.find_secrets(docs), chunks.passages_by_document(docs),
        licences.scan(docs, licences.train(docs)), toxicity.score(docs, toxicity.train(docs, labels, ["toxic"])),
        lattice.near_vectors(vectors), hamming.top_k(hamming.sign_codes(vectors, "vec_id", "embedding")),
    ):
        assert df.collect() == []


def test_digests_of_no_ids_are_those_of_empty_text(spark):
    from accountlens.llm.queries import bpe_digests

    r = bpe_digests(documents(spark, [None])).first()
    assert (r.n_tokens, r.ids_sha256) == (0, hashlib.sha256(b"").hexdigest()) and r.decoded_sha256 == r.ids_sha256
