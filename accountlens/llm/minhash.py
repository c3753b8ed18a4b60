"""Near-duplicate documents: one-permutation hashing, banded buckets, stars, then all that is left apart.

A document's set is its distinct five-word shingles (fewer words: the whole sequence as one; none:
the empty set, linked with nothing). One pass hashes every shingle once; the least hash of each of
``BINS`` equal ranges is the sketch, and an empty bin takes the value of another by optimal
densification. ``BANDS`` groups of bins give the buckets. First a bucket joins one member (the hub)
with the others, not all with all: the hub is the one that meets most others in all its buckets, as the
text that a group of copies comes from does. Buckets whose members are then in several connected parts
go into another round, with a hub from outside the largest part that meets the members of other parts.
These ``TURNS`` rounds make at most as many pairs as members of buckets. Last, in buckets still of several
parts, every member outside the largest part is compared with all members of other parts, by signatures
in blocks; so no two members of a bucket stay apart unseen. Candidates are confirmed on the full sets.

Nodes are distinct sets, named by a 64-bit digest: a group of copies is one node.
Null and empty texts have an empty set. Rows that repeat a doc_id share its component; rows with a
null doc_id keep their size, have no component and are kept. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlens.llm.common import WordHashes, checkpointed, drop_unused, map_arrow, map_groups, mixed, words_of
from accountlens.llm.graph import components

SHINGLE = 5
BANDS = 40
ROWS = 5
BINS = BANDS * ROWS
#: Links: NUMERATOR / DENOMINATOR of the union is shared at least.
NUMERATOR, DENOMINATOR = 75, 100
#: Star rounds.
TURNS = 2
#: Bins of a signature, one byte each.
SIGNATURE = 512
#: A pair is confirmed unless its signatures share less than the threshold by so many standard deviations.
DEVIATIONS = 4
#: Members of a bucket compared with so many others in one block.
BLOCK = 128
#: A bucket's rows are spread over so many keys when its hub is sent to them.
_SALTS = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    each = hashes.of(words)
    size = min(n, size)
    total = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        total = total * _BASE + each[j : n - size + 1 + j]
    return np.unique(mixed(total))


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least hash of each bin; an empty bin borrows from the first full one of its own random order."""
    # bins are ranges of the hash, and the set is sorted: the least of a bin is where it begins
    bin_of = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(bin_of, return_index=True)
    values = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    values[full], filled[full] = shingles[first], True
    empty = np.flatnonzero(~filled).astype(np.uint64)
    attempt = 1
    while len(empty):
        other = mixed((empty + np.uint64(attempt * 1_000_003)) * _BASE) % np.uint64(bins)
        found = filled[other]
        values[empty[found]] = values[other[found]]
        empty = empty[~found]
        attempt += 1
    return values


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key a band, different bands never alike."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * _BASE
    for column in values.reshape(bands, -1).T:
        key = mixed(key + column)
    return key.view(np.int64)


def signature(shingles: np.ndarray, bins: int = SIGNATURE) -> bytes:
    """One byte of the least hash of each bin, 0 for an empty one."""
    bin_of = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(bin_of, return_index=True)
    values = np.zeros(bins, np.uint8)
    values[full] = shingles[first] % np.uint64(255) + np.uint64(1)
    return values.tobytes()


def could_share(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether rows of signatures leave a link possible between sets of ``total`` shingles together.

    The bins that either fills show that many random members of the union, so the share of equal ones
    is spread as in drawing without replacement from the union that a pair at the threshold has.
    """
    equal = ((a == b) & (a != 0)).sum(axis=1)
    drawn = ((a | b) != 0).sum(axis=1)
    least = NUMERATOR / DENOMINATOR
    spread = np.sqrt(least * (1 - least) * np.maximum(0, 1 / drawn - (1 + least) / total))
    return equal >= (least - DEVIATIONS * spread) * drawn - 1e-6


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, bands): size, digest and band keys of each row's set."""

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> list:
            sizes, nodes, bands = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(words_of(text.as_py()), hashes)
                sizes.append(len(shingles))
                nodes.append(_digest(shingles))
                bands.append(band_keys(sketch(shingles)) if len(shingles) else None)
            return [batch.column(0), sizes, nodes, bands]

        return work

    return map_arrow(
        docs.select(F.col(id_col).cast("long"), text_col),
        make,
        "doc_id long, n_shingles long, node long, bands array<long>",
    )


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, shingles, signature, bands): digest, sorted full set, signature of each row's set.

    ``bands`` has the lower halves of the band keys.
    """

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> list:
            sets = [shingle_set(words_of(t.as_py()), hashes) for t in batch.column(1)]
            shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            bands = [band_keys(sketch(s)).astype(np.uint32).tobytes() if len(s) else None for s in sets]
            return [batch.column(0), [_digest(s) for s in sets], shingles, [signature(s) for s in sets], bands]

        return work

    return map_arrow(
        docs.select(F.col(id_col).cast("long"), text_col),
        make,
        "doc_id long, node long, shingles array<long>, signature binary, bands binary",
    )


def _digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _could_link(a: str, b: str):
    """Sizes that allow a link."""
    return F.expr(f"{DENOMINATOR} * least({a}, {b}) >= {NUMERATOR} * greatest({a}, {b})")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose full sets link them."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("total"))
        .where(DENOMINATOR * F.col("shared") >= NUMERATOR * (F.col("total") - F.col("shared")))
        .select("a", "b")
    )


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's hub with the members of other parts.

    The hub is the first of the members outside the bucket's main part (of all, where there is none);
    so every member looks at one node a bucket and turn. In the first turn those that meet most others
    are first, then the order is random and changes with ``turn``.
    """
    order = F.xxhash64("node", F.lit(turn)) if turn else -F.col("meetings")
    first = F.min(F.struct((F.col("part") == F.col("main")).alias("inside"), order.alias("order"), "node", "part", "n_shingles"))
    hubs = members.groupBy("bucket").agg(first.alias("hub"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int"))
    return (
        salted.join(hubs.select("*", salts), ["bucket", "salt"])
        .where("hub.part <> part")
        .where(_could_link("hub.n_shingles", "n_shingles"))
        .select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"))
        .distinct()
    )


def _near_labels(links: DataFrame) -> DataFrame:
    """(node, component): the least node within two links; one for all of a star, and never of two parts.

    Enough to tell what has been joined so far; what it holds apart is only looked at once more.
    """
    both = links.union(links.select("b", "a")).toDF("u", "v")
    once = checkpointed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("least")), tidy=True)
    met = both.join(once.toDF("v", "next"), "v").groupBy("u").agg(F.min("next").alias("next"))
    return met.join(once, "u").select(F.col("u").alias("node"), F.least("least", "next").alias("component"))


def _apart(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Members of the buckets that fall into several parts, with their part and the largest of the bucket.

    With parts ``found``, also how many members the bucket has, and how many outside its largest part.
    """
    if found is None:
        return members.withColumns({"part": F.col("node"), "main": F.lit(None).cast("long")})
    parts = members.join(found, "node", "left").select(
        "node", "n_shingles", "bucket", F.coalesce("component", "node").alias("part")
    )
    # the part with most members is the main one; ties go to the greater
    split = (
        parts.groupBy("bucket", "part")
        .agg(F.count("*").alias("n"))
        .groupBy("bucket")
        .agg(F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("all"))
        .where("parts > 1")
        .select("bucket", F.col("most.part").alias("main"), "all", (F.col("all") - F.col("most.n")).alias("outside"))
    )
    return parts.join(split, "bucket")


def _left_apart(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket and two parts whose signatures could be those of a link.

    Members outside the main part meet all, in blocks of at most about ``BLOCK`` by ``BLOCK``. A pair is
    given by the first bucket it shares: as it is in two parts, so is every bucket of both.
    """
    rows = members.join(sets.select("node", "signature", "bands"), "node").withColumn("inside", F.col("part") == F.col("main"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    columns = ["node", "part", "n_shingles", "inside", "signature", "bands"]
    looking = rows.where("not inside").select(
        "bucket", own("outside").alias("low"), every("all").alias("high"), F.lit(True).alias("looks"), *columns
    )
    met = rows.select(
        "bucket", every("outside").alias("low"), own("all").alias("high"), F.lit(False).alias("looks"), *columns
    )
    return map_groups(looking.union(met), ["bucket", "low", "high"], _compared, "a long, b long")


def _compared(groups: pa.Table) -> list:
    """Pairs (a, b) of the members that look and those that are met, group by group."""
    keys = [groups.column(c).to_numpy() for c in ("bucket", "low", "high")]
    node, part, size = (groups.column(c).to_numpy() for c in ("node", "part", "n_shingles"))
    looks, inside = (groups.column(c).to_numpy() for c in ("looks", "inside"))
    marks, bands = (
        np.frombuffer(b"".join(groups.column(c).to_pylist()), kind).reshape(len(node), -1)
        for c, kind in (("signature", np.uint8), ("bands", np.uint32))
    )
    here = keys[0].astype(np.uint32)
    starts = np.flatnonzero(np.r_[True, np.any([np.diff(k) != 0 for k in keys], axis=0)])
    out: list[list] = [[], []]

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), 4096):
            x, y = i[k : k + 4096], j[k : k + 4096]
            near = could_share(marks[x], marks[y], size[x] + size[y])
            x, y = x[near], y[near]
            first = (bands[x] == bands[y]).argmax(axis=1)
            owned = bands[x, first] == here[x]
            out[0].append(np.minimum(node[x], node[y])[owned])
            out[1].append(np.maximum(node[x], node[y])[owned])

    held, n = [], 0
    for start, end in zip(starts, [*starts[1:], len(node)]):
        x = start + np.flatnonzero(looks[start:end])
        y = start + np.flatnonzero(~looks[start:end])
        low, high = np.minimum.outer(size[x], size[y]), np.maximum.outer(size[x], size[y])
        # two that both look meet twice: once is enough
        able = (part[x][:, None] != part[y]) & (inside[y] | (node[x][:, None] < node[y]))
        i, j = np.nonzero(able & (DENOMINATOR * low >= NUMERATOR * high))
        held.append((x[i], y[j]))
        n += len(i)
        if n >= 4096:
            compare(*(np.concatenate(c) for c in zip(*held)))
            held, n = [], 0
    if n:
        compare(*(np.concatenate(c) for c in zip(*held)))
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    ``component_id`` is the least doc_id that links lead to, ``kept`` says that it is the own one.
    """
    rows = checkpointed(sketches(docs, id_col, text_col), tidy=True)
    known = rows.where("n_shingles > 0 and doc_id is not null")
    members = known.select("node", "n_shingles", "bands").dropDuplicates(["node"])
    members = members.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    meetings = F.sum("n").over(Window.partitionBy("node")).alias("meetings")
    members = members.join(crowded, "bucket").select("node", "n_shingles", "bucket", meetings)
    members = checkpointed(members, tidy=True)
    # the set of a node is made from the text of its first document
    first = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    needed = checkpointed(first.join(members.select("node").distinct(), "node", "leftsemi"), tidy=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(needed.select("doc_id").distinct(), "doc_id", "leftsemi")
    sets = shingle_sets(texts).join(needed, ["doc_id", "node"], "leftsemi")
    sets = checkpointed(sets.dropDuplicates(["node"]).select("node", "shingles", "signature", "bands"), tidy=True)

    links, tried, found = None, None, None
    for turn in range(TURNS):
        pairs = _stars(_apart(members, found), turn)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "leftanti")
        pairs = checkpointed(pairs, tidy=True)
        more = checkpointed(confirmed(pairs, sets), tidy=True)
        links, tried = (more, pairs) if links is None else (links.union(more), tried.union(pairs))
        found = checkpointed(_near_labels(links) if turn < TURNS - 1 else components(links), tidy=True)
    pairs = _left_apart(_apart(members, found), sets).join(tried, ["a", "b"], "leftanti")
    pairs = checkpointed(pairs, tidy=True)
    more = checkpointed(confirmed(pairs, sets), tidy=True)
    links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    # rows that repeat a doc_id with another set connect the two sets
    lead = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    repeated = known.join(lead, "doc_id").select("a", F.col("node").alias("b"))
    found = components(links.union(repeated))
    named = known.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    named = checkpointed(named, tidy=True)
    least = checkpointed(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), tidy=True)
    of = named.join(least, "component").select("doc_id", "component_id").distinct()
    drop_unused(docs.sparkSession)
    return rows.join(of, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
