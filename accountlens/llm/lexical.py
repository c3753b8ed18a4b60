"""Ranked lexical search: every document scored for every item, by bags of the items' words.

Documents are reduced to the words that items hold: a bag of (term, tf). Documents with one bag and one
length norm m have one score for each item, so they are a class: classes are formed by a hash and told
apart by the whole bag, scored once, and the best classes of each item are expanded to their documents
by ascending id. Of documents, only ids are looked at twice.

An item's best ``k`` documents are among its best ``k`` classes by score, then least id: each class that
comes before holds a document that comes before. Likewise of a class only its ``k`` least ids can count.
Both reductions work on shares of the rows first, so neither a class nor an item can be hot.

Items are taken in blocks of a bounded number of (item, term) pairs, each block against all documents;
what a block broadcasts is bounded with it.

Null and empty texts have no terms: such a document is counted nowhere, such an item ranks nothing.
Rows that repeat are documents (items) of their own; null ids come last among equal scores. Columns
other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from accountlens.llm.common import Scratch, checkpointed, map_arrow

#: Documents returned for an item.
K = 50
#: (item, term) pairs of a block.
BLOCK_PAIRS = 500_000
#: Scores that a task holds at a time.
SCORES = 2_000_000
#: Shares that one class's, or one item's, rows are first reduced in.
SHARES = 32
#: Classes that are broadcast at most, by number or hash.
BROADCAST_ROWS = 1_000_000

#: Bytes of a term stay, A-Z in lower case; all others separate.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, in order, with repeats."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_no, id, term) of each item's distinct terms; item_no tells equal rows apart."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            numbers, ids = batch.column(0), batch.column(1)
            listed = [sorted(set(terms(t.as_py()))) for t in batch.column(2)]
            rows = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
            flat = pa.array([t for x in listed for t in x], pa.binary())
            return [numbers.take(pa.array(rows)), ids.take(pa.array(rows)), flat]

        return work

    kind = items.schema[id_col].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("item_no"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(numbered, make, f"item_no long, id {kind}, term binary")


def _bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, bag) of each document: its number of terms, and the vocabulary's numbers of those in
    it with their tf, as 32-bit pairs in order; null if there are none."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        number = shared.value
        known = number.__contains__

        def work(batch: pa.RecordBatch) -> list:
            n, bags = [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                n.append(len(found))
                counts = Counter(filter(known, found))
                pairs = sorted((number[t], c) for t, c in counts.items())
                bags.append(np.array(pairs, dtype="<u4").tobytes() if pairs else None)
            return [batch.column(0), n, bags]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, make, f"doc_id {kind}, n long, bag binary")


def _bag(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of an array of bags."""
    raw = [x.as_py() for x in data]
    pairs = np.frombuffer(b"".join(raw), dtype="<u4").reshape(-1, 2)
    return np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw]), pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def _document_frequencies(bags: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches):
        counts = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(_bag(batch.column(0))[1], minlength=n_terms)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["term", "df"])

    counted = bags.where("bag is not null").select("bag").mapInArrow(run, "term long, df long")
    df = np.zeros(n_terms, dtype=np.int64)
    # a row per term of the block's vocabulary
    for row in counted.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row["term"]] = row["df"]
    return df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def _class_scores(classes: DataFrame, weight: np.ndarray, starts: np.ndarray, listed: np.ndarray, n_items: int, k: int) -> DataFrame:
    """(item, score, first_id, class_no) of the best k classes of each item, task by task.

    Items of term t are ``listed[starts[t]:starts[t + 1]]``. A task keeps the best so far.
    """
    shared = classes.sparkSession.sparkContext.broadcast((weight, starts, listed))
    kind = classes.schema["first_id"].dataType.simpleString()
    rows_at_once = max(1, SCORES // max(n_items, 1))

    def run(batches):
        w, begin, items = shared.value
        best: list[list[tuple]] = [[] for _ in range(n_items)]

        def order(entry: tuple) -> tuple:
            score, first, *_ = entry
            return -score, first is None, first

        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                m = part.column("m").to_numpy()
                row, term, tf = _bag(part.column("bag"))
                gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                scores = np.zeros((part.num_rows, n_items), dtype=np.int64)
                by_term = np.argsort(term, kind="stable")
                cuts = np.flatnonzero(np.diff(term[by_term])) + 1
                for own in np.split(by_term, cuts) if len(by_term) else []:
                    t = term[own[0]]
                    # one row holds a term once: no place is added to twice
                    scores[row[own][:, None], items[begin[t] : begin[t + 1]]] += gain[own][:, None]
                first, numbers = part.column("first_id"), part.column("class_no")
                for item in range(n_items):
                    column, held = scores[:, item], best[item]
                    least = held[-1][0] if len(held) == k else 1
                    found = np.flatnonzero(column >= least)
                    if len(found) > k:
                        # ties at the k-th score all stay for the order by id
                        found = found[column[found] >= np.partition(column[found], -k)[-k]]
                    if len(found):
                        new = [(int(column[r]), first[r].as_py(), numbers[r].as_py()) for r in found.tolist()]
                        best[item] = sorted(held + new, key=order)[:k]
        rows = [(item, *entry) for item, held in enumerate(best) for entry in held]
        for at in range(0, len(rows), 10_000):
            columns = list(zip(*rows[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names = ["item", "score", "first_id", "class_no"]
    kinds = [pa.int64(), pa.int64(), to_arrow_type(classes.schema["first_id"].dataType), pa.int64()]
    return classes.select("first_id", "m", "bag", "class_no").mapInArrow(
        run, f"item long, score long, first_id {kind}, class_no long"
    )


def first_rows(df: DataFrame, keys: list[str], order: list, k: int, number: str, spread: list[str]) -> DataFrame:
    """The first k rows of each key, numbered from 1: of shares of its rows first, then of what they leave."""
    share = F.pmod(F.xxhash64(*spread), F.lit(SHARES))
    few = df.withColumn("share", share)
    few = few.withColumn(number, F.row_number().over(Window.partitionBy(*keys, "share").orderBy(*order)))
    few = few.where(F.col(number) <= k).drop(number, "share")
    ranked = few.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(number) <= k)


def _block_ranks(docs: DataFrame, items: list[tuple], id_col: str, text_col: str, k: int, kept: Scratch) -> DataFrame:
    """(item, rank, doc_id, score) for a block's rows (item, term)."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in items}))}
    n_items = max(i for i, _ in items) + 1
    pairs = sorted((vocabulary[t], i) for i, t in items)
    starts = np.searchsorted(np.array([t for t, _ in pairs]), np.arange(len(vocabulary) + 1))
    listed = np.array([i for _, i in pairs], dtype=np.int64)
    bags = kept(_bags(docs, vocabulary, id_col, text_col))
    size = bags.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n_docs, length = size["docs"], size["length"]
    weight = weights(n_docs, _document_frequencies(bags, len(vocabulary)))
    norm = F.expr(f"50 + (cast(50 as bigint) * n * {n_docs}L) div {max(length, 1)}L")
    held = bags.where("bag is not null").select("doc_id", norm.alias("m"), "bag", F.xxhash64("bag").alias("hash"))
    # the hash finds a class, the bag itself tells classes of one hash apart
    same = ["hash", "m", "bag"]
    classes = held.groupBy(*same).agg(F.min("doc_id").alias("first_id"))
    classes = kept(classes.withColumn("class_no", F.monotonically_increasing_id()))
    scored = kept(_class_scores(classes, weight, starts, listed, n_items, k))
    first = [F.col("score").desc(), F.col("first_id").asc_nulls_last()]
    best = kept(first_rows(scored, ["item"], first, k, "class_rank", ["class_no"]).drop("class_rank", "first_id"))
    # at most k classes an item of the block
    numbers = best.select("class_no").distinct()
    wide = numbers.count() > BROADCAST_ROWS
    by_size = (lambda df: df.hint("merge")) if wide else F.broadcast
    few = kept(classes.join(by_size(numbers), "class_no").select(*same, "class_no"))
    found = held.join(by_size(few.select("hash", "m").distinct()), ["hash", "m"], "leftsemi")
    ascending = [F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    found = first_rows(found.withColumn("row", F.monotonically_increasing_id()), same, ascending, k, "place", ["row"])
    members = kept(found.join(few.hint("merge"), same).select("class_no", "doc_id", "row"))
    chosen = best.join(members.hint("merge"), "class_no")
    order = [F.col("score").desc(), *ascending]
    return first_rows(chosen, ["item"], order, k, "rank", ["row"]).select("item", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each item."""
    spark = docs.sparkSession
    with Scratch(spark) as kept:
        held = kept(_item_terms(items, item_id, text_col))
        n_blocks = max(1, -(-held.count() // block_pairs))
        block = F.pmod(F.xxhash64("item_no"), F.lit(n_blocks))
        kind = docs.schema[doc_id].dataType.simpleString()
        ranks = spark.range(0).selectExpr(
            "id as item_no", "cast(null as int) as rank", f"cast(null as {kind}) as doc_id", "id as score"
        )
        for b in range(n_blocks):
            # bounded by the block's pairs
            rows = held.where(block == b).select("item_no", "term").collect()
            if not rows:
                continue
            numbers = {no: i for i, no in enumerate(sorted({r["item_no"] for r in rows}))}
            own = [(numbers[r["item_no"]], bytes(r["term"])) for r in rows]
            of = spark.createDataFrame([(i, no) for no, i in numbers.items()], "item long, item_no long")
            found = _block_ranks(docs, own, doc_id, text_col, k, kept).join(F.broadcast(of), "item")
            ranks = ranks.union(kept(found.select("item_no", "rank", "doc_id", "score")))
        ids = held.select("item_no", F.col("id").alias(item_id)).distinct()
        found = ranks.join(ids, "item_no").select(item_id, "rank", F.col("doc_id").alias(doc_id), "score")
        return checkpointed(found)
