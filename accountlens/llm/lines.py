"""Line dedup: an exact set-similarity join of lines, in DataFrame functions alone.

A line is the set of its words (separated by space or TAB..CR, lower case). A line is removed if an
earlier one, by (doc_id, number, text digest), has a Jaccard similarity of ``THRESHOLD`` or more, be that one
removed itself or not. Equal sets meet by their digest. Distinct sets are joined on the words of
their prefixes: words are ordered by rarity in the corpus, so a prefix holds the rarest ones, and
two similar sets must share a word of their prefixes. Length and position of the shared word, and 64 parity
bits of each set, rule out most candidates before the full sets are compared. A set first meets those next to
it among the sets of each word, and the earliest: in a group of near copies these decide nearly all. What that
finds removed meets no more earlier sets.

Words are known by 58 bits of their hash, rarity by the number of words in the same of ``BUCKETS``
buckets, on a scale of powers of two: any order that is the same for all lines gives the same
result. Lines without words (blank ones, null and empty texts) are never removed. A null doc_id comes
before all others. Rows of one doc_id (or of none) are told apart by a digest of their text, which comes last
in the order of lines (an id of one row may have 0 in its place). Rows equal in id and text are one document: what stands there doesn't remove itself.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from accountlens.llm.common import Scratch, checkpointed

THRESHOLD = 0.8
BUCKETS = 1 << 15
_SALTS = 16
#: What tells a line from all others, in the order of lines.
_PLACE = ("doc_id", "line_no", "row")
#: What stands between words.
_SEPARATORS = " \t\n\x0b\f\r"
#: Bits of a line number in a place that is a long.
_LINE_BITS = 24
#: Words of a set that has 128 parity bits, at least.
_LONG = 64
#: Words of prefixes are joined in so many passes: only the rows of one are on disk at a time.
_PASSES = 2
#: Sets before it, among those of a word, that a set meets first.
_NEXT = 2


def _constant(values: np.ndarray) -> Column:
    """An array of longs as one constant; as a literal each of its numbers would be an expression, made one by one."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def _words(text: Column) -> Column:
    """Words of a text, with empty ones between; a split at a plain character needs no regular expression."""
    for other in _SEPARATORS[1:]:
        text = F.replace(text, F.lit(other), F.lit(" "))
    return F.split(F.lower(text), " ")


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rarity class (power of two of the count) of every bucket, over all words: a sketch of fixed size."""
    counts = (
        docs.select(F.explode(_words(F.col(text_col))).alias("word"))
        .groupBy(F.xxhash64("word").bitwiseAND(BUCKETS - 1).alias("bucket"))
        .agg(F.floor(F.log2(F.count("*"))).cast("int").alias("class"))
    )
    classes = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():  # one number per bucket, whatever the corpus
        if row["bucket"] is not None:
            classes[row["bucket"]] = row["class"]
    return classes


def _ranked(line: Column, classes: Column) -> Column:
    """Distinct words of a line as numbers, rarest first: the bucket's rarity, then the hash."""
    hashes = F.transform(F.array_remove(_words(line), ""), lambda word: F.xxhash64(word))

    def rank(h: Column) -> Column:
        return F.get(classes, h.bitwiseAND(BUCKETS - 1).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 6))

    return F.sort_array(F.transform(F.array_distinct(hashes), rank))


def _parity(words: Column) -> Column:
    """64 bits, each the parity of the words that fall on it: two sets differ in as many words at least."""
    one = F.lit(1).cast("long")
    bit = lambda w: F.call_function("shiftleft", one, w.bitwiseAND(63).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(bit(w)))


def _half_parity(words: Column) -> Column:
    """The parity of half of the words, of long sets only: it splits the 64 bits into 128."""
    half = F.filter(words, lambda w: w.bitwiseAND(64) != 0)
    return F.when(F.size(words) >= _LONG, _parity(half)).otherwise(F.lit(0).cast("long"))


def _differ() -> Column:
    """Words in which two sets differ at least, by their parities; 64 bits are full at some hundred words."""
    whole, half = (F.col(c).bitwiseXOR(F.col(f"{c}_1")) for c in ("parity", "half"))
    both = F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))
    return F.when(F.least("n", "n_1") >= _LONG, both).otherwise(F.bit_count(whole))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def _least_shared(n: str, other: str, threshold: float) -> Column:
    """Words that two sets of these sizes must share; a touch lower against rounding."""
    return F.ceil((F.col(n) + F.col(other)) * (threshold / (1 + threshold)) - 1e-9)


def _prefix(n: Column, threshold: float) -> Column:
    """Length of the prefix of a set of n words."""
    return (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")


def _may_be_similar(threshold: float) -> Column:
    """Whether a set and an earlier one (``_1``) that share a word of their prefixes can be similar.

    Similar sets pass on every word they share: what stands before and behind it leaves room for enough others.
    """
    least = _least_shared("n", "n_1", threshold)
    around = F.least("pos", "pos_1") + F.least(F.col("n") - F.col("pos"), F.col("n_1") - F.col("pos_1"))
    return (least <= F.least("n", "n_1")) & (least <= around) & (_differ() <= F.col("n") + F.col("n_1") - 2 * least)


#: What is known of a set where a word of its prefix stands, and what is kept of two that met.
_KNOWN = ("at", "n", "parity", "half", "pos")
_MET = ("at", "at_1", "n", "n_1", "pos", "pos_1")


def _met_near(place: DataFrame, threshold: float) -> DataFrame:
    """Sets met by the earliest set of a prefix word, and by those next before them among the word's sets."""
    by_word = Window.partitionBy("word").orderBy("at")
    known = F.struct(*_KNOWN)
    others = [F.first(known).over(by_word), *(F.lag(known, k).over(by_word) for k in range(1, _NEXT + 1))]
    met = place.select(*_KNOWN, F.array(*others).alias("others")).select(*_KNOWN, F.explode("others").alias("other"))
    met = met.select(*_KNOWN, *(F.col(f"other.{c}").alias(f"{c}_1") for c in _KNOWN))
    return met.where("at_1 < at").where(_may_be_similar(threshold)).select(*_MET)


def _kept(met: DataFrame, threshold: float) -> DataFrame:
    """Of sets met by others with a word of their prefixes, those that may be similar to an earlier one.

    A ``pos`` below 0 says that a set is removed already: it meets none, but later ones meet it. That is asked
    for together with what holds for both. Alone, it would be asked before the sets are moved, and they and
    the earlier ones, which may be one table, be moved apart.
    """
    met = met.where(F.when(F.col("pos") < 0, F.lit(False)).otherwise(F.col("at_1") < F.col("at")))
    met = met.withColumn("pos_1", F.when(F.col("pos_1") < 0, -1 - F.col("pos_1")).otherwise(F.col("pos_1")))
    return met.where(_may_be_similar(threshold)).select(*_MET)


def _met(sets: DataFrame, earlier: DataFrame, threshold: float) -> DataFrame:
    """Sets met by every earlier one of another table with a word of their prefixes."""
    return _kept(sets.join(earlier, "word"), threshold)


def _met_all(place: DataFrame, threshold: float) -> DataFrame:
    """:func:`_met` among the sets of one table. Both sides are renamed alike, so Spark moves it once."""
    columns = ("word", *_KNOWN)
    later, earlier = (place.select(*(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in (0, 1))
    met = later.join(earlier, F.col("word_0") == F.col("word_1"))
    return _kept(met.withColumnsRenamed({f"{c}_0": c for c in columns}), threshold)


def _candidates(met: DataFrame, threshold: float, all_words: bool, scratch: Scratch) -> DataFrame:
    """Pairs (at, at_1) of sets that met and may be similar, the second earlier.

    ``all_words`` says that a pair meets on every such word: these, and what follows the shorter
    rest, must then be as many as similar sets share.
    """
    least = _least_shared("n", "n_1", threshold)
    met = (
        met.groupBy("at", "at_1", "n", "n_1")
        .agg(F.count("*").alias("met"), F.min("pos").alias("pos"), F.min("pos_1").alias("pos_1"))
        .where(least <= F.least(F.col("n") - F.col("pos"), F.col("n_1") - F.col("pos_1")))
    )
    if all_words:
        rest = F.greatest(*(F.col(n) - _prefix(F.col(n), threshold) for n in ("n", "n_1")))
        met = met.where(least <= F.col("met") + rest)
    return scratch(met.select("at", "at_1"))


def _of_pass(words: DataFrame, k: int) -> DataFrame:
    """The words of one of ``_PASSES`` passes."""
    return words.where(F.pmod("word", F.lit(_PASSES)) == k)


def _place(texts: DataFrame) -> Column:
    """Where a line stands, in the order of lines, as one value that can be compared and grouped by.

    A long of doc_id and line number where all fit and no id needs a digest, else a struct: it is moved
    many times, and a long is a fifth of the struct.
    """
    row = texts.agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
        F.count_if(F.col("doc_id").isNull() | (F.col("row") != 0)).alias("apart"), F.max(F.octet_length("text")).alias("bytes"),
    ).first()
    whole = isinstance(texts.schema["doc_id"].dataType, (LongType, IntegerType, ShortType, ByteType))
    # a text has no more lines than bytes, and one
    if whole and not row["apart"] and (row["least"] or 0) >= 0 and (row["most"] or 0) < 1 << 62 - _LINE_BITS and (row["bytes"] or 0) + 1 < 1 << _LINE_BITS:
        return F.call_function("shiftleft", F.col("doc_id").cast("long"), F.lit(_LINE_BITS)).bitwiseOR(F.col("line_no").cast("long"))
    return F.struct(*_PLACE)


def _hashed(*columns: str | Column) -> Column:
    return F.xxhash64(*columns).bitwiseAND(64 * BUCKETS - 1)


def _bits(needed: DataFrame, *columns: str) -> np.ndarray:
    """Two million bits, set where a needed row falls: tells most other rows from them."""
    h = _hashed(*columns)
    one = F.lit(1).cast("long")
    set_ = F.bit_or(F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int"))).alias("bits")
    bits = np.zeros(BUCKETS, np.int64)
    for row in needed.groupBy(F.shiftrightunsigned(h, 6).alias("at")).agg(set_).collect():
        bits[row["at"]] = row["bits"]
    return bits


def _confirmed(
    pairs: DataFrame, texts: DataFrame, place: Column, classes: Column, threshold: float, scratch: Scratch
) -> DataFrame:
    """(at): the later lines of the pairs whose whole sets are similar. Sets come from the texts anew."""
    needed = scratch(pairs.select("at").union(pairs.select(F.col("at_1").alias("at"))).distinct())
    at = _hashed("at")
    maybe = F.get(_constant(_bits(needed, "at")), F.shiftrightunsigned(at, 6).cast("int"))
    bit = F.call_function("shiftrightunsigned", maybe, at.bitwiseAND(63).cast("int"))
    full = scratch(
        _lines(texts)
        .select(place.alias("at"), "line")
        .where(bit.bitwiseAND(1) == 1)
        .join(needed, "at", "leftsemi")
        .select("at", _ranked(F.col("line"), classes).alias("words"))
        .dropDuplicates(["at"])
    )
    shared = F.size(F.array_intersect("words", "words_1"))
    return (
        pairs.join(full, "at")
        .join(full.toDF("at_1", "words_1"), "at_1")
        .select("at", shared.alias("k"), (F.size("words") + F.size("words_1")).alias("both"))
        .where(F.col("k") >= (F.col("both") - F.col("k")) * threshold - 1e-9)
        .select("at")
        .distinct()
    )


def text_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows of one id apart: a digest of the text, or 0 where an id is surely alone.

    Ids that repeat are marked in two million bits, which an id that is alone may hit too; null ids
    always have the digest. A constant takes no room in what is moved, digests don't compress.
    """
    one = F.lit(1).cast("long")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("need_id")).count().where("count > 1")
    bits = _bits(repeated, "need_id")
    digest, alone = F.xxhash64(text_col), F.lit(0).cast("long")
    if not bits.any():
        return F.when(F.col(id_col).isNull(), digest).otherwise(alone)
    h = _hashed(id_col)
    word = F.get(_constant(bits), F.shiftrightunsigned(h, 6).cast("int"))
    marked = F.call_function("shiftrightunsigned", word, h.bitwiseAND(63).cast("int")).bitwiseAND(one) == 1
    return F.when(F.col(id_col).isNull() | marked, digest).otherwise(alone)


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row: Column | None = None
) -> DataFrame:
    """(doc_id, line_no, row) of the lines to remove, numbered from 0, each once.

    ``row``: what :func:`text_key` gives, if it is at hand.
    """
    row = text_key(docs, id_col, text_col) if row is None else row
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row.alias("row"))
    with Scratch(docs.sparkSession, tidy=True) as scratch:
        return checkpointed(_removed(texts, threshold, scratch))


def _removed(texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    classes, at = _constant(rarity(texts) << 58), _place(texts)
    # a condition on the words would have them made twice
    worded = _lines(texts).where(F.btrim("line", F.lit(_SEPARATORS)) != "")
    words = worded.withColumn("words", _ranked(F.col("line"), classes))
    n = F.size("words")
    keys, own = ["key_a", "key_b"], ["n", "parity", "half", "prefix"]
    whole = scratch(
        words.select(
            *_PLACE, F.xxhash64("words").alias("key_a"), F.hash("words", n).alias("key_b"), n.alias("n"),
            _parity(F.col("words")).alias("parity"), _half_parity(F.col("words")).alias("half"),
            F.slice("words", 1, _prefix(n, threshold)).alias("prefix"),
        )
    )
    first = [F.first(c).alias(c) for c in own]
    sets = scratch(whole.groupBy(*keys).agg(F.min(at).alias("at"), F.count("*").alias("lines"), *first))
    lines = scratch(whole.select(*_PLACE, *keys))
    scratch.drop(whole)
    own = F.posexplode("prefix").alias("pos", "word")
    place = sets.select("at", "n", "parity", "half", own)
    passes = [scratch(_met_near(_of_pass(place, k), threshold)) for k in range(_PASSES)]
    found = _candidates(reduce(DataFrame.union, passes), threshold, False, scratch)
    scratch.drop(*passes)
    found = scratch(_confirmed(found, texts, at, classes, threshold, scratch))
    # what is left, with every earlier set
    found = found.withColumn("similar", F.lit(True))
    known = scratch(sets.join(found, "at", "left").withColumn("similar", F.coalesce("similar", F.lit(False))))
    scratch.drop(sets)
    place = known.select("at", "n", "parity", "half", "similar", own)
    place = place.withColumn("pos", F.when(F.col("similar"), -1 - F.col("pos")).otherwise(F.col("pos")))
    passes = [scratch(_met_all(_of_pass(place, k), threshold)) for k in range(_PASSES)]
    late = _candidates(reduce(DataFrame.union, passes), threshold, True, scratch)
    scratch.drop(*passes)
    late = _confirmed(late, texts, at, classes, threshold, scratch).withColumn("late", F.lit(True))
    # of each set that loses lines: where it stands first, and whether that place goes too; salted, as one
    # line may be most
    marked = known.join(late, "at", "left").select(*keys, "at", "lines", F.coalesce("late", "similar").alias("similar"))
    marked = scratch(marked.where("similar or lines > 1").drop("lines"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    salted = lines.select(*keys, *_PLACE, F.pmod(F.xxhash64(*_PLACE), F.lit(_SALTS)).cast("int").alias("salt"))
    gone = salted.join(marked.select("*", salts), [*keys, "salt"]).where(F.col("similar") | (F.col("at") < at))
    return gone.select(*_PLACE).distinct()


#: Columns that removed lines are met by; no table has them.
_ID, _ROW, _GONE = "_line_dedup_id", "_line_dedup_row", "_line_dedup_removed"


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_lines, n_removed, removed array<int>)."""
    row = text_key(docs, id_col, text_col)
    removed = _by_document(removed_lines(docs, id_col, text_col, row=row))
    n = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), n.alias("n_lines"), row.alias("row"))
    return rows.join(removed, F.col("doc_id").eqNullSafe(F.col(_ID)) & (F.col("row") == F.col(_ROW)), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size(_GONE), F.lit(0)).cast("long").alias("n_removed"), _or_none(_GONE, "removed")
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut from the text; a document that loses all its lines with words goes.

    Null and empty texts stay as they are. Other columns are untouched, whatever their names.
    """
    row = text_key(docs, id_col, text_col)
    removed = _by_document(removed_lines(docs, id_col, text_col, row=row))
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(_GONE))
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    own = docs[id_col].eqNullSafe(F.col(_ID)) & (row == F.col(_ROW))
    text = F.when(F.col(_GONE).isNull(), F.col(text_col)).otherwise(left)
    met = docs.join(removed, own, "left").where(F.col(_GONE).isNull() | left.rlike("[^\\x20\\x09-\\x0D]"))
    return met.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))


def _by_document(removed: DataFrame) -> DataFrame:
    by = (F.col("doc_id").alias(_ID), F.col("row").alias(_ROW))
    return removed.groupBy(*by).agg(F.sort_array(F.collect_list("line_no")).alias(_GONE))


def _or_none(name: str, alias: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<int>")).alias(alias)
