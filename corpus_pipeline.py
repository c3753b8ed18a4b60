"""Documents through the corpus operators, stage by stage.

Toxic documents go, repeated lines are cut, near duplicates are reduced to one document each, sources
are mixed to their target weights (a document taken twice is there twice), and the rest is encoded.
Every stage but the last returns the columns of documents, and works on what the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.llm import bpe, lines, minhash, mixing, toxicity
from accountlens.llm.common import checkpointed
from accountlens.llm.queries import table, toxicity_scores

#: SQL can express neither the trained classifier nor the drawn sample.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on the labelled ones, doesn't call toxic.

    Null and empty texts aren't toxic; rows that repeat are judged alike.
    """
    own = _unused(docs, "toxicity")
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"), own)
    return scored.where(F.col(f"{own}.toxic") < toxicity.THRESHOLD).select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier one resembles; n_chars follows the text.

    A document without a line with words left goes; null and empty texts stay.
    """
    return _counted(docs, lines.without_repeats(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group; all rows with a null one, and all rows of a kept id."""
    gone = _unused(docs, "gone_id")
    found = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs["doc_id"] == F.col(gone), "leftanti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A row is known by a digest of all its columns, nulls included: rows of one id or of none are apart,
    and rows equal in all columns are alike, so one of them stands for what was drawn of all.
    """
    row, copies, copy = (_unused(docs, c) for c in ("drawn_row", "drawn_copies", "drawn_copy"))
    values = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    keyed = docs.withColumn(row, F.md5(F.to_json(values, {"ignoreNullFields": "false"})))
    drawn = mixing.mix(keyed, row_col=row).where("copies > 0")
    drawn = checkpointed(drawn.groupBy(F.col("row").alias(row)).agg(F.sum("copies").cast("int").alias(copies)))
    met = keyed.join(drawn, row).dropDuplicates([row])
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of each document that is left."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


def _unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.length("text").cast(kind))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("minhash_dedup", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
