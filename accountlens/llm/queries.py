"""The corpus operators as named queries over the sample tables, with their SQL twins."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.llm import (
    alignment,
    bpe,
    chunks,
    hamming,
    lattice,
    lexical,
    licences,
    lines,
    minhash,
    mixing,
    packing,
    secrets,
    toxicity,
)
from accountlens.llm.byte_level import ByteLevelTokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op10_minhash"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s
  from words where len(w) > 0
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as k
  from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all
), links as (
  select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * k >= 75 * (p.n + q.n - k)
), both_ways as (
  select a, b from links union all select b, a from links
), reached as (
  select doc_id as node, doc_id as r from documents
  union
  select node, b from reached join both_ways on r = a
), least as (
  select node, min(r) as component_id from reached group by node
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, component_id = d.doc_id as kept
from documents d left join sizes using (doc_id) join least on node = d.doc_id
"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


@query
def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(hamming.sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


ORACLES["op4_hamming_topk"] = """
with codes as (
  select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as bits
  from embeddings where embedding is not null
), pairs as (
  select q.vec_id as query_id, c.vec_id as neighbour_id,
    list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: case when z[1] <> z[2] then 1 else 0 end)) as d
  from codes q join codes c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by d, neighbour_id) as rank from pairs
)
select query_id, rank, neighbour_id, cast(d as integer) as distance from ranked where rank <= 10
"""


@query
def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op8_lattice_dedup"] = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
), links as (
  select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id
  where list_cosine_similarity(x.e, y.e) >= 0.93
), reached as (
  select vec_id as node, vec_id as r from v
  union
  select node, b from reached join links on r = a
), least as (
  select node, min(r) as component_id from reached group by node
), counts as (
  select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0) as n_links, component_id, component_id = vec_id as kept
from v left join counts on a = vec_id join least on node = vec_id
"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.passages_by_document(table(spark, sf_dir, "documents"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


#: Label columns as categories of the chain, in its order.
CATEGORIES = ("low_quality", "toxic")


def toxicity_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxicity_scores(docs: DataFrame, labels: DataFrame, into: str = "toxicity") -> DataFrame:
    """``docs`` with the probabilities of a chain trained on them and ``labels``."""
    return toxicity.score(docs, toxicity.train(docs, toxicity_labels(labels), list(CATEGORIES)), into=into)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    p = [F.round(f"toxicity.{c}", 6).alias(f"p_{c}") for c in CATEGORIES]
    return scored.select("doc_id", *p, (F.col("toxicity.toxic") >= toxicity.THRESHOLD).alias("toxic"))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.train(docs))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_licensed"),
        F.array_sort(F.array_distinct("found.family")).alias("families"),
        F.concat_ws(",", F.transform("found", lambda x: F.concat_ws(":", x["paragraph"], x["family"]))).alias("paragraphs"),
    )


def byte_level() -> ByteLevelTokenizer:
    return ByteLevelTokenizer.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    checksum = (lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32", "long")
    return packing.pack(packing.cut_pieces(table(spark, sf_dir, "documents"), byte_level(), of_ids=checksum))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alignment.SpacedByteLevel(byte_level())
    b = alignment.PieceTokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    digest = (lambda groups: hashlib.sha256(groups).hexdigest(), "string")
    found = alignment.align(table(spark, sf_dir, "documents"), a, b, of_groups=digest)
    return found.withColumnRenamed("groups", "groups_sha256")


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical"] = r"""
with split as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), totals as (
  select count(*) as n_docs, sum(len(words)) as length from split where len(words) > 0
), item_terms as (
  select distinct i, item_id, term from (
    select row_number() over () as i, item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark)
), counts as (
  select r, doc_id, n, term, count(*) as tf
  from (select r, doc_id, len(words) as n, unnest(words) as term from split)
  where term in (select term from item_terms) group by all
), weights as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from counts group by term), totals
), gains as (
  select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // length))) as gain
  from counts join weights using (term), totals
), scores as (
  select i, item_id, r, doc_id, cast(sum(gain) as bigint) as score
  from item_terms join gains using (term) group by i, item_id, r, doc_id having sum(gain) > 0
), ranked as (
  select item_id, row_number() over (partition by i order by score desc, doc_id nulls last, r) as rank, doc_id, score
  from scores
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50
"""
