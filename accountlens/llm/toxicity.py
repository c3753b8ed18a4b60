"""Toxicity by a classifier chain over label columns.

The categories are predicted one after the other by linear models. Each later model sees the
probabilities of the earlier categories, and is trained with out-of-fold ones: those of models that
didn't see the row. Features are words and their beginnings and ends, as square roots of their share of the
text, so that long and short texts weigh alike.

The chain is fitted on at most ``SAMPLE`` labelled documents, the first by hash of the id; of their
features those ``FEATURES`` per category are kept whose frequency differs most between the classes.
Every document is scored, over its whole text. A null or empty text has probability 0 throughout.
Unlabelled and null-labelled rows don't train; without any labelled row all probabilities are 0.
Rows that repeat are scored each; of repeated labels the greatest counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.llm.common import REMEMBERED_WORDS, checkpointed, map_arrow
from accountlens.llm.linear import fit_logistic, predict_logistic

#: Most labelled documents that a chain is fitted on.
SAMPLE = 8000
FEATURES = 768
#: Documents of the sample that a feature must occur in.
LEAST_DOCS = 3
FOLDS = 4
THRESHOLD = 0.5
#: Texts whose feature matrix is held at a time.
SLICE = 512


def word_features(word: str) -> list[str]:
    """The word, its first three to five letters and its last three."""
    out = [f"={word}"]
    n = len(word)
    out += [f"{k}{word[:k]}" for k in (3, 4, 5) if n > k]
    if n > 3:
        out.append(f"-{word[-3:]}")
    return out


@dataclass
class Chain:
    """Categories in order, feature numbers, and one weight vector per category."""

    categories: list[str]
    features: dict[str, int]
    weights: list[np.ndarray]
    #: Features of the words of late; a worker lets them go with the broadcast chain.
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def rows(self, texts: list[str], known: dict) -> tuple[np.ndarray, np.ndarray]:
        """Feature matrix of the texts, and which have words."""
        x = np.zeros((len(texts), len(self.features)), np.float32)
        full = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            counts = Counter(text.lower().split())
            total = counts.total()
            full[i] = total > 0
            row = x[i]
            for word, n in counts.items():
                numbers = known.get(word)
                if numbers is None:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    numbers = known[word] = tuple(
                        k for f in word_features(word) if (k := self.features.get(f)) is not None
                    )
                for k in numbers:
                    row[k] += n
            if total:
                np.sqrt(row / total, out=row)
        return x, full

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories), each fed to the next."""
        p = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            p = np.concatenate([p, predict_logistic(np.concatenate([x, p], axis=1), w)[:, None].astype(np.float32)], axis=1)
        return p


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """Weights per category (a column of ``y``); earlier probabilities enter out of fold."""
    weights = []
    earlier = np.zeros((len(x), 0), np.float32)
    for k in range(y.shape[1]):
        weights.append(fit_logistic(x, y[:, k], more=earlier))
        if k + 1 == y.shape[1]:
            break
        held_out = np.zeros(len(x), np.float32)
        for f in np.unique(fold):
            w = fit_logistic(x, y[:, k], more=earlier, rows=fold != f)
            # a slice at a time: the matrix is the largest thing in the task
            for at in np.array_split(np.flatnonzero(fold == f), 1 + len(x) // SLICE):
                held_out[at] = predict_logistic(np.concatenate([x[at], earlier[at]], axis=1), w)
        earlier = np.concatenate([earlier, held_out[:, None]], axis=1)
    return weights


def train(
    docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
    sample: int = SAMPLE, features: int = FEATURES,
) -> Chain:
    """A chain for the 0/1 columns ``categories`` of ``labels`` (in that order, keyed by ``id_col``)."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), *categories).dropna()
    known = known.groupBy("id").agg(*(F.max(c).cast("int").alias(c) for c in categories))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # only ids that have a text count towards the sample; it is bounded, so it may be broadcast
    chosen = known.join(texts.select("id").distinct(), "id", "leftsemi").orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = checkpointed(chosen)
    rows = checkpointed(
        texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)))
    )
    n_rows = rows.count()
    if not n_rows:
        return Chain(categories, {}, [])

    def make():
        def work(batch: pa.RecordBatch) -> list:
            out: list[list] = [[], *([] for _ in categories)]
            for row, text in enumerate(batch.column(0)):
                found = {f for w in set(text.as_py().lower().split()) for f in word_features(w)}
                out[0] += found
                for k in range(len(categories)):
                    out[k + 1] += [batch.column(k + 1)[row].as_py()] * len(found)
            return out

        return work

    ddl = ", ".join(f"y{k} int" for k in range(len(categories)))
    spread = map_arrow(rows.select("text", *categories), make, f"feature string, {ddl}")
    counts = checkpointed(
        spread.groupBy("feature")
        .agg(F.count("*").alias("n"), *(F.sum(f"y{k}").alias(f"n{k}") for k in range(len(categories))))
        .where(F.col("n") >= LEAST_DOCS)
    )
    totals = rows.agg(*(F.sum(c).alias(c) for c in categories)).first()
    kept: dict[str, int] = {}
    for k, c in enumerate(categories):
        with_, without = totals[c], n_rows - totals[c]
        if not with_ or not without:
            continue
        # difference of the two shares in units of its standard error
        share, rate = F.col("n") / n_rows, F.col(f"n{k}") / with_
        z = F.abs(rate - (F.col("n") - F.col(f"n{k}")) / without) / F.sqrt(share * (1 - share) + 1e-4)
        for r in counts.orderBy(z.desc(), "feature").limit(features).collect():
            kept.setdefault(r["feature"], len(kept))
    chain = Chain(categories, kept, [])

    held = spark.sparkContext.broadcast(chain)

    def make_sparse():
        model = held.value

        def work(batch: pa.RecordBatch) -> list:
            numbers, values = [], []
            for start in range(0, batch.num_rows, SLICE):
                x, _ = model.rows(batch.column(1).slice(start, SLICE).to_pylist(), model.known)
                for row in x:
                    numbers.append(np.flatnonzero(row))
                    values.append(row[numbers[-1]])
            return [batch.column(0), batch.column(2), numbers, values, *batch.columns[3:]]

        return work

    # texts become their few features in many tasks; the one that fits gets these alone
    kind = rows.schema["id"].dataType.simpleString()
    sparse = map_arrow(
        rows.select("id", "text", F.col("fold").cast("long"), *(F.col(c).alias(f"y{k}") for k, c in enumerate(categories))),
        make_sparse, f"id {kind}, fold long, numbers array<int>, values array<float>, {ddl}",
    )

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = np.zeros((group.num_rows, len(kept)), np.float32)
        at = np.repeat(np.arange(group.num_rows), pc.list_value_length(group["numbers"]).to_numpy())
        x[at, pc.list_flatten(group["numbers"]).to_numpy()] = pc.list_flatten(group["values"]).to_numpy()
        y = np.stack([group[f"y{k}"].to_numpy() for k in range(len(categories))], axis=1).astype(np.float32)
        weights = fit_chain(x, y, group["fold"].to_numpy())
        return pa.table({"number": pa.array(range(len(weights)), pa.int32()), "weights": pa.array([w.astype(float) for w in weights], pa.list_(pa.float64()))})

    fitted = sparse.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "number int, weights array<double>").collect()
    chain.weights = [np.array(r["weights"], np.float32) for r in sorted(fitted, key=lambda r: r["number"])]
    return chain


def score(docs: DataFrame, chain: Chain, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``into``, a struct of a probability per category; one of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    kind = ", ".join(f"{c} double" for c in chain.categories)

    @F.pandas_udf(kind)
    def probabilities(texts: pd.Series) -> pd.DataFrame:
        model = held.value
        p = np.zeros((len(texts), len(model.categories)))
        if model.weights:
            for start in range(0, len(texts), SLICE):
                x, full = model.rows([t or "" for t in texts.iloc[start : start + SLICE]], model.known)
                p[start : start + len(x)] = model.predict(x) * full[:, None]
        return pd.DataFrame(p, columns=model.categories)

    return docs.withColumn(into, probabilities(F.col(text_col)))
