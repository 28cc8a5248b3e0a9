"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the words, their stems (first six letters), word pairs and pairs
across one word that occur in it, hashed to 2^18 coordinates, present or not.  Every coordinate has its own learning
rate; L1 leaves most weights at zero, so a model is a few thousand pairs of integers
and floats, whatever the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from marketlens.session import ship_package

BITS = 18
STEM = 6
WORD = re.compile(r"[^\W_]+")
MEMO_WORDS = 500_000


@dataclass(frozen=True)
class Settings:
    """`max_rows`: labelled rows that training takes at most (those of the smallest hashes)."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 6
    max_rows: int = 16_000


@dataclass(frozen=True)
class Model:
    """Coordinates that are not zero (ascending), their weights, the bias."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float64)
        out[self.ids] = self.weights
        return out


class WordHashes(dict):
    """Hash of a word (above 32 bits) and of its stem (below)."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh32_intdigest(word) << 32 | xxhash.xxh32_intdigest(word[:STEM], 1)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value
        return value


def features(text: str, memo: WordHashes) -> np.ndarray:
    """Ascending coordinates of the words, stems, word pairs and skip pairs of a text."""
    words = WORD.findall(text.lower())
    both = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    h, stems = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    every = np.concatenate([h * a, stems * b, (h[:-1] * a + h[1:]) * b, (h[:-2] * b + h[2:]) * c])
    every = every ^ (every >> np.uint64(29))
    return np.unique((every * a) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """Weights after `epochs` passes in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    share = min(max(labels.mean() if len(labels) else 0.0, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))

    def weights(at):
        zi, l1 = z[at], np.where(at == bias, 0.0, s.l1)
        size = np.maximum(np.abs(zi) - l1, 0.0)
        return -np.sign(zi) * size / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for ids, y in zip(rows, labels):
            at = np.append(ids, bias)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(prior + w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(bias + 1))
    ids = np.flatnonzero(w[:bias])
    return Model(ids, w[ids], prior + float(w[bias]))


def train(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Model of the rows of `labels` (doc_id, toxic) that have a document.

    At most `settings.max_rows` labels of documents are taken, those of the smallest hash
    of the id, and one row an id (of repeated ids the text of the smallest hash), so one
    task holds a bounded number of rows; fewer labels are all taken.  Null labels and ids
    are left out, contradicting labels of an id count as toxic; without labels every
    score is the one of an even prior.
    """
    ship_package()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("long").alias("y"))
        .orderBy(order, "doc_id")
        .limit(settings.max_rows)
        .select(F.col("doc_id").alias("_labelled"), "y", order.alias("o"))
    )
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(known), F.col("_id") == F.col("_labelled"))
        .groupBy("o", "_id", "y")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    memo = WordHashes()

    def featurise(batches):
        for batch in batches:
            found = [features(t.as_py(), memo).astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("o"), batch.column("_id").cast(pa.string()), batch.column("y"), pa.array(found, pa.binary())],
                names=["o", "i", "y", "f"],
            )

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("i", "ascending"), ("f", "ascending")])
        rows = [np.frombuffer(f.as_py(), np.int32).astype(np.int64) for f in table.column("f")]
        model = ftrl(rows, table.column("y").to_numpy().astype(float), settings)
        return pa.table(
            {"ids": [model.ids.astype(np.int64)], "weights": [model.weights], "bias": [model.bias]},
            schema=pa.schema([("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())]),
        )

    found = rows.mapInArrow(featurise, "o long, i string, y long, f binary")
    model = found.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "ids array<long>, weights array<double>, bias double").first()
    if model is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Model(np.array(model.ids, np.int64), np.array(model.weights), model.bias)


def scorer(spark, model: Model):
    """A column function: text to score in 0 to 1.  Null texts score as empty ones."""
    ship_package()
    shared = spark.sparkContext.broadcast((model.ids, model.weights, model.bias))
    memo, held = WordHashes(), []

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        ids, weights, bias = shared.value
        if not held:  # once a task
            held.append(Model(ids, weights, bias).dense())
        dense = held[0]
        sums = [bias + dense[features(t or "", memo)].sum() for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -35, 35))))

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5) for every row, repeated ones too."""
    value = scorer(docs.sparkSession, model)
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .select("doc_id", value("text").alias("score"))
        .select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows that score below the threshold, all columns as they are."""
    return docs.filter(scorer(docs.sparkSession, model)(F.col(text_col)) < threshold)
