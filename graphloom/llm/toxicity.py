"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, bigrams and one-word skip-grams of the whole text, hashed to
2^20 coordinates. FTRL-proximal has a learning rate for each coordinate, and its L1 term
keeps most weights at exactly zero, so the model is a short list of (coordinate, weight).
The list holds 2^20 entries at most (12 MB), so it is broadcast.

The model learns from a bounded sample of the labelled rows: the TRAIN_ROWS rows of either
label with the smallest hash of their id. Features are made on the executors; the driver
receives at most 2 * TRAIN_ROWS rows of coordinates. Scores read nothing but the text.

Defined results: a null, empty or wordless text has the score of the intercept alone; labels
that are null, and labelled rows without a document, teach nothing; without any label, or
with labels of one kind only, scores are constant (0 or 1 side of 0.5 by the labels, 0 where there
are none); repeated rows are scored one by one; other columns are kept by score(), but one of the
name of its own gives way to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, text_batches

BITS = 20
TRAIN_ROWS = 4000
EPOCHS = 3
MIN_ROWS = 3
_TOKEN = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    """Distinct coordinates of the words, bigrams and skip-grams of a text."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, _TOKEN.findall((text or "").lower())), dtype=np.uint64)
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    skip = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(1)
    return np.unique((mix64(np.concatenate([h, two, skip])) >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[self.index] = self.weight
        return w


def ftrl(flat: np.ndarray, ends: np.ndarray, labels: np.ndarray, alpha: float = 3.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = EPOCHS, toxic_weight: float = 2.0, min_rows: int = MIN_ROWS) -> Model:
    """FTRL-proximal over rows whose coordinates stand in flat, up to ends; the last coordinate
    is the intercept, which L1 leaves alone. Coordinates of fewer than min_rows rows have
    no weight; toxic rows count toxic_weight times."""
    size = 1 << BITS
    keep = (np.bincount(flat, minlength=size) >= min_rows)[flat]
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    flat = flat[keep]
    starts = np.concatenate([[0], ends[:-1]])
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    cost = np.full(size + 1, l1)
    cost[size] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * cost[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= cost[i], 0.0, w)

    for _ in range(epochs):
        for start, end, label in zip(starts, ends, labels, strict=True):
            i = np.append(flat[start:end], size)
            w = weights(i)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
            g *= toxic_weight if label else 1.0
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    at = np.flatnonzero(w[:size])
    return Model(at.astype(np.int32), w[at].astype(np.float32), float(w[size]))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """labels: doc_id, toxic; docs: doc_id, text."""
    text_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    some = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(train_rows) for y in (0, 1)]
    # at most 2 * train_rows rows of 12 bytes
    few = F.broadcast(some[0].union(some[1]).withColumnRenamed("doc_id", "__id"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, F.col("doc_id") == F.col("__id")).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "toxic")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "at": [features(t).tobytes() for t in pdf["text"]]})

    # label and coordinates of at most 2 * train_rows rows, as columns, in an order that is
    # independent of the one that drew them: by that one, the smaller class would come last
    shuffled = F.xxhash64("doc_id", F.lit("order"))
    got = texts.mapInPandas(run, "doc_id string, toxic int, at binary").select(shuffled.alias("order"), "doc_id", "toxic", "at").toArrow().sort_by([("order", "ascending"), ("doc_id", "ascending")])
    labels = got["toxic"].to_numpy()
    if len({*labels.tolist()}) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 35.0 if len(labels) and labels[0] else -35.0)
    held = [x.as_buffer() for x in got["at"]]
    ends = np.cumsum([len(x) // 4 for x in held])
    return ftrl(np.frombuffer(b"".join(held), dtype=np.int32), ends, labels)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the probability of a toxic text as an added column."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, bias = held.value.dense(), held.value.bias
        for s in texts:
            sums = np.array([w[features(t)].sum() for t in s], dtype=np.float64) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*kept, F.pandas_udf(run, T.DoubleType())(F.col("text").cast("string")).alias(name))


def held_out():
    """Rows that never teach: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
