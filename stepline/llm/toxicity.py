"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram in the whole text. Spark counts features by label;
the log ratio of their smoothed shares scales them, the most telling ones are kept, and
logistic regression is fitted on the scaled features of a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepline.llm.ngrams import grams
from stepline.llm.scratch import Scratch, some_rows

ORDERS, BITS = (3, 4, 5), 20
SAMPLE_ROWS = 10_000  # labelled texts that the classifier is fitted on
FEATURES = 8_192
SMOOTH, MIN_TEXTS = 1.0, 3
RIDGE, ROUNDS = 1e-4, 200


@dataclass
class Model:
    """slot: the feature number of each bucket (-1: none); weight per feature; bias."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a text."""
    parts = [np.unique(g) for g in grams(text, ORDERS, BITS)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for label, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([label.as_py()], pa.int32()), pa.array([buckets(text).astype(np.int32)], pa.list_(pa.int32()))], names=["label", "on"])


def logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps with momentum; rows and cols are the features that are on."""
    n, d = len(labels), len(scale)
    x = scale[cols]
    w, b = np.zeros(d), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(rows, x * w[cols], n) + b
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g, gb = np.bincount(cols, x * off[rows], d) / n + RIDGE * w, off.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, rate = np.sqrt(1 - 0.99**t) / (1 - 0.9**t), 0.03 / np.sqrt(1 + t / 50)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the texts of labelled ids; at most sample_rows labels, by hash of the id, are used.

    Null labels are passed over. Without any labelled text the model gives every text one half.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    chosen = scratch.keep(some_rows(known, sample_rows, "__id", "label"), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__id"))
    on = scratch.keep(texts.select("label", "text").mapInArrow(_present, "label int, on array<int>"), "on")
    size = on.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    pos, neg = float(size["pos"]), float(size["n"] - size["pos"])
    counts = on.select("label", F.explode("on").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").alias("p")).where(F.col("n") >= MIN_TEXTS)
    p, q = F.col("p") + SMOOTH, F.col("n") - F.col("p") + SMOOTH
    ratio = F.log(p / (pos + 2 * SMOOTH)) - F.log(q / (neg + 2 * SMOOTH))
    ranked = counts.select("bucket", ratio.alias("r"), F.abs(ratio / F.sqrt(1 / p + 1 / q)).alias("z")).orderBy(F.desc("z"), "bucket").limit(FEATURES)
    top = scratch.keep(ranked.select("bucket", "r"), "top").collect()
    slot = np.full(1 << BITS, -1, np.int16)
    slot[[t.bucket for t in top]] = np.arange(len(top))
    kept = on.mapInArrow(partial(_slots, slot=slot), "label int, on array<int>")
    rows = kept.toArrow()
    label = rows.column("label").to_numpy().astype(float)
    if not len(label):
        return Model(slot, np.zeros(0), 0.0)
    lists = rows.column("on").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    scale = np.array([t.r for t in top])
    weight, bias = logistic(row, lists.values.to_numpy(), scale, label)
    return Model(slot, weight * scale, bias)


def _slots(batches: Iterator[pa.RecordBatch], slot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = []
        for on in b.column(1):
            s = slot[np.array(on.as_py(), np.int64)]
            lists.append(s[s >= 0].astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["label", "on"])


def probability(text: str | None, model: Model) -> float:
    found = [s[s >= 0] for s in (model.slot[g] for g in grams(text, ORDERS, BITS))]
    on = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    z = model.weight[on].sum() + model.bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 from the whole text alone; null and empty texts get the bias's.

    A column named like out is replaced; repeated rows score alike; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.slot, model.weight, model.bias))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        here = Model(*shared.value)
        return pd.Series([probability(t, here) for t in texts], dtype=float)

    return docs.withColumn(out, of(F.col(text_col)))
