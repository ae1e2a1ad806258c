"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a naive Bayes classifier over hashed character
n-grams tells the languages with a one from those with a zero. A text is given to the codeword
with the least loss, bits weighted by how well they did in training, and flagged as ambiguous
where another codeword is almost as near.
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
from stepline.llm.scratch import Scratch

ORDERS, BITS = (1, 2, 3), 15
SAMPLE_ROWS = 2_500  # texts of each language that the classifiers are fitted on, about
SMOOTH = 0.5
TEMPER = 6.0  # the most that a mean ratio is multiplied by; it grows as the square root of the n-grams up to there
AMBIGUOUS = 2.0  # a difference of weighted loss between the two nearest codewords below this is flagged

UNKNOWN = "und"


@dataclass
class Model:
    """languages; code (languages x bits, -1 or 1); weights (buckets x bits); trust per bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def codewords(n: int, seed: int = 5, tries: int = 300) -> np.ndarray:
    """A code for n languages: all distinct splits of up to five; beyond, the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        columns = [[1 if i == 0 or not (k >> (i - 1)) & 1 else -1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(columns, np.int8).T
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(tries):
        code = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        apart = (code.shape[1] - code.astype(int) @ code.T) // 2
        least = int(apart[~np.eye(n, dtype=bool)].min())
        if least > far and (abs(code.sum(axis=0)) < n).all():
            best, far = code, least
    return best


def _counts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((n, 1 << BITS), np.int64)
    for b in batches:
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for g in grams(text, ORDERS, BITS):
                total[k] += np.bincount(g, minlength=1 << BITS)
    for k in range(n):
        on = np.flatnonzero(total[k])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), k, np.int32)), pa.array(on.astype(np.int32)), pa.array(total[k][on])], names=["k", "bucket", "n"])


def margins(text: str | None, weights: np.ndarray) -> np.ndarray:
    """The mean log-likelihood ratio of the text's n-grams under each bit's classifier, tempered."""
    total, n = np.zeros(weights.shape[1]), 0
    for g in grams(text, ORDERS, BITS):
        total += weights[g].sum(axis=0, dtype=np.float64)
        n += len(g)
    return total / max(n, 1) * min(n**0.5, TEMPER)


def _wrong(batches: Iterator[pa.RecordBatch], weights: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    off = np.zeros(code.shape[1], np.int64)
    for b in batches:
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            off += margins(text, weights) * code[k] <= 0
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(off), dtype=np.int32)), pa.array(off)], names=["bit", "off"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the languages in docs from about sample_rows texts of each, chosen by hash of the id.

    Rows with a null or empty text, or a null language, are passed over. One language is always
    predicted; with none every text is undetermined. The counts that reach the driver are at most
    languages x 2**BITS, and the broadcast table of shares has a row per language.
    """
    scratch = Scratch(docs.sparkSession, "langid")
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    code = codewords(len(names))
    if not names:
        return Model([], code, np.zeros((1 << BITS, 1), np.float32), np.ones(1))
    table = docs.sparkSession.createDataFrame([(k, name, min(1.0, sample_rows / sizes[name])) for k, name in enumerate(names)], "k int, name string, share double")
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    part = known.join(F.broadcast(table), F.col("lang") == F.col("name")).where(draw < F.col("share")).select("k", "text")
    sample = scratch.keep(part, "sample")
    counted = sample.mapInArrow(partial(_counts, n=len(names)), "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), 1 << BITS))
    for batch in scratch.keep(counted, "counts").toArrow().to_batches():
        k, bucket, n = (batch.column(i).to_numpy() for i in range(3))
        counts[k, bucket] = n
    share = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
    weights = np.zeros((1 << BITS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, zero = code[:, bit] > 0, code[:, bit] < 0
        if zero.any():
            weights[:, bit] = np.log(share[one].mean(axis=0)) - np.log(share[zero].mean(axis=0))
        else:
            weights[:, bit] = 1.0
    off = np.zeros(code.shape[1])
    for r in sample.mapInArrow(partial(_wrong, weights=weights, code=code), "bit int, off long").groupBy("bit").agg(F.sum("off").alias("off")).collect():
        off[r.bit] = r.off
    error = (off + 1) / (sample.count() + 2)
    trust = np.maximum(np.log((1 - error) / error), 0.1)
    return Model(names, code, weights, trust / trust.sum())


def decode(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(language, score, ambiguous) of a text."""
    if not model.languages or text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    loss = np.logaddexp(0, -margins(text, model.weights) * model.code) @ model.trust
    best = int(loss.argmin())
    near = np.exp(-(loss - loss[best]) * len(model.trust))
    second = np.delete(loss, best).min() - loss[best] if len(loss) > 1 else np.inf
    return model.languages[best], float(1 / near.sum()), bool(second < AMBIGUOUS)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct of lang (``und`` for null and for texts without letters), score and ambiguous.

    Only the text is looked at, whole; repeated rows are decided alike, no rows give no rows, and
    a column named like out is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.code, model.weights, model.trust))

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        here = Model(*shared.value)
        return pd.DataFrame([decode(t, here) for t in texts], columns=["lang", "score", "ambiguous"])

    return docs.withColumn(out, of(F.col(text_col)))
