"""Quality of a text: a support vector machine on naive Bayes features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import seeded_rank, written

#: Byte trigrams are told apart by so many hash values.
FEATURES = 1 << 18
#: Bound of the training sample, in rows.
SAMPLE_ROWS = 8000
#: Share of the sample that only fits the curve from margin to probability.
HELD = 4
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 12


def trigrams(text: str | None) -> np.ndarray:
    """The different hashed byte trigrams of a text, ascending; spaces stand around the text."""
    if not text:
        return np.empty(0, np.int32)
    b = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return np.unique(((h * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int32))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of the smoothed share of good texts with a feature over that of the others."""
    seen = np.zeros((2, FEATURES))
    for row, good in zip(rows, y):
        seen[good, row] += 1
    n = np.bincount(y, minlength=2)[:, None]
    share = (seen + SMOOTHING) / (n + 2 * SMOOTHING)
    return np.where(seen.any(0), np.log(share[1] / share[0]), 0.0)


def _scaled(row: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Feature values of a text, of length 1 together, so that long texts weigh no more."""
    value = ratio[row]
    return value, float(np.sqrt(value @ value)) or 1.0


def dual_coordinate_descent(
    rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 4
) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model: one dual variable per text, each in turn set to its best value
    between 0 and its cost. Classes share the total cost evenly. Returns weights (already times the
    ratios) and the bias."""
    rng = np.random.default_rng(seed)
    sign = np.where(y == 1, 1.0, -1.0)
    limit = cost * len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))[y]
    values = []
    for row in rows:
        value, length = _scaled(row, ratio)
        values.append(value / length)
    curvature = np.array([v @ v for v in values]) + 1
    alpha, w, bias = np.zeros(len(y)), np.zeros(FEATURES), 0.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            row, value = rows[i], values[i]
            gradient = sign[i] * (w[row] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / curvature[i], 0.0), limit[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[row] += step * value
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, text: str | None) -> float:
        row = trigrams(text)
        value, length = _scaled(row, self.ratio)
        return float(self.weights[row] @ value) / length + self.bias

    def probability(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.offset, -30, 30))))


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of margins, by gradient steps from (2, 0)."""
    a, b = 2.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        a -= 0.5 * float(np.mean((p - y) * margin))
        b -= 0.5 * float(np.mean(p - y))
    return max(a, 1e-3), b


@F.pandas_udf(T.BinaryType())
def _packed_trigrams(texts: pd.Series) -> pd.Series:
    return pd.Series([trigrams(t).tobytes() for t in texts], dtype=object)


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs(doc_id, text), labels(doc_id, quality) → a model; None without labels of both classes.

    At most SAMPLE_ROWS labels, in a fixed pseudo-random order, are learned from. Their small table
    meets the documents in a join, and the driver gets the trigram numbers of those texts.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    allowed = docs.select("doc_id").distinct()
    some = written(known.join(allowed, "doc_id").orderBy(seeded_rank(F.col("doc_id"), 31), "doc_id", "y").limit(SAMPLE_ROWS), "quality-labels")
    sample = docs.join(some, "doc_id").select("doc_id", "y", _packed_trigrams("text").alias("t")).toPandas()
    # One label may meet several rows that repeat an identifier.
    sample = sample.sort_values(["doc_id", "y", "t"]).head(2 * SAMPLE_ROWS)
    rows, y = [np.frombuffer(t, np.int32) for t in sample["t"]], sample["y"].to_numpy(np.int64)
    if len(np.unique(y)) < 2:
        return None
    held = np.random.default_rng(6).permutation(len(y)) % HELD == 0
    learn = held if len(np.unique(y[~held])) < 2 else ~held
    own = [r for r, k in zip(rows, learn) if k]
    ratio = log_count_ratios(own, y[learn])
    model = Model(ratio, *dual_coordinate_descent(own, y[learn], ratio))
    margins = np.array([model.weights[r] @ _scaled(r, ratio)[0] / _scaled(r, ratio)[1] + model.bias for r in rows])
    model.slope, model.offset = _curve(margins[held], y[held].astype(float))
    model.ratio, model.weights = ratio.astype(np.float32), model.weights.astype(np.float32)
    return model


def scorer(model: Model | None) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([0.5 if model is None else model.probability(t) for t in texts], dtype=float)

    return score


def with_quality(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with a column `quality_score` from 0 to 1, learned from labels(doc_id, quality) and the
    rows of `df` for which `learn` holds.

    Each byte trigram of the whole text is there or not; its value is the log-count ratio of the
    classes, values of a text are scaled to length 1, and a linear hinge-loss model is fitted to them
    by dual coordinate descent. A quarter of the sample is left for the curve from margin to score.

    Defined results: null and empty texts have no trigram, so the bias decides; labels that are null
    or not 0 or 1 teach nothing; an identifier with both labels counts for both; without labels of
    both classes every score is 0.5; rows come back as often as they are given.
    """
    docs = df.where(learn).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return df.withColumn("quality_score", scorer(fitted(docs, labels))(F.col(text_col)))
