"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a row of transformed statistics (``NAMES``). Every class gets a mean and a
covariance shrunk towards its diagonal; a text's score is the logistic of the difference of the two
Mahalanobis log densities. The class moments are sums that Spark combines on the map side, so any
number of labelled rows is used and the driver sees one row per class.

Defined results: a null or empty text has the statistics of no words and is scored like any other;
rows with a null label do not train; repeated label rows count once, labels that contradict each
other for one id each count; a repeated document trains as often as it occurs. With no labelled
rows every score is 0.5, with one class it is that class's label (0 or 1). Only the named id, text
and label columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

NAMES = (
    "log_words", "word_length", "word_length_spread", "symbols", "capitals", "digits", "stops",
    "shouts", "distinct_words", "top_word", "repeated_lines", "line_words",
)
SHRINKAGE = 0.02  # share of the diagonal in each class covariance
RIDGE = 1e-3  # smallest variance, keeps constant statistics invertible
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_{}[]\\=+", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``NAMES``."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    size = max(1, len(raw))
    words = text.split()
    n = len(words)
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        math.log1p(n),
        math.log1p(float(lengths.mean())),
        math.log1p(float(lengths.std())),
        math.sqrt(float(counts[_SYMBOLS].sum()) / size),
        math.sqrt(float(counts[65:91].sum()) / size),
        math.sqrt(float(counts[48:58].sum()) / size),
        math.sqrt(min(1.0, float(counts[46]) / max(1, n))),
        math.sqrt(float(counts[33]) / size),
        math.log1p(len(seen)) / math.log1p(n) if n else 1.0,
        math.sqrt(max(seen.values()) / n) if n else 0.0,
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        math.log1p(n / max(1, len(lines))),
    ]


@arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))


def features(text: Column) -> Column:
    """The statistics of a text column as an array, computed in Arrow batches."""
    return _statistics(text)


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, half its log determinant."""

    priors: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    half_dets: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.means):  # no class, or one alone: what is known without densities
            return np.full(len(rows), float(self.priors[0]))
        logs = []
        for prior, mean, factor, half_det in zip(self.priors, self.means, self.factors, self.half_dets, strict=True):
            z = (rows - mean) @ factor.T
            logs.append(prior - half_det - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(labelled: DataFrame, features_col: str, label_col: str, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on rows of statistics with a 0/1 label. The driver receives one row per class."""
    d = len(NAMES)
    x = F.col(features_col)
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    sums += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = labelled.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), *sums
    )
    classes = {r["label"]: r for r in rows.collect()}
    if len(classes) < 2:
        constant = float(next(iter(classes))) if classes else 0.5
        return Discriminant(np.array([constant]), *[np.zeros(0)] * 3)
    total = sum(r["n"] for r in classes.values())
    priors, means, factors, half_dets = [], [], [], []
    for label in (0, 1):
        row = classes[label]
        mean = np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] / row["n"] - mean[i] * mean[j]
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + RIDGE * np.eye(d)
        lower = np.linalg.cholesky(cov)
        priors.append(math.log(row["n"] / total))
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        half_dets.append(float(np.log(np.diag(lower)).sum()))
    return Discriminant(np.array(priors), np.array(means), np.array(factors), np.array(half_dets))


def scorer(model: Discriminant):
    """A column function from statistics to the score of class 1."""

    @arrow_udf(T.DoubleType())
    def score(rows: pa.Array) -> pa.Array:
        matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return pa.array(model.scores(matrix) if len(rows) else [], pa.float64())

    return score


def train(stats: DataFrame, labels: DataFrame, id_col: str, features_col: str, label_col: str) -> Discriminant:
    """Fit on the statistics of the documents that have a label. Joins narrow rows, never texts."""
    wanted = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where(
        "_label is not null").distinct()
    return fit(
        stats.select(F.col(id_col).alias("_id"), F.col(features_col).alias("_x")).join(wanted, "_id"), "_x", "_label"
    )


def predict(stats: DataFrame, model: Discriminant, features_col: str) -> DataFrame:
    """``stats`` without the statistics, with ``score`` and ``predicted``."""
    out = stats.withColumn("score", scorer(model)(F.col(features_col))).drop(features_col)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
