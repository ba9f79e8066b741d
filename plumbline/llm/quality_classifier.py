"""Quality scores by regularised quadratic discriminant analysis.

Each whole text becomes a vector of transformed statistics. For both label values the mean and a
shrunken covariance of these vectors are kept, with its Cholesky factor; a text's score comes from the
difference of the two Gaussian log-densities, that is, of the two Mahalanobis distances and factors'
log-determinants, and of the log-priors.

Moments are sums, taken by Spark over all labelled rows; only those sums reach the driver.

Defined results: a null or empty text has the statistics of an empty text and a score like any other.
Labels other than 0 and 1, and null ones, teach nothing; a document with several labels counts for each.
If a label value has no rows, every score is the share of ones among the labelled rows (0.5 without any).
Repeated rows are scored alike and each teach once; texts of any length are measured whole; an empty table has no scores.
A row with a null id is held out and scored. Columns beyond those named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frees

#: Share of the pooled, diagonal target in a class covariance, and what is added to each variance.
SHRINKAGE = 0.1
RIDGE = 1e-3
#: Log-density differences are divided by this, as the statistics are far from Gaussian.
TEMPERATURE = 4.0
THRESHOLD = 0.3

STATISTICS = (
    "log_words",
    "log_word_length",
    "word_length_spread",
    "upper_share",
    "mark_share",
    "pipe_share",
    "exclamation_share",
    "loud_words",
    "distinct_share",
    "top_word_share",
    "adjacent_repeats",
    "repeated_lines",
    "letter_share",
    "closed_lines",
)
_SYMBOLS = "#*$%&<>"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_CLOSED = (".", "!", "?", ":", ";", '"', "”", "’", ")", "…")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of `STATISTICS`."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = sum(map(len, words))
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    root = np.sqrt
    return [
        float(np.log1p(n)),
        float(np.log(size / n)),
        float(lengths.std() / (size / n)),
        float(root(len(_UPPER.findall(text)) / size)),
        float(root(sum(map(text.count, _SYMBOLS)) / size)),
        float(root(text.count("|") / size)),
        float(root(text.count("!") / size)),
        float(root(sum(1 for w in words if w[-1] in "!#*$%&") / n)),
        float(np.log(len(counts) / n) / np.log1p(n)),
        float(root(max(counts.values()) / n)),
        float(root(sum(map(str.__eq__, words, words[1:])) / n)),
        float(root(1 - len(set(lines)) / len(lines))) if lines else 0.0,
        float(root(sum(map(str.isalpha, words)) / n)),
        float(root(sum(1 for x in lines if x.rstrip().endswith(_CLOSED)) / len(lines))) if lines else 0.0,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
@frees
def document_statistics(texts: pa.Array) -> pa.Array:
    """`statistics` of each text of a column."""
    return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # inverse of the covariance's Cholesky factor
    log_weight: float  # log-prior less half the log-determinant


@dataclass(frozen=True)
class QualityModel:
    zero: Gaussian | None
    one: Gaussian | None
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.zero is None or self.one is None:
            return np.full(len(x), self.prior)
        density = [
            g.log_weight - 0.5 * np.square((x - g.mean) @ g.factor.T).sum(axis=1) for g in (self.zero, self.one)
        ]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -500, 500)))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> QualityModel:
    """Fit from rows (statistics array<double>, quality): one aggregate of first and second moments."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("statistics")[i] for i in range(d)]
    rows = (
        labelled.where(F.col("quality").isin(0, 1))
        .groupBy("quality")
        .agg(F.count(F.lit(1)), *[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i, j in pairs])
        .collect()
    )
    moments = {}
    for r in rows:
        n, first = r[1], np.array(r[2 : 2 + d], float)
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, r[2 + d :], strict=True):
            second[i, j] = second[j, i] = v
        mean = first / n
        moments[int(r[0])] = (n, mean, second / n - np.outer(mean, mean))
    total = sum(m[0] for m in moments.values())
    prior = moments[1][0] / total if 1 in moments else (0.0 if total else 0.5)
    if len(moments) < 2:
        return QualityModel(None, None, prior)
    pooled = sum(n * np.diag(c) for n, _, c in moments.values()) / total
    made = []
    for k in (0, 1):
        n, mean, covariance = moments[k]
        shrunk = (1 - shrinkage) * covariance + np.diag(shrinkage * pooled + ridge)
        factor = np.linalg.cholesky(shrunk)
        made.append(Gaussian(mean, np.linalg.inv(factor), float(np.log(n / total) - np.log(np.diag(factor)).sum())))
    return QualityModel(made[0], made[1], prior)


def quality_score(stats: Column, model: QualityModel) -> Column:
    """Score (0 to 1, higher: label 1 likelier) for a column of statistics."""

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        x = np.asarray(rows.flatten(), float).reshape(len(rows), len(STATISTICS))
        return pa.array(model.scores(x), pa.float64())

    return score.asNondeterministic()(stats)  # so that Catalyst doesn't evaluate it once for each use
