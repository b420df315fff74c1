"""Quality classifier: a regularised quadratic discriminant.

Document statistics are taken to a scale on which they are roughly normal (logs
of counts, logits of shares). Each class has a mean and a covariance shrunk
towards its own diagonal and the pooled one; a score is the difference of the two
log densities from Mahalanobis distances with Cholesky factors worked out once on
the driver. The driver gets sums only, whose size is that of the statistics.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.llm.common import written

FEATURES = (
    "log_words", "word_length", "log_lines", "line_length", "upper", "digit", "symbol", "mark", "accent",
    "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "squeeze", "shouting", "short_words",
)
#: Weight of the class's own covariance, of the pooled one, and of its diagonal.
SHRINK = (0.7, 0.2, 0.1)
#: Least variance of a statistic, which keeps the factors defined where one is constant.
RIDGE = 0.02
_upper = re.compile(rb"[A-Z]")
_drop = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>{}[]\\^~_=@",
    "mark": b"!?.,;:\"'()-",
    "accent": bytes(range(128, 256)),
}


def _logit(share: float, n: int) -> float:
    p = (share * n + 0.5) / (n + 1)
    return math.log(p / (1 - p))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; the empty text has defined ones too."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n, size, chars = len(words), len(raw), sum(map(len, words))
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    share = {k: (size - len(raw.translate(None, v))) / max(size, 1) for k, v in _drop.items()}
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(n),
        math.log1p(chars / max(n, 1)),
        math.log1p(len(lines)),
        math.log1p(n / max(len(lines), 1)),
        *(_logit(share[k], size) for k in ("upper", "digit", "symbol", "mark", "accent")),
        _logit(len(count) / max(n, 1), n),
        _logit(pairs / max(n - 1, 1), max(n - 1, 0)),
        _logit(len(set(lines)) / max(len(lines), 1), len(lines)),
        _logit(max(count.values(), default=0) / max(n, 1), n),
        math.log((len(zlib.compress(raw, 1)) + 1) / (size + 1)),
        _logit(sum(c for w, c in count.items() if len(w) > 1 and w.isupper()) / max(n, 1), n),
        _logit(sum(c for w, c in count.items() if len(w) < 3) / max(n, 1), n),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``x`` (array of the statistics, in the order of FEATURES) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, "x"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """For class 0 and 1: log prior minus half the log determinant, mean, and inverse Cholesky factor."""

    constant: tuple[float, float]
    mean: tuple[np.ndarray, np.ndarray]
    factor: tuple[np.ndarray, np.ndarray]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        of = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for c, m, f in zip(self.constant, self.mean, self.factor)]
        return of[1] - of[0]


def fit(labelled: DataFrame, x_col: str = "x", label_col: str = "label", shrink: tuple[float, float, float] = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """Fit to rows of statistics and a label 0 or 1, from sums that the executors make.

    Rows with a null label or statistics do not count. A class without rows gets
    the pooled mean and covariance, so that only the prior tells them apart.
    """
    d = len(FEATURES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col(x_col)
    sums = labelled.where(F.col(label_col).isin(0, 1) & x.isNotNull()).groupBy(F.col(label_col).alias("label")).agg(
        F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(d)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in upper]
    )
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in sums.collect():  # two rows
        k = int(row["label"])
        n[k], s[k] = row["n"], [row[f"s{i}"] for i in range(d)]
        for i, j in upper:
            p[k, i, j] = p[k, j, i] = row[f"p{i}_{j}"]
    total = max(n.sum(), 1.0)
    centre = s.sum(axis=0) / total
    spread = [p[k] - np.outer(s[k], s[k]) / max(n[k], 1.0) for k in (0, 1)]
    pooled = (spread[0] + spread[1]) / total
    constant, mean, factor = [], [], []
    for k in (0, 1):
        own = spread[k] / n[k] if n[k] else pooled
        a, b, c = shrink
        cov = a * own + b * pooled + c * np.diag(np.diag(own)) + ridge * np.eye(d)
        low = np.linalg.cholesky(cov)
        mean.append(s[k] / n[k] if n[k] else centre)
        factor.append(np.linalg.inv(low))
        constant.append(float(math.log((n[k] + 1) / (total + 2)) - np.log(np.diag(low)).sum()))
    return Discriminant(tuple(constant), tuple(mean), tuple(factor))


def score(statistics_of: DataFrame, model: Discriminant, x_col: str = "x") -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` to rows of statistics."""
    others = [c for c in statistics_of.columns if c != x_col]
    at = statistics_of.columns.index(x_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(at).to_pylist(), float).reshape(-1, len(FEATURES))
            odds = np.clip(model.log_odds(x), -500, 500)
            p = 1 / (1 + np.exp(-odds))
            keep = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != x_col]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*others, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {statistics_of.schema[c].dataType.simpleString()}" for c in others)
    return statistics_of.mapInArrow(run, f"{kinds}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Score every row of ``docs`` with a discriminant fitted to the labelled rows where ``train`` (on ``id_col``) holds.

    Null texts are scored as the empty text. An id with several labels trains with
    each of them once. Without labels the score is one half for all.
    """
    known = written(document_statistics(docs, id_col, text_col), "statistics")
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("label")).distinct()
    return score(known, fit(known.where(train).join(marks, F.col(id_col) == F.col("_id"))))
