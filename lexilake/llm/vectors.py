"""What the vector operators share: vectors of whole numbers, exact products of blocks, and running bests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.llm.common import whole_number

#: Stands for "no score yet": below every score, and its negative is a long too.
NONE = -(2**63 - 1)


def whole_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """``id``, ``v`` (array<int> of floor(scale * x)) and, if asked for, ``label``: one row for each id that takes part.

    Rows with a null id, vector, label or component, or a component that is not
    finite, take no part; of rows that share an id the smallest counts. Shorter
    vectors count as if filled up with zeros. A vector whose scaled length is 2^31
    or more raises an error, since its products need not fit in a long.
    """
    real = lambda c: c.cast("double")
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(real(c)) & (F.abs(real(c)) < float("inf")))
    labels = [whole_number(rows, label_col).alias("label")] if label_col else []
    clean = rows.select(whole_number(rows, id_col).alias("id"), F.col(vector_col).alias("x"), *labels).dropna(subset=["id", "x"] + ["label"] * bool(labels)).where(whole)
    own = clean.groupBy("id").agg(F.min(F.struct(*clean.columns[1:])).alias("own")).select("id", "own.*")
    scaled = own.withColumn("x", F.transform("x", lambda c: F.floor(real(c) * scale)))
    length = F.aggregate("x", F.lit(0.0), lambda s, c: s + real(c) * real(c))
    fits = F.when(length < 2.0**62, F.col("x").cast("array<int>")).otherwise(F.raise_error(F.concat(F.lit("vector too long for whole products: id "), F.col("id").cast("string"))))
    return scaled.select("id", *(["label"] if labels else []), fits.alias("v"))


def squared_length() -> Column:
    return F.aggregate("v", F.lit(0).cast("bigint"), lambda s, c: s + c.cast("bigint") * c.cast("bigint"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of int32, filled up with zeros."""
    size, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int32)
    out[np.arange(width) < size[:, None]] = flat
    return out


def unpacked(blob: pa.Scalar, kind: type, width: int | None = None) -> np.ndarray:
    flat = np.frombuffer(blob.as_buffer(), kind)
    return flat.reshape(-1, width) if width else flat


def products(q: np.ndarray, x: np.ndarray, longest: float) -> np.ndarray:
    """Inner products as whole numbers. ``longest``: no product of two lengths is above it, so below 2^53 doubles are exact."""
    kind = np.float64 if longest < 2**53 else np.int64
    return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)


class Best:
    """The best ``k`` of each row so far: highest score, then smallest id."""

    def __init__(self, rows: int, k: int):
        self.scores, self.ids = np.full((rows, k), NONE), np.full((rows, k), 2**63 - 1)

    @property
    def last(self) -> np.ndarray:
        """Each row's k-th score; nothing strictly beneath it can enter."""
        return self.scores[:, -1]

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in a matrix of scores of ``rows`` against ``ids``; NONE marks what does not count."""
        k = self.scores.shape[1]
        floor = np.maximum(self.last[rows], NONE + 1)
        hits = scores >= floor[:, None]
        if scores.shape[1] > k and hits.sum() > 4 * k * len(rows):
            floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
            hits = scores >= floor[:, None]
        i, j = np.nonzero(hits)
        if not len(i):
            return
        own = np.unique(i)
        at = rows[own]
        row = np.concatenate([np.repeat(own, k), i])
        score, found = np.concatenate([self.scores[at].ravel(), scores[i, j]]), np.concatenate([self.ids[at].ravel(), ids[j]])
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = rank < k
        self.scores[rows[row[keep]], rank[keep]] = score[keep]
        self.ids[rows[row[keep]], rank[keep]] = found[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, score and id of all that is held."""
        i, j = np.nonzero(self.scores > NONE)
        return i, self.scores[i, j], self.ids[i, j]
