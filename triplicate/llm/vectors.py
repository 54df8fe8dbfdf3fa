"""Vectors of a table, checked and in matrices, and exact nearest ones among candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(embeddings: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding (doubles) of rows whose vector is there, whole and finite, and unless ``zero`` not all zero.

    Vectors of several widths are compared as if the shorter ones ended in zeros.
    """
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    return v if zero else v.where(F.exists("embedding", lambda x: x != 0))


def matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Vectors as rows of a matrix as wide as the widest, or ``width``; shorter ones end in zeros."""
    rows = column.to_numpy()
    sizes = {len(r) for r in rows}
    wide = width or max(sizes, default=1)
    if sizes <= {wide} and len(rows):
        return np.stack(rows).astype(np.float64)
    out = np.zeros((len(rows), wide))
    for row, values in zip(out, rows, strict=True):
        row[: len(values)] = values
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, up to rounding; infinite where they overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.maximum(np.where(np.isnan(out), np.inf, out), 0)


def first_rows(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Indices of the rows that repeat no earlier row's id and vector."""
    seen: dict[tuple[int, bytes], int] = {}
    for i, (k, row) in enumerate(zip(ids.tolist(), x, strict=True)):
        seen.setdefault((k, row.tobytes()), i)
    return np.fromiter(seen.values(), np.int64, len(seen))


def most_alike(ids: np.ndarray) -> int:
    """How many rows share one id at most."""
    return int(np.unique(ids, return_counts=True)[1].max(initial=1))


def smallest(values: np.ndarray, k: int, slack: float) -> list[np.ndarray]:
    """For each row, the columns whose value is within ``slack`` of the k-th smallest or below it."""
    if values.shape[1] <= k:
        return [np.arange(values.shape[1])] * len(values)
    kth = np.partition(values, k - 1, axis=1)[:, k - 1]
    return [np.flatnonzero(row <= bound) for row, bound in zip(values, kth + slack, strict=True)]
