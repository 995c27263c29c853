"""Labels beside documents, and small fits on the driver from bounded numbers of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def one_label(labels: DataFrame, column: str, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, label`` with one row per id: 1 if at least half of its known labels are 1."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("label")).dropna()
    return known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def bounded_sample(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, the same for the same ids."""
    return rows.orderBy(F.xxhash64(key, F.lit(n)), key).limit(n)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps on standardised columns; only a constant without both labels."""
    n, dim = x.shape
    if not n or y.min() == y.max():
        share = float(y.mean()) if n else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(dim), float(np.log(share / (1 - share)))
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1
    z = np.c_[(x - mean) / spread, np.ones(n)]
    penalty = ridge * np.eye(dim + 1)
    penalty[-1, -1] = 0
    w = np.zeros(dim + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(
            (z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(dim + 1),
            z.T @ (y - p) - penalty @ w,
        )
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    scaled = w[:-1] / spread
    return scaled, float(w[-1] - scaled @ mean)


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence, by pooling neighbours that are out of order."""
    levels: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        levels.append([v, w, 1])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            v2, w2, n2 = levels.pop()
            v1, w1, n1 = levels.pop()
            levels.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([v for v, _, _ in levels], [int(n) for _, _, n in levels]) if levels else value
