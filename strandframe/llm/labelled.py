"""Bounded samples of labelled documents, and one-dimensional calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import fold


def sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int = 1500, max_chars: int = 32768, held_out_mod: int = 5) -> DataFrame:
    """doc_id, text, y, half: at most per_class documents of each label, those with the least hash of their id among those that fit.

    Rows whose crc32(doc_id) mod held_out_mod is 0 are never taken, nor are documents of more than max_chars characters. half (0 or 1) parts the
    sample, so that what is fitted on one half can be calibrated on the other. The sample's size doesn't follow the input's.
    """
    y = (
        labels.filter(fold(F.col("doc_id"), held_out_mod) != 0)
        .filter(F.col(target).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("y"))
    )
    order = [F.xxhash64(F.lit(target), "doc_id"), F.col("doc_id")]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, max_chars))
    y = y.join(texts.select("doc_id"), "doc_id", "left_semi")
    taken = y.filter("y = 0").orderBy(*order).limit(per_class).unionByName(y.filter("y = 1").orderBy(*order).limit(per_class))
    found = texts.join(F.broadcast(taken), "doc_id")  # 2 * per_class ids at most
    return found.orderBy(*order, "text").limit(2 * per_class).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, the constant last, of a logistic regression on a few standardised columns, by Newton's method; classes count alike."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    penalty = ridge * np.append(np.ones(x.shape[1] - 1), 0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + penalty * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


class Calibration:
    """Standardise, then logistic: P(label 1)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-12
        self.w = logistic((x - self.mean) / self.scale, y, ridge)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
