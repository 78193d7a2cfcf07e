"""Fits: small ones in NumPy on the driver, on bounded samples, and others from sums over all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit takes at most: those whose hashed doc_id is least.
SAMPLE_ROWS = 12_000
#: Rows of these remainders of crc32(doc_id as text) modulo 5 are never learned from.
HELD_OUT = 0


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == HELD_OUT


def known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all labelled documents to learn from; of a doc_id's labels the largest."""
    own = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out())
    return own.groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` of the known documents."""
    return known(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, weights: np.ndarray | None = None, steps: int = 50) -> np.ndarray:
    """Coefficients of an L2-penalised logistic regression by Newton's method (no intercept of its own)."""
    w = np.zeros(x.shape[1])
    s = np.ones(len(y)) if weights is None else weights
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (s * (p - y)) + ridge * len(y) * w
        hessian = (x * (s * p * (1 - p))[:, None]).T @ x + (ridge * len(y) + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What rows add to a logistic fit at w: their number, loss, gradient and the upper triangle of the Hessian."""
    m = x @ w
    p = sigmoid(m)
    hessian = (x * (p * (1 - p))[:, None]).T @ x
    return np.concatenate([[len(y), (np.logaddexp(0, m) - y * m).sum()], x.T @ (p - y), hessian[np.triu_indices(len(w))]])


def newton(total: Callable[[np.ndarray], np.ndarray], w: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Coefficients as of `logistic`, from `sums` over all rows, which total(w) gives; a step that raises the loss is halved."""

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        found, k = total(w), len(w)
        penalty, hessian = ridge * found[0], np.zeros((k, k))
        hessian[np.triu_indices(k)] = found[2 + k :]
        hessian += np.triu(hessian, 1).T
        return found[1] + penalty / 2 * (w @ w), found[2 : 2 + k] + penalty * w, hessian + (penalty + 1e-9) * np.eye(k)

    here = at(w)
    for _ in range(steps):
        step = np.linalg.solve(here[2], here[1])
        there = at(w - step)
        while there[0] > here[0] + 1e-9 * abs(here[0]) and np.abs(step).max() >= 1e-8:
            step = step / 2
            there = at(w - step)
        w, here = w - step, there
        if np.abs(step).max() < 1e-8:
            break
    return w
