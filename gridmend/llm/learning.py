"""Fitting on a bounded sample of labelled rows: the sample, and a logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def remainder(mod: int):
    """crc32 of the doc_id as text, modulo ``mod``; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, train) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents for which ``train`` holds, written once.

    The rows with the least hashes of their ids are taken, so the sample is the same on each run. A document with
    contradictory labels counts as 1; of repeated documents with one id the least text is taken.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # the documented bound of the fit
    met = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")  # at most ``rows``
    return written(met.groupBy("doc_id", "y").agg(F.min("text").alias("text")), f"labelled-{label}")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights (the intercept last) of a ridge logistic regression by Newton steps; ``prior``: what they shrink to."""
    x = np.column_stack([x, np.ones(len(x))])
    base = np.zeros(x.shape[1]) if prior is None else np.append(prior, 0.0)
    w, pull = base.copy(), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(60):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + pull * (w - base)
        hess = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The score at which most of the sample is told apart rightly; halfway between two scores."""
    order = np.argsort(p)
    s, t = p[order], y[order]
    right = np.concatenate(([t.sum()], t.sum() + np.cumsum(1 - 2 * t)))
    i = int(np.argmax(right))
    lo, hi = (s[i - 1] if i else 0.0), (s[i] if i < len(s) else 1.0)
    return float((lo + hi) / 2)
