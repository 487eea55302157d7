"""What the two trained operators share: their labelled sample and a small logistic fit."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_and_text


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out.  A null id is held out too."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5, F.lit(0))


def as_text(text: str | bytes) -> str:
    return text if isinstance(text, str) else text.decode()


def as_bytes(text: str | bytes) -> bytes:
    return text.encode() if isinstance(text, str) else text


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """Texts, as UTF-8, and labels of up to ``per_class`` rows of each label, in an order by hash,
    from rows that are not held out.  ``most_bytes`` bounds each text that is sampled:
    longer ones are left out of the fit (not of scoring).  The driver gets the ids first and
    then the texts of the sample alone, at most ``2 * per_class * most_bytes`` bytes.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(fold() != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # twice as many as needed: some will be too long
    ids = usable.where("label = 1").orderBy(*order).limit(2 * per_class).unionAll(usable.where("label = 0").orderBy(*order).limit(2 * per_class))
    found = id_and_text(docs).where(F.octet_length("text") <= most_bytes).join(F.broadcast(ids), "doc_id")  # at most 4 * per_class ids
    there = found.select("doc_id", "label").distinct().collect()
    own = [sorted(r["doc_id"] for r in there if r["label"] == y)[:per_class] for y in (0, 1)]
    chosen = [(F.col("label") == y) & (F.col("doc_id") <= x[-1]) for y, x in enumerate(own) if x]
    if not chosen:
        return []
    rows = found.where(reduce(lambda a, b: a | b, chosen)).groupBy("doc_id", "label").agg(F.min("text").cast("binary").alias("text")).collect()
    return [(bytes(r["text"]), r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights, the last one the intercept, by Newton's method on standardised columns."""
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([(features - mean) / scale, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (labels - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - float(np.sum(w[:-1] * mean / scale)))


def probability(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))
