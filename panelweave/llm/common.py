"""What the learned operators share: bounded samples of labelled rows and one-feature calibration."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """wanted, with underscores at its end until no other column has the name, in whatever case."""
    known = {c.lower() for c in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int, learn: Column) -> pd.DataFrame:
    """(doc_id, text, label) of at most ``per_class`` rows of either class, in an order that only their ids fix.

    ids come from the labels alone, so no text is shuffled: what is broadcast
    has at most 2 * per_class rows, and as many come to the driver. Texts over
    ``most_chars`` and rows without text or label are not learnt from; of rows
    that share a doc_id the one with the least text is.
    """
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    ids = [known.filter(F.col("label") == k).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))
    found = docs.select("doc_id", "text").filter(F.length("text").between(1, most_chars)).join(chosen, "doc_id")
    found = found.groupBy("doc_id", "label", "order").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "order")
    return found.toPandas().sort_values(["order", "doc_id"]).reset_index(drop=True)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.05, rounds: int = 100) -> np.ndarray:
    """Coefficients, intercept last, of a logistic regression by Newton steps, halved while they don't help."""
    x = np.column_stack([x, np.ones(len(x))])
    w, beta = np.ones(len(y)) if weight is None else weight, np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + ridge * (b @ b) / 2)

    now = loss(beta)
    for _ in range(rounds):
        p = logistic(x @ beta)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (w * (y - p)) - ridge * beta)
        while (after := loss(beta + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if now - after < 1e-10 * (1 + abs(now)):
            break
        now = after
    return beta


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
