"""Fitting a classifier on a bounded, seeded sample of labelled documents."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlane.llm.common import discard, saved, seeded_digest


#: Bound of a labelled sample in bytes of text: rows beyond it, in the seeded order, are not in the sample.
MOST_BYTES = 128 << 20


def remainder(key: str, of: int) -> Column:
    """crc32 of the key's decimal text modulo ``of``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


def fit_on_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, lang: str | None, per_class: int, seed: int, train: Callable[[pa.Table, np.ndarray], object], most_bytes: int = MOST_BYTES) -> object:
    """``train(rows, weights)`` on up to ``per_class`` documents of each label, in one task.

    Rows have text, label and lang. Weights restore the shares that the classes have among all
    labelled rows. Labels that are NULL, or neither 0 nor 1, and repeated labels of a key do not
    count; a repeated document counts once, with its smallest row. The sampled keys are bounded
    by ``2 * per_class``, so the join to the documents broadcasts them. Whole documents are taken
    in a seeded order while their texts sum up to ``most_bytes`` at most, so one task can hold
    them; only the model comes to the driver.
    """
    clean = labels.select(F.col(key), F.col(label).cast("int").alias("label")).where("label in (0, 1)").where(F.col(key).isNotNull()).groupBy(key).agg(F.min("label").alias("label"))
    shares = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    parts = [clean.where(F.col("label") == x).orderBy(seeded_digest(seed, F.col(key)), key).limit(per_class) for x in (0, 1)]
    chosen = parts[0].union(parts[1]).select(F.col(key).alias("key"), "label")
    pair = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"))
    rows = pair.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min(F.struct("text", "lang", "label")).alias("row")).select("key", "row.*")

    def fit(table: pa.Table) -> bytes:
        table = table.take(np.argsort(table.column("key").to_numpy(zero_copy_only=False), kind="stable"))
        y = table.column("label").to_numpy(zero_copy_only=False)
        weight = np.ones(len(y))
        for x in (0, 1):
            if (y == x).any():
                weight[y == x] = shares[x] / (y == x).sum()
        return pickle.dumps(train(table, weight / weight.mean() if len(weight) else weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            yield pa.RecordBatch.from_arrays([pa.array([fit(pa.Table.from_batches(got))], pa.binary())], ["model"])

    rows = saved(rows)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    upto = F.sum(size).over(Window.orderBy(seeded_digest(seed, F.col("key")), "key").rowsBetween(Window.unboundedPreceding, 0))  # 2 * per_class rows at most
    within = rows.select("key", upto.alias("upto")).where(F.col("upto") <= most_bytes).select("key")
    found = rows.join(F.broadcast(within), "key").repartition(1).mapInArrow(run, "model binary").collect()
    discard(rows)
    if found:
        return pickle.loads(found[0]["model"])
    return pickle.loads(fit(pa.table({"key": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "lang": pa.array([], pa.string()), "label": pa.array([], pa.int32())})))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """(a, b) for sigmoid(a * z + b), by weighted logistic regression with Newton steps and a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([(weight * (p - y) * z).sum() + 1.0 * (a - 1), (weight * (p - y)).sum() + 0.1 * b])
        h = weight * p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1.0, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        d = np.linalg.solve(m, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(max(a, 0.05)), float(b)


class Adam:
    """Adam over a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.n = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.n += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)
