"""Quality: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes (one weight for each byte value and place) slide over the whole
text. Their maxima over overlapping chunks of ``PARTS`` * ``PART`` bytes, which advance by
one ``PART`` less than their length and so cover every byte, pass a small layer that gives
each chunk a logit; the mean, maximum and minimum over the chunks give the probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm import bytewise as bw
from pairlane.llm.common import read
from pairlane.llm.labels import Adam, calibrate, fit_on_sample, remainder, sigmoid
from pairlane.llm.toxicity import score_texts

WIDTH, FILTERS, PART, PARTS = 6, 16, 128, 4
PAD = 256
#: Bound of the labelled sample: documents of each label that the model is fitted on.
PER_CLASS = 2500
EPOCHS, BATCH, SEED = 6, 32, 10
#: Chunks whose filter outputs a training step holds at once.
SLICE = 512


def layout(d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with padding so that each text is a whole number of parts, and the first part of each text."""
    length = np.diff(off)
    parts = np.maximum(1, -(-length // PART))
    first = np.r_[0, np.cumsum(parts)]
    out = np.full(int(first[-1]) * PART + WIDTH, PAD, np.int16)
    shift = np.repeat(first[:-1] * PART - off[:-1], length)
    out[np.arange(len(d)) + shift] = d
    return out, first


def _maxima(x: np.ndarray, filters: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Part x filter: the largest value of each filter within a part.

    Windows may reach into the next part, but those of ``last``, the last parts of texts, read padding there.
    """
    n = len(x) - WIDTH
    c = filters[0][x[:n]]
    for t in range(1, WIDTH):
        c += filters[t][x[t : n + t]]
    c = c.reshape(-1, PART, FILTERS)
    ends = np.concatenate([x[:n].reshape(-1, PART)[last, PART - WIDTH :], np.full((len(last), WIDTH), PAD, x.dtype)], axis=1)
    for s in range(PART - WIDTH + 1, PART):
        c[last, s] = sum(filters[t][ends[:, s + WIDTH - PART + t]] for t in range(WIDTH))
    return c.max(axis=1)


def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first part, last part + 1, text) of every chunk."""
    parts = np.diff(first)
    number = np.maximum(1, -(-(parts - 1) // (PARTS - 1)))
    doc = np.repeat(np.arange(len(parts)), number)
    nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(number)[:-1]], number)
    begin = first[doc] + nth * (PARTS - 1)
    return begin, np.minimum(begin + PARTS, first[doc + 1]), doc


def _pool(maxima: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = maxima[begin]
    for k in range(1, PARTS):
        out = np.maximum(out, maxima[np.minimum(begin + k, end - 1)])
    return out


def _peaks(x: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk x filter: the largest value, and where its window begins. Each row of ``x`` ends with WIDTH bytes that no window starts at."""
    best, place = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
    reach = x.shape[1] - WIDTH
    for a in range(0, len(x), SLICE):
        part = x[a : a + SLICE].astype(np.int64)
        c = filters[0][part[:, :reach]]
        for t in range(1, WIDTH):
            c += filters[t][part[:, t : reach + t]]
        place[a : a + SLICE] = c.argmax(axis=1)
        best[a : a + SLICE] = c.max(axis=1)
    return best, place


@dataclass
class ByteCnn:
    filters: np.ndarray = field(repr=False)  # width x 257 x filters
    hidden: np.ndarray = field(repr=False)
    hidden_bias: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)
    head: np.ndarray = field(repr=False)  # mean, max, min, bias
    scale: tuple[float, float] = (1.0, 0.0)

    def logits(self, d: np.ndarray, off: np.ndarray) -> np.ndarray:
        x, first = layout(d, off)
        # parts are handled a few thousand at a time
        step, last = 4096 * PART, first[1:] - 1
        maxima = []
        for a in range(0, len(x) - WIDTH, step):
            here = last[np.searchsorted(last, a // PART) : np.searchsorted(last, (a + step) // PART)] - a // PART
            maxima.append(_maxima(x[a : min(a + step, len(x) - WIDTH) + WIDTH], self.filters, here))
        maxima = np.concatenate(maxima)
        begin, end, doc = _chunks(first)
        u = np.tanh(_pool(maxima, begin, end) @ self.hidden + self.hidden_bias) @ self.out
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        mean = np.add.reduceat(u, at) / np.diff(np.r_[at, len(doc)])
        return (self.head[0] * mean + self.head[1] * np.maximum.reduceat(u, at) + self.head[2] * np.minimum.reduceat(u, at) + self.head[3]).astype(np.float64)

    def score(self, d: np.ndarray, off: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.logits(d, off) + self.scale[1]) if len(off) > 1 else np.zeros(0)


def train(rows: pa.Table, weight: np.ndarray, text: str = "text", epochs: int = EPOCHS, seed: int = SEED) -> ByteCnn:
    """Fit on (text, label) rows. Without both labels the model scores their one share everywhere."""
    rng = np.random.default_rng(seed)
    y = rows.column("label").to_numpy().astype(np.float64)
    data, offsets = bw.column(rows.column(text).combine_chunks())
    filters = (rng.standard_normal((WIDTH, 257, FILTERS)) * 0.3).astype(np.float32)
    filters[:, PAD] = 0
    model = ByteCnn(filters, (rng.standard_normal((FILTERS, 8)) * 0.3).astype(np.float32), np.zeros(8, np.float32), (rng.standard_normal(8) * 0.5).astype(np.float32), np.array([1, 0.3, 0.3, 0], np.float32))
    if len(set(y.tolist())) < 2:
        model.head[:] = [0, 0, 0, 6.0 if len(y) and y[0] == 1 else -6.0]
        return model
    spare = rng.random(len(y)) < 0.2
    fit = np.flatnonzero(~spare)
    adam = Adam([model.filters, model.hidden, model.hidden_bias, model.out, model.head], 0.01)
    reach = PARTS * PART
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(fit)
        for low in range(0, len(order), BATCH):
            batch = order[low : low + BATCH]
            pieces, doc = [], []
            for j, i in enumerate(batch):
                own = np.full(max(reach, int(offsets[i + 1] - offsets[i])) + WIDTH, PAD, np.int16)
                own[: offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
                begins = np.arange(0, max(1, offsets[i + 1] - offsets[i] - PART), (PARTS - 1) * PART)
                begins = np.minimum(begins, len(own) - WIDTH - reach)
                pieces += [own[b : b + reach + WIDTH] for b in begins]
                doc += [j] * len(begins)
            x, doc = np.stack(pieces), np.array(doc)
            n = len(x)
            pooled, place = _peaks(x, model.filters)
            h = np.tanh(pooled @ model.hidden + model.hidden_bias)
            u = h @ model.out
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            size = np.diff(np.r_[at, n])
            mean, top, low_ = np.add.reduceat(u, at) / size, np.maximum.reduceat(u, at), np.minimum.reduceat(u, at)
            z = model.head[0] * mean + model.head[1] * top + model.head[2] * low_ + model.head[3]
            d = ((sigmoid(z) - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            du = model.head[0] * (d / size)[doc] + model.head[1] * d[doc] * (u == top[doc]) + model.head[2] * d[doc] * (u == low_[doc])
            dh = du[:, None] * model.out * (1 - h * h)
            dp = dh @ model.hidden.T
            g = np.zeros_like(model.filters)
            for t in range(WIDTH):
                at_byte = np.take_along_axis(x, place + t, axis=1).astype(np.int64)
                g[t] = np.bincount((at_byte * FILTERS + np.arange(FILTERS)).ravel(), dp.ravel(), 257 * FILTERS).reshape(257, FILTERS)
            g[:, PAD] = 0
            head = np.array([(d * mean).sum(), (d * top).sum(), (d * low_).sum(), d.sum()], np.float32)
            adam.step([g, pooled.T @ dh, dh.sum(axis=0), h.T @ du + 1e-4 * model.out, head])
    z = np.concatenate([model.logits(d, off) for _, _, d, off in bw.blocks(data, offsets)])
    aside = np.flatnonzero(spare)
    if len(set(y[aside].tolist())) == 2:
        model.scale = calibrate(z[aside], y[aside], weight[aside])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, seed: int = SEED) -> ByteCnn:
    """Train on whole texts of a seeded sample of at most ``2 * per_class`` labelled documents (NULL texts are empty texts).

    ``score_texts`` applies the model: every row stays with its columns, NULL text is scored
    as the empty text, and an empty table gives no rows.
    """
    return fit_on_sample(docs, labels, label, key, text, None, per_class, seed, lambda rows, weight: train(rows, weight, seed=seed))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(remainder("doc_id", 5) != 0))
    scored = score_texts(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op10_byte_cnn": op10_byte_cnn}
#: None: a trained model is held against its held-out labels in the tests.
ORACLES: dict[str, str] = {}
