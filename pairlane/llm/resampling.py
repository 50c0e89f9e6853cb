"""Importance resampling of documents towards a target distribution.

Texts become bags of hashed word n-grams. A bucket's *gain* is the log ratio of its smoothed
shares in the target and in the documents, a document's weight the sum of its gains, and a
draw without replacement takes the highest weights plus Gumbel noise.

Batch concatenation: the texts of a block of about a MB are joined with a separator that no
word holds, and one regex pass finds the words of all of them. The words' documents come from
a binary search in the text offsets; an n-gram counts where its first and last word lie in
the same document. One ``bincount`` then counts the block's buckets, another one weighs them.

Counts leave a task as one row a bucket; the table of gains has ``buckets`` entries, whatever
the corpus. The draw is a rank over range partitions with running sums: no task holds all scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm import bytewise as bw
from pairlane.llm.common import cut, ranged, read, running

NGRAM, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Words of lower-cased UTF-8 (ASCII letters and digits and all bytes beyond ASCII), or one separator, which no word holds.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|\x1e")
_SEPARATOR = b"\x1e"
#: Distinct words that a task remembers between blocks; it starts afresh beyond that.
REMEMBERED = 400_000


class Features:
    """Buckets of the n-grams of a block of texts."""

    def __init__(self, ngram: int, buckets: int):
        self.ngram, self.buckets = ngram, buckets
        self._afresh()

    def _afresh(self) -> None:
        self.words, self.number, self.bucket = [_SEPARATOR], {_SEPARATOR: 0}, [-1]

    def _numbers(self, joined: bytes) -> np.ndarray:
        """Numbers of the words, 0 for a separator; a long text is gone through a MB at a time, each up to the end of a word."""
        out, at, number = [np.zeros(0, np.int64)], 0, self.number
        while at < len(joined):
            end = min(at + bw.BLOCK, len(joined))
            if word := _WORD.match(joined, end):
                end = word.end()
            found = _WORD.findall(joined, at, end)
            for w in set(found) - number.keys():
                number[w] = len(self.words)
                self.words.append(w)
                self.bucket.append(zlib.crc32(w) % self.buckets)
            out.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            at = end
        return np.concatenate(out)

    def __call__(self, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each feature, its text, words of each text)."""
        if len(self.words) > REMEMBERED:
            self._afresh()
        n = len(off) - 1
        d = np.where(d == _SEPARATOR[0], np.uint8(0), d)  # a control like any other within a text
        joined = np.insert(d, off[1:-1], _SEPARATOR[0]).tobytes().lower()  # lower() of bytes changes A-Z alone
        found = self._numbers(joined)
        between = np.flatnonzero(found == 0)
        ids = found[found > 0]
        upto = between - np.arange(len(between))  # words before each separator
        doc = np.searchsorted(upto, np.arange(len(ids)), side="right")
        buckets, owner = [np.array(self.bucket, np.int64)[ids]], [doc]
        for size in range(2, min(self.ngram, len(ids)) + 1):
            m = len(ids) - size + 1
            inside = doc[:m] == doc[size - 1 :]  # n-grams over a separator are masked
            grams = np.stack([ids[i : m + i][inside] for i in range(size)], axis=1)
            distinct, which = np.unique(grams, axis=0, return_inverse=True)
            hashed = [zlib.crc32(b" ".join([self.words[i] for i in g])) % self.buckets for g in distinct.tolist()]
            buckets.append(np.array(hashed, np.int64)[which.reshape(-1)])
            owner.append(doc[:m][inside])
        return np.concatenate(buckets), np.concatenate(owner), bw.counts(doc, n)


def _count(ngram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(ngram, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, d, off in bw.blocks(*bw.column(batch.column(0))):
                total += np.bincount(features(d, off)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text: str, ngram: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: one row a task and bucket is summed, ``buckets`` sums are collected."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_count(ngram, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares, one added to each count, rounded down."""
    k = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def _weigh(ngram: int, buckets: int, gain: np.ndarray):
    value = gain.astype(np.float64)  # sums of whole numbers stay exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(ngram, buckets)
        for batch in batches:
            for a, b, d, off in bw.blocks(*bw.column(batch.column(1))):
                bucket, owner, words = features(d, off)
                weight = np.bincount(owner, value[bucket], b - a).astype(np.int64)
                columns = [words.astype(np.int64), np.bincount(owner, minlength=b - a).astype(np.int64), weight]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, columns)], ["id", "n_words", "n_features", "weight"])

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: ``key``, n_features, weight, score, rank.

    Of the N rows with ``least_words`` words or more, the floor(N * percent / 100) with the highest
    scores are drawn and get ranks from 1 on; equal scores go to the smaller key (NULL last), then
    to fewer features, and rows that agree in all of that are interchangeable. All others have a
    NULL rank. NULL text is empty: no features, weight 0. A NULL key's noise is that of the empty
    key; rows that share a key share its noise. Without a target text, or without any
    document, counts are 0 and the smoothing alone decides. Other columns are not carried. An
    empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    gain = gains(bucket_counts(docs, text, ngram, buckets), bucket_counts(target, target_text, ngram, buckets))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).mapInArrow(_weigh(ngram, buckets, gain), f"id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    score = (F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))).cast("long")
    rows = rows.withColumn("score", score).withColumn("out", F.col("n_words") < least_words).withColumn("down", -F.col("score")).withColumn("none", F.col("id").isNull())
    order = ["out", "down", "none", "id", "n_features"]
    placed = ranged(cut(rows), order)  # range bounds are sampled from the rows: they are weighed once
    drawn = placed.where(~F.col("out")).count() * percent // 100  # one number
    placed = running(placed, [], "_part", order, F.lit(1).cast("long"), "nth")
    return placed.select(F.col("id").alias(key), "n_features", "weight", "score", F.when(~F.col("out") & (F.col("nth") <= drawn), F.col("nth")).alias("rank"))


def op13_batch_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders
), d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), f AS (
  SELECT w, count(*) AS s, 0 AS t FROM (SELECT unnest(w) AS w FROM d) GROUP BY w
  UNION ALL
  SELECT w, 0, count(*) FROM (SELECT unnest(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS w FROM benchmark) GROUP BY w
), v AS (
  SELECT w, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t, hex(encode(w)) AS h FROM f GROUP BY w
), b AS (
  SELECT w, s, t, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: (('0x' || substr(h, 2 * i + 1, 2))::INTEGER)::BIGINT)),
           lambda c, x: xor(c >> 8, crc.remainders[xor(c, x) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM v, crc
), g AS (
  SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + {BUCKETS})::DOUBLE / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM b GROUP BY bucket
), u AS (
  SELECT doc_id, unnest(w) AS w FROM d
), x AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(y.weight, 0)::BIGINT AS weight,
         (('0x' || substr(sha256('{SEED}:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS p
  FROM d LEFT JOIN (SELECT doc_id, sum(gain) AS weight FROM u JOIN b USING (w) JOIN g USING (bucket) GROUP BY doc_id) y ON y.doc_id = d.doc_id
), z AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(p)))::BIGINT AS score FROM x
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS n FROM z WHERE n_features >= {LEAST_WORDS}
)
SELECT z.doc_id, z.n_features, z.weight, z.score, CASE WHEN r.nth <= r.n * {PERCENT} // 100 THEN r.nth END AS "rank" FROM z LEFT JOIN r ON r.doc_id = z.doc_id
"""

QUERIES = {"op13_batch_resample": op13_batch_resample}
ORACLES = {"op13_batch_resample": OP13_SQL}
