"""Quality rules: repetition from suffix arrays over words.

Inside a task the words of a block of texts get one suffix array per text by prefix
doubling; texts whose suffixes are all told apart leave, so only repetitive ones go on to
longer prefixes. The ranks of the doubling steps give the longest common prefix of
neighbouring suffixes, whose intervals hold all maximal repeated substrings. The union of
their spans limits the covered fraction, and the longest of them the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm import bytewise as bw
from pairlane.llm.common import others, read

#: Base rules: fewest words, window of words that counts as repeated, share of repeated words in percent.
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
#: Method: shortest repeat that counts, in words; largest share covered, in percent; longest repeat allowed, in words.
MIN_REPEAT, COVER_PERCENT, LONGEST = 10, 15, 200

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    s = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.r_[0, np.cumsum(s[1:] != s[:-1])] if len(s) else s
    return rank


def repeats(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the number of words from it on that also stand elsewhere in its text (the longest such prefix)."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((hashes, doc))
    changed = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.r_[0, np.cumsum(changed)]
    active, k, levels = np.arange(n), 1, [(None, np.r_[rank, -1])]
    suffix = np.empty(n, np.int64)
    while len(active):
        first = np.flatnonzero(np.r_[True, doc[active][1:] != doc[active][:-1]])
        size = np.diff(np.r_[first, len(active)])
        low = np.minimum.reduceat(rank, first)
        done = np.repeat(np.maximum.reduceat(rank, first) - low + 1 == size, size)
        base = np.repeat(active[first] - low, size)
        suffix[(base + rank)[done]] = active[done]
        active, rank = active[~done], rank[~done]
        if not len(active):
            break
        after = np.full(len(active), -1, np.int64)
        if len(active) > k:
            same = doc[active[k:]] == doc[active[:-k]]
            after[:-k][same] = rank[k:][same]
        rank = _dense(rank * (len(active) + n + 2) + after + 1)
        k *= 2
        whole = np.arange(n, 2 * n + 1)
        whole[active] = rank
        flag = np.zeros(n, bool)
        flag[active] = True
        levels.append((flag, whole))
    a, b = suffix[:-1], suffix[1:]
    lcp = np.zeros(max(0, n - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        flag, ranks = levels[level]
        at = np.flatnonzero((doc[a] == doc[b]) & (flag[a] if flag is not None else True))
        if len(at):
            match = ranks[a[at] + lcp[at]] == ranks[b[at] + lcp[at]]
            lcp[at[match]] += 1 << level
    out = np.zeros(n, np.int64)
    out[a] = lcp
    out[b] = np.maximum(out[b], lcp)
    return out


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(d: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    w = bw.runs(~bw.SPACE[d], off)
    hasher = bw.Hasher(d)
    again = repeats(hasher(w.start, w.end), w.doc)
    base = np.flatnonzero(again >= BASE_WINDOW)
    long = np.flatnonzero(again >= MIN_REPEAT)
    lines = bw.runs(d != 10, off)
    spoken = np.zeros(len(d) + 1, np.int64)
    np.cumsum(~bw.SPACE[d], out=spoken[1:])
    filled = spoken[lines.end] > spoken[lines.start]
    # equal lines of a text: same hash and length
    key = np.stack([lines.doc[filled], hasher(lines.start, lines.end)[filled].view(np.int64), (lines.end - lines.start)[filled]])
    order = np.lexsort(key)
    s = key[:, order]
    repeated = np.r_[False, (s[:, 1:] == s[:, :-1]).all(axis=0)] if s.shape[1] else np.zeros(0, bool)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc, again)
    return {
        "n_words": bw.counts(w.doc, n),
        "word_chars": bw.per_doc(~bw.SPACE[d] & ((d & 0xC0) != 0x80), off),
        "n_symbols": bw.per_doc(_SYMBOL[d], off),
        "n_dup_lines": bw.counts(s[0][repeated], n) if s.shape[1] else np.zeros(n, np.int64),
        "n_repeat_words": bw.counts(w.doc[_covered(base, np.full(len(base), BASE_WINDOW), len(again))], n) if len(base) else np.zeros(n, np.int64),
        "covered_words": bw.counts(w.doc[_covered(long, again[long], len(again))], n) if len(long) else np.zeros(n, np.int64),
        "longest_repeat": longest,
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bw.column(batch.column(batch.num_columns - 1))
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        for a, b, d, off in bw.blocks(data, offsets):
            found = measures(d, off)
            yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in rest], *[pa.array(found[x].astype(np.int64)) for x in NAMES]], [*batch.schema.names[:-1], *NAMES])


def repetition_rules(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, cover_percent: int = COVER_PERCENT, longest: int = LONGEST
) -> DataFrame:
    """``keep`` columns (default: all), the measures of every whole text, ``base_failed`` and ``kept``.

    ``covered_words``: words in repeats of at least ``MIN_REPEAT`` words; ``longest_repeat``: words
    of the longest repeated substring (it may overlap itself). A text is kept if no base rule
    fails, at most ``cover_percent`` of its words are covered and no repeat exceeds ``longest``.
    NULL text counts as empty, and empty texts fail for having too few words. Repeated rows are
    judged alike. Columns with a measure's name are replaced. An empty table gives no rows.
    """
    rest = [c for c in others(docs, *NAMES, "base_failed", "kept") if keep is None or c in keep]
    found = bw.mapped(docs, rest, text, _measure, ", ".join(f"{x} long" for x in NAMES))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    good = (100 * F.col("covered_words") <= cover_percent * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)


def op8_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition_rules(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _windows_sql(n: int, name: str) -> str:
    return f"""
{name}w AS (SELECT doc_id, i, hash(list_slice(words, i, i + {n - 1})) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM w WHERE len(words) >= {n})),
{name} AS (SELECT doc_id, i FROM {name}w QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
{name}c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {n})) AS j FROM {name}) GROUP BY doc_id)"""


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
{_windows_sql(BASE_WINDOW, "base")},
{_windows_sql(MIN_REPEAT, "rep")},
{_windows_sql(LONGEST + 1, "top")},
l AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
         coalesce(basec.n, 0)::BIGINT AS n_repeat_words, coalesce(repc.n, 0) AS covered, coalesce(topc.n, 0) AS top
  FROM d JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN basec USING (doc_id) LEFT JOIN repc USING (doc_id) LEFT JOIN topc USING (doc_id)
), f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * covered <= {COVER_PERCENT} * n_words AND top = 0 AS kept
FROM f
"""

QUERIES = {"op8_suffix_repetition": op8_suffix_repetition}
ORACLES = {"op8_suffix_repetition": OP8_SQL}
