"""Substring dedup with automata of repeated phrases.

A *window* is ``WINDOW`` consecutive words. Words that lie in a window whose words also start
anywhere else go.

1. Texts with the same words are one class; of a class with two rows or more every window
   recurs, and one row stands for it in what follows.
2. Each window picks its *mark*: the smallest hash of the ``PHRASE``-word phrases in it, about one
   mark for 14 words. Equal windows pick equal marks, so only marks that stand at two places
   can lie in a recurring passage; only hashes and positions are shuffled to find them.
3. A mark's first place decides its *shard*, so that marks of one passage share a shard. The
   text around recurring marks, and no other, goes to the marks' shards as word hashes. A
   shard with much text is dealt to several tasks (salts), a long stretch to several pieces.
4. Recurring passages are confirmed: each task counts the windows of its pieces, the counts of
   a shard's tasks are summed, and windows with two places or more are chained, where they
   stand first, into passages.
5. Each shard's passages are compiled into Aho-Corasick automata whose letters are words and
   whose patterns are the passages' windows, ``PATTERNS`` in an automaton. All text of the shard is
   streamed through them, and every end of a pattern is an occurrence. At most one pattern
   ends at a word, so the work is linear however often a phrase stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm import bytewise as bw
from pairlane.llm.common import cut, discard, read, saved

WINDOW, PHRASE = 35, 8
#: Words of a document whose marks go to one shard; window starts in a piece; words in a task; windows in an automaton.
CHUNK, PIECE, TASK_WORDS, PATTERNS = 4096, 32_768, 300_000, 60_000
#: Words around a mark, about, when passages are long.
_SPACING = 15


def joined_hashes(d: np.ndarray, w: bw.Runs, kept: np.ndarray, n: int) -> list[str]:
    """sha256 of each text's kept words, joined by one space."""
    step = np.zeros(len(d) + 1, np.int8)
    step[w.start[kept]] = 1
    step[w.end[kept]] -= 1
    keep = np.cumsum(step[:-1]).astype(bool)
    doc = w.doc[kept]
    later = np.r_[False, doc[1:] == doc[:-1]] if len(doc) else np.zeros(0, bool)
    space = w.start[kept][later] - 1  # the white space before a word
    keep[space] = True
    out = d.copy()
    out[space] = 32
    size = np.zeros(n, np.int64)
    np.add.at(size, doc, (w.end - w.start)[kept] + later)
    raw, end = memoryview(out[keep].tobytes()), np.cumsum(size)
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]


def marks_of(hashes: np.ndarray, doc: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the phrases that some window within one text picks: the smallest, the leftmost of equal ones."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = bw.rolling(hashes, phrase)
    best, at, have, want = value, np.arange(len(value)), 1, window - phrase + 1
    while have < want:  # minima over twice as many phrases
        step = min(have, want - have)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        have += step
    picked = np.unique(at[:n][doc[:n] == doc[window - 1 :]])
    return picked, value[picked]


def _prepare(window: int, phrase: int):
    """(row, id, text) to (row, id, text, k, n_words, sha, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, d, off in bw.blocks(*bw.column(batch.column(2))):
                n = b - a
                w = bw.runs(~bw.SPACE[d], off)
                hashes = bw.Hasher(d)(w.start, w.end)
                at, mark = marks_of(hashes, w.doc, window, phrase)
                words = bw.counts(w.doc, n)
                first = np.r_[0, np.cumsum(words)[:-1]]
                owner = w.doc[at]
                pairs = pa.StructArray.from_arrays([pa.array((at - first[owner]).astype(np.int32)), pa.array(mark.view(np.int64))], ["pos", "mark"])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, n) for i in range(3)], bw.binary(bw.sequence_keys(hashes, w.doc, n)), pa.array(words.astype(np.int64)), pa.array(joined_hashes(d, w, np.ones(len(w.doc), bool), n)), bw.lists(pairs, bw.counts(owner, n))],
                    ["row", "id", "text", "k", "n_words", "sha", "marks"],
                )

    return run


def stretches(positions: list[int], n: int, window: int, phrase: int, piece: int) -> Iterator[tuple[int, int]]:
    """Word ranges that hold all windows around the marks; each window start is in exactly one range."""
    low = high = -1
    whole = []
    for p in sorted(positions):
        start, end = max(0, p - (window - phrase)), min(n, p + window)
        if start <= high:
            high = end
        else:
            if high > 0:
                whole.append((low, high))
            low, high = start, end
    if high > 0:
        whole.append((low, high))
    for low, high in whole:
        for at in range(low, max(low + 1, high - window + 1), piece):
            yield at, min(high, at + piece + window - 1)


def _cut(window: int, phrase: int, piece: int):
    """(row, text, plan) to (row, text, pieces): the word hashes of every stretch that a shard wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = batch.column(2)
            for a, b, d, off in bw.blocks(*bw.column(batch.column(1))):
                n = b - a
                w = bw.runs(~bw.SPACE[d], off)
                hashes = bw.Hasher(d)(w.start, w.end).view(np.int64)
                words = bw.counts(w.doc, n)
                first = (np.cumsum(words) - words).tolist()
                head, values, sizes, per_doc = [], [np.zeros(0, np.int64)], [], []
                for i, (row, plan) in enumerate(zip(batch.column(0).slice(a, n).to_pylist(), plans.slice(a, n).to_pylist(), strict=True)):
                    before = len(head)
                    for x in plan:
                        for low, high in stretches(x["at"], int(words[i]), window, phrase, piece):
                            head.append((x["shard"], hash((row, low)) % x["salts"], x["salts"], low))
                            values.append(hashes[first[i] + low : first[i] + high])
                            sizes.append(high - low)
                    per_doc.append(len(head) - before)
                columns = [pa.array(np.array([h[j] for h in head], np.int32)) for j in range(4)]
                pieces = pa.StructArray.from_arrays([*columns, bw.lists(pa.array(np.concatenate(values)), np.array(sizes, np.int64))], ["shard", "salt", "salts", "at", "words"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), bw.lists(pieces, np.array(per_doc, np.int64))], ["row", "text", "pieces"])

    return run


_PIECES = "array<struct<shard:int,salt:int,salts:int,at:int,words:array<long>>>"


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]


def _starts(off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the values, piece) of every window that lies within one piece."""
    number = np.maximum(np.diff(off) - window + 1, 0)
    piece = np.repeat(np.arange(len(number)), number)
    return off[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(number) - number, number), piece


def _count(window: int):
    """Windows of one task: (shard, digest, n, first row and position). A single place in a shard of one task is left out."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending"), ("at", "ascending")])
        values, off = _flat(group.column("words"))
        place, piece = _starts(off, window)
        digest, first, n = np.unique(bw.rolling(values.view(np.uint64), window)[place], return_index=True, return_counts=True)
        if group.column("salts")[0].as_py() == 1:
            digest, first, n = digest[n > 1], first[n > 1], n[n > 1]
        owner = piece[first]
        row, at = group.column("row").to_numpy()[owner], group.column("at").to_numpy()[owner] + place[first] - off[owner]
        shard = np.full(len(first), group.column("shard")[0].as_py(), np.int32)
        return pa.table({"shard": shard, "digest": digest.view(np.int64), "n": n.astype(np.int64), "row": row, "pos": at.astype(np.int32)})

    return run


def chained(at: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers (first, last) of a sorted list."""
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) != 1)
    return list(zip(at[np.r_[0, edge + 1]].tolist(), at[np.r_[edge, len(at) - 1]].tolist(), strict=True))


def _passages(window: int):
    """(shard, salts, at, words, starts) to (shard, salts, passage): confirmed windows of a piece that stand first in it, chained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, passages = [], []
            for i, at in enumerate(batch.column("at").to_pylist()):
                words = batch.column("words")[i].values.to_numpy()
                starts = np.sort(batch.column("starts")[i].values.to_numpy()) - at
                for a, b in chained(starts[(starts >= 0) & (starts <= len(words) - window)]):
                    rows.append(i)
                    passages.append(words[a : b + window])
            take = pa.array(rows, pa.int64())
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *passages]))
            yield pa.RecordBatch.from_arrays([batch.column("shard").take(take), batch.column("salts").take(take), bw.lists(values, np.array([len(p) for p in passages], np.int64))], ["shard", "salts", "passage"])

    return run


def _letters(numbers: np.ndarray) -> str:
    """One character for each number; the surrogates' range is left out."""
    return np.where(numbers >= 0xD800, numbers + 0x800, numbers).astype("<u4").tobytes().decode("utf-32-le")


def occurrences(values: np.ndarray, off: np.ndarray, passages: np.ndarray, bounds: np.ndarray, window: int, most: int) -> np.ndarray:
    """Words of the pieces (true or false) that lie in an occurrence of a window of the passages."""
    import ahocorasick

    covered = np.zeros(len(values) + 1, np.int32)
    windows = np.cumsum(np.diff(bounds) - window + 1)
    low = 0
    while low < len(windows):  # passages are taken until an automaton is full
        high = max(low + 1, int(np.searchsorted(windows, (windows[low - 1] if low else 0) + most, side="right")))
        own = passages[bounds[low] : bounds[high]]
        letters = np.unique(own)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        text = _letters(np.searchsorted(letters, own) + 1)
        for a, b in zip((bounds[low:high] - bounds[low]).tolist(), (bounds[low + 1 : high + 1] - bounds[low]).tolist(), strict=True):
            for i in range(a, b - window + 1):
                automaton.add_word(text[i : i + window], 1)
        automaton.make_automaton()
        at = np.minimum(np.searchsorted(letters, values), len(letters) - 1)
        stream = _letters(np.where(letters[at] == values, at + 1, 0))
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            ends = np.fromiter((e for e, _ in automaton.iter(stream[a:b])), np.int64) + a
            covered[ends - window + 1] += 1
            covered[ends + 1] -= 1
        low = high
    return np.cumsum(covered[:-1]) > 0


def _locate(window: int, most: int):
    """All pieces of a task through the automata of its shard: (row, ranges of covered words)."""

    def run(pieces: pa.Table, passages: pa.Table) -> pa.Table:
        if not pieces.num_rows or not passages.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "ranges": pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})
        values, off = _flat(pieces.column("words"))
        covered = occurrences(values, off, *_flat(passages.column("passage")), window, most)
        at = pieces.column("at").to_numpy()
        opens = covered.copy()
        opens[1:] &= ~covered[:-1]
        opens[off[:-1]] = covered[off[:-1]]  # a range ends with its piece
        closes = covered.copy()
        closes[:-1] &= ~covered[1:] | opens[1:]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        owner = np.searchsorted(off, start, side="right") - 1
        shift = (at - off[:-1])[owner]
        pairs = pa.StructArray.from_arrays([pa.array((start + shift).astype(np.int32)), pa.array((end + shift).astype(np.int32))], ["start", "end"])
        n = bw.counts(owner, len(at))
        out = pa.table({"row": pieces.column("row").combine_chunks(), "ranges": bw.lists(pairs, n)})
        return out.filter(pa.array(n > 0))

    return run


def _remove():
    """(row, text, ranges) to (row, n_removed, sha)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, d, off in bw.blocks(*bw.column(batch.column(1))):
                n = b - a
                w = bw.runs(~bw.SPACE[d], off)
                words = bw.counts(w.doc, n)
                first = np.cumsum(words) - words
                ranges = batch.column(2).slice(a, n)
                owner = np.repeat(np.arange(n), ranges.value_lengths().to_numpy(zero_copy_only=False))
                flat = ranges.flatten()
                step = np.zeros(len(w.doc) + 1, np.int64)
                np.add.at(step, first[owner] + flat.field("start").to_numpy(), 1)
                np.add.at(step, first[owner] + flat.field("end").to_numpy(), -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = np.bincount(w.doc[gone], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(removed), pa.array(joined_hashes(d, w, ~gone, n))], ["row", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, task_words: int = TASK_WORDS, patterns: int = PATTERNS, piece: int = PIECE, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``key``, n_words, n_removed, kept_sha256.

    A word goes if it lies in ``window`` consecutive words of its text whose sequence also
    starts at another place of any text, the same one included; windows are those of the
    input. Words are compared unchanged. NULL, empty and white-space texts have no words.
    Repeated rows are copies of each other, whatever their keys, and lose all words if they have ``window``
    or more. NULL keys are ordinary rows. Other columns are not carried. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    table = saved(rows.mapInArrow(_prepare(window, phrase), f"row long, id {kind}, text string, k binary, n_words long, sha string, marks array<struct<pos:int,mark:long>>"))

    # the joins stand on plain exchanges, so that rows of a hot key can be split
    classes = cut(table.where(F.col("n_words") >= window).groupBy("k").agg(F.min("row").alias("rep"), F.count("*").alias("weight")).where("weight > 1"))
    slim = table.where(F.size("marks") > 0).select("row", "k", "marks").join(classes, "k", "left").where("rep IS NULL OR row = rep")
    marks = saved(slim.select("row", F.inline("marks")))
    places = marks.groupBy("mark").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first")).where("n > 1")
    places = cut(places.select("mark", "n", F.xxhash64("first.row", F.floor(F.col("first.pos") / chunk)).alias("passage")))
    total = places.agg(F.sum("n")).first()[0] or 0  # one number
    shards = max(1, total * _SPACING * 2 // task_words)
    places = places.select("mark", "n", F.pmod("passage", F.lit(shards)).cast("int").alias("shard"))
    loads = cut(places.groupBy("shard").agg(F.ceil(F.sum("n") * _SPACING / task_words).cast("int").alias("salts")))
    places = cut(places.join(loads, "shard").select("mark", "shard", "salts"))

    wanted = marks.join(places, "mark").groupBy("row", "shard").agg(F.collect_list("pos").alias("at"), F.first("salts").alias("salts"))
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("shard", "salts", "at")).alias("plan"))
    wanted = cut(wanted)
    discard(marks)
    texts = table.where(F.size("marks") > 0).select("row", "text").join(wanted, "row").select("row", "text", "plan")
    pieces = saved(texts.mapInArrow(_cut(window, phrase, piece), f"row long, text string, pieces {_PIECES}"))
    flat = pieces.select("row", F.inline("pieces"))

    counts = flat.groupBy("shard", "salt").applyInArrow(_count(window), "shard int, digest long, n long, row long, pos int")
    confirmed = counts.groupBy("shard", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("row", "pos")).alias("first")).where("n > 1")
    starts = cut(confirmed.groupBy("shard", F.col("first.row").alias("row")).agg(F.collect_list("first.pos").alias("starts")))
    passages = flat.join(starts, ["shard", "row"]).select("shard", "salts", "at", "words", "starts").mapInArrow(_passages(window), "shard int, salts int, passage array<long>")
    dealt = cut(passages).select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "passage")
    found = flat.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInArrow(_locate(window, patterns), "row long, ranges array<struct<start:int,end:int>>")
    ranges = cut(found.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))

    done = cut(pieces.select("row", "text").join(ranges, "row").mapInArrow(_remove(), "row long, n_removed long, kept_sha256 string"))
    discard(pieces)
    out = table.select("row", "id", "k", "n_words", "sha").join(classes.select("k", "weight"), "k", "left").join(done, "row", "left")
    whole = F.col("weight").isNotNull()
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    sha = F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha"))
    return out.select(F.col("id").alias(key), "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))


def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 1))) AS s FROM d
), g AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + {WINDOW} - 1), ' ')) AS gram FROM x
), r AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1
), t AS (
  SELECT doc_id, s, CASE WHEN s <= max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {WINDOW} THEN 0 ELSE 1 END AS opens FROM r
), i AS (
  SELECT doc_id, min(s) AS a, max(s) + {WINDOW} - 1 AS b FROM (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM t) GROUP BY doc_id, run
), u AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d
), k AS (
  SELECT u.doc_id, u.w, u.p, i.a IS NOT NULL AND u.p <= i.b AS gone FROM u ASOF LEFT JOIN i ON u.doc_id = i.doc_id AND u.p >= i.a
), o AS (
  SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(o.n, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""

QUERIES = {"op11_phrase_automata": op11_phrase_automata}
ORACLES = {"op11_phrase_automata": OP11_SQL}
