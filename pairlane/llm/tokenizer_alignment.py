"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of A and B tile the same bytes, so what overlaps follows from merging the two sorted
lists of token ends. Merge paths: the merge of all texts of a block is cut every
``WORK`` steps; a binary search along each of these diagonals finds how many ends of either
list lie before it, so the pieces are independent and of equal work, however long a text is.
Each piece emits the overlaps of its ends and whether A and B end together there; an open
group at a piece's end is stitched to what the next piece begins with.

Counts over the corpus are joined without any broadcast: documents are gathered in blocks of
about ``BLOCK_LINKS`` links, each block's distinct id pairs are joined to the counts once,
and a block's counts then meet its documents in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm import bytewise as bw
from pairlane.llm.common import cut, read, saved
from pairlane.llm.tokens import Tokens

WORK, BLOCK_LINKS = 1 << 16, 400_000
#: Distinct stretches that a task remembers between blocks; it starts afresh beyond that.
REMEMBERED = 400_000
_SPACE, _LINE = 32, 10


class Pieces:
    """Ids of a subword model that puts a space before the text and writes spaces as U+2581.

    No piece of its vocabulary has a space after another character, or a line feed, so merges never
    cross a word's leading spaces or a line feed: texts are cut there, and each distinct stretch is
    encoded once per task. A vocabulary that has such pieces makes the library take whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.apart = not any("▁" in x.lstrip("▁") or "\n" in x for x in names)
        self.blank = names.index("▁") if "▁" in names else None
        self.known: dict[bytes, np.ndarray] = {}

    def _stretch(self, raw: bytes) -> list[int]:
        """Ids of a stretch; the model adds the space that is taken off here, or one that its first id stands for."""
        if raw[:1] == b" ":
            return self.model.encode(raw[1:].decode()) if len(raw) > 1 else [self.blank]
        return self.model.encode(raw.decode())[1:]

    def encode(self, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of the texts in them); every text begins with its added space or is empty."""
        raw, n = d.tobytes(), len(off) - 1
        if not len(d):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        if not self.apart or self.blank is None:
            parts = [np.array(self.model.encode(raw[a + 1 : b].decode()) if b > a else [], np.int32) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]
        first = d == _LINE
        first |= d == _SPACE
        first[1:] &= (d[1:] == _LINE) | (d[:-1] != _SPACE)
        first[off[:-1][off[:-1] < len(d)]] = True
        start = np.flatnonzero(first)
        end = np.r_[start[1:], len(d)]
        _, at, which = np.unique(bw.Hasher(d)(start, end), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, found = self.known, []
        for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True):
            ids = known.get(x := raw[a:b])
            if ids is None:
                ids = known[x] = np.array(self._stretch(x), np.int32)
            found.append(ids)
        length = np.array([len(x) for x in found])
        flat, begin = np.concatenate(found), np.r_[0, np.cumsum(length)[:-1]]
        each = length[which]
        total = np.r_[0, np.cumsum(each)]
        ids = flat[np.repeat(begin[which] - total[:-1], each) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, off)]


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many entries of ``a`` and of ``b`` lie before each cut of their merge (of equal entries, a's come first)."""
    n = len(a) + len(b)
    d = np.r_[np.arange(0, n, work), n]
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        x, y = a[np.minimum(middle, len(a) - 1)], b[np.clip(d - middle - 1, 0, len(b) - 1)]
        more = open_ & (x <= y)
        low = np.where(more, middle + 1, low)
        high = np.where(open_ & ~more, middle, high)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of every overlapping pair of tokens in order, and the group of each token of A and of B.

    ``a`` and ``b`` are the strictly growing ends of two tilings of the same bytes.
    """
    at, bt = diagonals(a, b, work)
    left, right = [], []
    for i0, i1, j0, j1 in zip(at[:-1].tolist(), at[1:].tolist(), bt[:-1].tolist(), bt[1:].tolist(), strict=True):
        x, y = a[i0:i1], b[j0:j1]
        other = j0 + np.searchsorted(y, x)  # the token of B that covers the byte before A's end
        mine = i0 + np.searchsorted(x, y)
        own = np.arange(j0, j1)
        both = np.zeros(len(y), bool)  # ends of B where a token of A ends too: A has emitted them
        both[np.flatnonzero(mine < i1)] = a[mine[mine < i1]] == y[mine < i1]
        if j1 > j0 and i0 and a[i0 - 1] == y[0]:
            both[0] = True  # stitched: A's end stands in the piece before
        by = np.argsort(np.r_[x, y[~both]], kind="stable")
        left.append(np.r_[np.arange(i0, i1), mine[~both]][by])
        right.append(np.r_[other, own[~both]][by])
    left, right = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
    if not len(a):
        return left, right, left, right
    joint = a[left] == b[right]  # overlaps that end a group, over the pieces' seams too
    group = np.cumsum(joint) - joint
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    of_a[left], of_b[right] = group, group
    return left, right, of_a, of_b


class Written:
    """Texts of groups: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, vocabulary: int):
        self.text = [f"{i}{s}" for s in ",|;" for i in range(vocabulary)]
        self.vocabulary = vocabulary

    def __call__(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, at: np.ndarray, bt: np.ndarray) -> list[str]:
        """Per text (``at``, ``bt``: its first tokens) the digest of its groups."""
        last_a = np.r_[of_a[1:] != of_a[:-1], True][: len(a)]
        last_b = np.r_[of_b[1:] != of_b[:-1], True][: len(b)]
        codes = np.r_[a + self.vocabulary * last_a, b + 2 * self.vocabulary * last_b]
        # group by group, A before B
        codes = codes[np.argsort(np.r_[2 * of_a, 2 * of_b + 1], kind="stable")]
        text, bounds = self.text, (at + bt).tolist()
        return [hashlib.sha256("".join([text[c] for c in codes[x:y].tolist()])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _sizes_of_a(bpe) -> np.ndarray:
    return np.array([len(x) for x in (bpe.decode_single_token_bytes(i) for i in range(bpe.n_vocab))], np.int64)


def _align(ranks: str, pattern: str, model: str, work: int, block_links: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Tokens(ranks, pattern), Pieces(model)
        size = _sizes_of_a(first.bpe)
        written = Written(max(len(size), len(second.size)))
        task, block, filled = TaskContext.get().taskAttemptId() << 32, 0, 0
        for batch in batches:
            for lo, hi, d, off in bw.blocks(*bw.column(batch.column(1))):
                n = hi - lo
                full = np.diff(off) > 0
                spaced = np.insert(d, off[:-1][full], _SPACE)
                off = off + np.r_[0, np.cumsum(full)]
                a, at = first.encode(spaced, off)
                b, bt = second.encode(spaced, off)
                # A's bytes are the text's; B's may differ, and then the text has no tokens
                data = np.frombuffer(b"".join([second.bytes[i] for i in b.tolist()]), np.uint8)
                ends = np.r_[0, np.cumsum(second.size[b])]
                good = full & (np.diff(ends[bt]) == np.diff(off))
                for i in np.flatnonzero(good).tolist():
                    good[i] = np.array_equal(data[ends[bt[i]] : ends[bt[i + 1]]], spaced[off[i] : off[i + 1]])
                a, b = a[np.repeat(good, np.diff(at))].astype(np.int64), b[np.repeat(good, np.diff(bt))].astype(np.int64)
                n_a, n_b = np.diff(at) * good, np.diff(bt) * good
                at, bt = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
                left, right, of_a, of_b = overlaps(np.cumsum(size[a]), np.cumsum(second.size[b]), work)
                doc = np.searchsorted(at, left, side="right") - 1
                n_links = np.bincount(doc, minlength=n)
                ends_of = np.r_[of_a + 1, 0][np.maximum(at[1:], 1) - 1] if len(of_a) else np.zeros(n, np.int64)
                n_groups = np.where(n_a > 0, ends_of - np.r_[of_a, 0][at[:-1]], 0)
                # distinct id pairs of each text, with how often they are linked
                code = (a[left] << 32) | b[right]
                by = np.lexsort((code, doc))
                code, doc = code[by], doc[by]
                new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])][: len(code)])
                times = np.diff(np.r_[new, len(code)])
                distinct = np.bincount(doc[new], minlength=n)
                places = np.zeros(n, np.int64)
                for i, x in enumerate(n_links.tolist()):  # a block takes texts until it is full
                    if filled and filled + x > block_links:
                        block, filled = block + 1, 0
                    filled += x
                    places[i] = task + block
                columns = [n_a, n_b, n_groups, n_links]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), *[pa.array(x.astype(np.int64)) for x in columns], pa.array(written(a, b, of_a, of_b, at, bt)), pa.array(places), bw.lists(pa.array(code[new]), distinct), bw.lists(pa.array(times.astype(np.int32)), distinct)],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "pairs", "times"],
                )

    return run


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pairs) to (block, pair, docs): in how many of the block's texts a pair is linked."""
    for batch in batches:
        pairs = batch.column(1)
        block = np.repeat(batch.column(0).to_numpy(), pairs.value_lengths().to_numpy(zero_copy_only=False))
        code = pairs.flatten().to_numpy()
        by = np.lexsort((code, block))
        block, code = block[by], code[by]
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])][: len(code)])
        yield pa.RecordBatch.from_arrays([pa.array(block[new]), pa.array(code[new]), pa.array(np.diff(np.r_[new, len(code)]))], ["block", "pair", "docs"])


_OUT = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("n_best", "long"), ("count_sum", "long"), ("groups_sha256", "string")]


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with the counts of all of its pairs."""
    order = np.argsort(counts.column("pair").to_numpy(), kind="stable")
    pair, count, best = (counts.column(c).to_numpy()[order] for c in ("pair", "count", "best"))
    lists = docs.column("pairs").combine_chunks()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    at = np.searchsorted(pair, lists.flatten().to_numpy())
    times = docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    # sums of whole numbers, exact beyond 2**53 as well
    total, top = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    np.add.at(total, owner, times * count[at] if len(at) else times)
    np.add.at(top, owner, times * best[at] if len(at) else times)
    made = {"n_best": pa.array(top), "count_sum": pa.array(total)}
    return pa.table({c: made.get(c, docs.column(c) if c in docs.column_names else None) for c in ["id", *[c for c, _ in _OUT]]})


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = "byte_bpe_50k.tiktoken", model: str = "piece_bpe_32k.model", work: int = WORK, block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row per input row: ``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level BPE of ``ranks`` (the vocabulary of the json file of that name) over a space and the text, B the
    subword model over the text, which adds that space; strings of special tokens are ordinary
    text. A group ends where tokens of both end. Every overlapping pair of token occurrences is a link;
    the count of its id pair is the number of rows that hold the pair linked, and ``n_best``
    counts links whose count is the highest of their A id. NULL and empty texts, and texts whose
    bytes B does not give back, have no tokens. Repeated rows count each for itself; NULL
    keys are ordinary rows. Other columns are not carried. An empty table gives no rows.
    """
    import public_tokenizers

    path = lambda x: x if "/" in x else public_tokenizers.path(x)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    table = saved(rows.mapInArrow(_align(path(ranks), public_tokenizers.PATTERN, path(model), work, block_links), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, pairs array<long>, times array<int>"))
    # the joins stand on plain exchanges, so that the rows of a pair that is in every block can be split
    blocks = cut(table.select("block", "pairs").mapInArrow(_pairs_of_blocks, "block long, pair long, docs long").groupBy("block", "pair").agg(F.sum("docs").alias("docs")))
    counts = cut(blocks.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32)))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = cut(counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")))
    known = blocks.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    out = table.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scored, ", ".join([f"id {kind}", *[f"{c} {t}" for c, t in _OUT]]))
    return out.withColumnRenamed("id", key)


def op12_merge_path_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op12_merge_path_align": op12_merge_path_align}
#: None: SQL has no tokenizers. The tests hold every row against the libraries and a plain loop.
ORACLES: dict[str, str] = {}
