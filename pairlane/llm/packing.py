"""Packing along a space-filling curve.

A document's tokens are hashed into a signed count vector, which a random projection takes
to ``DIMS`` dimensions; the cell of that point on a Hilbert curve is its key. Documents are
range-sorted by key (a digest and the row break ties, so a group of copies of any size is
split over partitions), laid end to end, and cut every ``LENGTH`` tokens: neighbours on the
curve share sequences, and only the last sequence of all is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm import bytewise as bw
from pairlane.llm.common import ranged, read, running, saved, seeded_digest
from pairlane.llm.tokens import Tokens

LENGTH, END_ID = 2048, 1
#: Fixed value: the special token of the 50k byte-level vocabulary.
SPECIALS = {"<|endoftext|>": 50256}
HASHED, DIMS, BITS, SEED = 256, 4, 10, 9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates below 2**bits (Skilling's transform)."""
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ t) >> b) & 1)
    return key


def _projection(vocabulary: int) -> np.ndarray:
    """Token -> its hashed, signed coordinate, projected: one row of DIMS numbers for each id."""
    h = bw.mix(np.arange(1, vocabulary + 1, dtype=np.uint64))
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    directions = np.random.default_rng(SEED).standard_normal((HASHED, DIMS))
    return (directions[(h % np.uint64(HASHED)).astype(np.int64)] * sign[:, None]).astype(np.float32)


def _id_type(vocabulary: int) -> str:
    """Little-endian ids as they are kept: two bytes where they fit, else four."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _tokenise(ranks_path: str, pattern: str, vocabulary: int, specials: dict[str, int]):
    kept = np.dtype(_id_type(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, table = Tokens(ranks_path, pattern, specials), _projection(vocabulary)
        for batch in batches:
            data, offsets = bw.column(batch.column(2))
            for a, b, d, off in bw.blocks(data, offsets):
                ids, bound = tokens.encode(d, off)
                size = np.diff(bound)
                sums = np.zeros((b - a, DIMS))
                full = np.flatnonzero(size)
                if len(full):
                    sums[full] = np.add.reduceat(table[ids], bound[full], axis=0)
                at = sums / np.sqrt(np.maximum(size, 1))[:, None]
                cells = ((at / (np.abs(at) + 4) + 1) / 2 * (1 << BITS)).astype(np.int64)
                # each text's ids and the end id
                out = np.insert(ids.astype(kept), bound[1:], END_ID)
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((np.r_[0, np.cumsum(size + 1)] * kept.itemsize).astype(np.int32)), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(hilbert(np.minimum(cells, (1 << BITS) - 1), BITS)), pa.array(size + 1), binary], ["row_id", "id", "curve", "n_tokens", "ids"]
                )

    return run


def _pieces(length: int, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array(batch.column("n_tokens"), np.int64)
            begin = np.array(batch.column("begin"), np.int64)
            number = (begin + n - 1) // length - begin // length + 1
            doc = np.repeat(np.arange(len(n)), number)
            nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(number)[:-1]], number)
            sequence = begin[doc] // length + nth
            low = np.maximum(begin[doc], sequence * length)
            high = np.minimum(begin[doc] + n[doc], (sequence + 1) * length)
            raw = [np.frombuffer(x.as_buffer(), _id_type(vocabulary)).astype("<u4") for x in batch.column("ids")]
            crc = [zlib.crc32(raw[d][a:b].tobytes()) for d, a, b in zip(doc.tolist(), (low - begin[doc]).tolist(), (high - begin[doc]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc)), *[pa.array(x) for x in (low - begin[doc], high - low, np.array(crc, np.int64), n[doc], sequence, low - sequence * length)]],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, ranks: str = "byte_bpe_50k.tiktoken", vocabulary: int = 50257, specials: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    NULL text is empty: one end id. Repeated rows are packed each for itself; NULL keys are
    ordinary rows. Other columns are not carried. An empty table gives no rows. ``ranks`` is a
    file of the public tokenizers, or a path. Strings of ``specials`` (default: ``SPECIALS``; {}
    takes them for ordinary text) in a text become their ids. Any vocabulary goes: ids take
    two bytes below 65,536 and four beyond.
    """
    import public_tokenizers

    specials = SPECIALS if specials is None else specials

    path = ranks if "/" in ranks else public_tokenizers.path(ranks)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("id"), F.col(text).alias("_text"))
    tokens = saved(rows.mapInArrow(_tokenise(path, public_tokenizers.PATTERN, vocabulary, specials), f"row_id long, id {kind}, curve long, n_tokens long, ids binary"))
    order = tokens.select("row_id", "curve", "n_tokens", seeded_digest(SEED, F.col("id")).alias("_digest"))
    placed = running(ranged(order, ["curve", "_digest", "row_id"]), [], "_part", ["curve", "_digest", "row_id"], F.col("n_tokens"), "_end")
    placed = placed.select("row_id", (F.col("_end") - F.col("n_tokens")).alias("begin"))
    joined = tokens.select("row_id", "id", "n_tokens", "ids").join(placed, "row_id").select("id", "n_tokens", "begin", "ids")
    fields = ", ".join(f"{x} long" for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    return joined.mapInArrow(_pieces(length, vocabulary), f"id {kind}, {fields}").withColumnRenamed("id", key)


def op9_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_hilbert_pack": op9_hilbert_pack}
#: None: SQL has no tokenizer. The tests hold the pieces against the library's ids.
ORACLES: dict[str, str] = {}
