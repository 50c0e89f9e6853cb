"""N-gram Jaccard join by MinHash banding.

Texts with the same words are one class from the start, so groups of copies of any size
cost one row each. A class's signature is cut into bands; band hashes are shuffled, and
classes that share a bucket are tied to the bucket's smallest member (one edge a member,
never all pairs). The components of that graph are the only places where links can be.
Components are cut into blocks of about ``BLOCK_WORDS`` words and 256 classes at most (a longer
text is a block by itself, or shares it with what stands before), and two blocks meet in a task if
some bucket has members in both. There the full n-gram sets give every pair's similarity
in one matrix product; a task returns, per class, the number of documents linked to it and
the root of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm import bytewise as bw
from pairlane.llm.common import cut, read, running, saved
from pairlane.llm.components import components

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 144
BLOCK_WORDS = 1 << 17


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows a band for which pairs at the threshold are found with ``recall``."""
    best = (1, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _signatures(ngram: int, bands: int, rows: int):
    """(row, id, text) batches to (row, id, text, k, n_words, bands)."""
    rng = np.random.default_rng(91)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    spread = bw.powers(0xC2B2AE3D27D4EB4F, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.column(batch.column(2))
            for a, b, d, off in bw.blocks(data, offsets):
                n = b - a
                w = bw.runs(~bw.SPACE[d], off)
                hashes = bw.Hasher(d)(w.start, w.end)
                x, owner = bw.shingles(hashes, w.doc, ngram)
                signature = np.full((bands * rows, n), 1 << 32, np.uint64)
                if len(x):
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    for i, f in enumerate(factors):
                        signature[i, owner[first]] = np.minimum.reduceat((x * f) >> np.uint64(32), first)
                banded = np.empty((n, bands), np.uint64)
                for i in range(bands):
                    part = signature[i * rows : (i + 1) * rows]
                    banded[:, i] = bw.mix((bw.mix(part + np.uint64(i + 1)) * spread[:, None]).sum(axis=0, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(banded.reshape(-1).view(np.int64)))
                words = pa.array(bw.counts(w.doc, n).astype(np.int64))
                own = [batch.column(i).slice(a, n) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, bw.binary(bw.sequence_keys(hashes, w.doc, n)), words, lists], ["row", "id", "_text", "k", "n_words", "bands"])

    return run


def _sets(ngram: int):
    """Texts of candidate classes to sorted n-gram sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.column(batch.column("_text"))
            rest = batch.drop_columns(["_text"])
            for a, b, d, off in bw.blocks(data, offsets):
                n = b - a
                w = bw.runs(~bw.SPACE[d], off)
                x, owner = bw.shingles(bw.Hasher(d)(w.start, w.end), w.doc, ngram)
                bounds = np.searchsorted(owner, np.arange(n + 1))
                grams = [np.unique(x[bounds[i] : bounds[i + 1]]).view(np.int64) for i in range(n)]
                own = rest.slice(a, n)
                yield pa.RecordBatch.from_arrays([*own.columns, bw.lists(pa.array(np.concatenate(grams)), np.array([len(g) for g in grams]))], [*own.schema.names, "grams"])

    return run


def links_within(keys: list[bytes], block: np.ndarray, weight: np.ndarray, grams: list[np.ndarray], threshold: float, cross: bool) -> tuple[np.ndarray, list[bytes]]:
    """Per class: weight of the classes linked to it here, and the smallest class that its links reach.

    ``cross``: only links between the two blocks count (each block's own are counted elsewhere).
    """
    m = len(keys)
    size = np.array([len(g) for g in grams], np.float64)
    owner = np.repeat(np.arange(m), size.astype(np.int64))
    _, gram, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[gram]
    owner, gram = owner[keep], column[gram[keep]]
    by = np.argsort(gram, kind="stable")
    owner, gram = owner[by], gram[by]
    both = np.zeros((m, m), np.float32)
    width = 8192
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(gram, [low, low + width])
        part = np.zeros((m, min(width, int(shared.sum()) - low)), np.float32)
        part[owner[a:b], gram[a:b] - low] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    linked = (both > 0) & (both >= threshold * union - 1e-9)
    np.fill_diagonal(linked, False)
    if cross:
        linked &= block[:, None] != block[None, :]
    root = np.arange(m)
    while True:  # smallest reachable class, by repeated minima over the links
        best = np.minimum(root, np.where(linked, root[None, :], m).min(axis=1, initial=m))
        best = best[best]
        if (best == root).all():
            break
        root = best
    return linked @ weight, [keys[i] for i in root]


def _verify(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        own = group.sort_by("k")
        keys = own.column("k").to_pylist()
        sets = own.column("grams").combine_chunks()
        grams = np.split(sets.flatten().to_numpy(), np.cumsum(pc.list_value_length(sets).to_numpy())[:-1])
        cross = own.column("a")[0].as_py() != own.column("b")[0].as_py()
        links, root = links_within(keys, own.column("block").to_numpy(), own.column("weight").to_numpy(), grams, threshold, cross)
        hit = np.flatnonzero(links > 0).tolist()
        return pa.table({"k": pa.array([keys[i] for i in hit], pa.binary()), "links": pa.array(links[hit].astype(np.int64)), "root": pa.array([root[i] for i in hit], pa.binary())})

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """One row per input row: ``key``, ``class_id``, ``n_links``, ``n_words``.

    ``n_links``: other documents whose word n-gram sets have a Jaccard similarity of at least
    ``threshold`` with this one's, copies included; ``class_id``: smallest key among all that
    links reach. A text of 1 to ngram-1 words has one n-gram, the whole text. Texts without
    words (NULL, empty, white space) have no n-grams and no links. NULL keys are ordinary
    rows (their class has a NULL id if no other key is in it). Equal keys with different texts
    are different documents. Other columns are not carried. An empty table gives no rows.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("_text"))
    table = saved(numbered.mapInArrow(_signatures(ngram, bands, rows), f"row long, id {kind}, _text string, k binary, n_words long, bands array<long>"))
    # one row stands for a class, whatever ids its rows have
    classes = cut(table.where("n_words > 0").groupBy("k", "bands").agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.min("n_words").alias("n_words"), F.count("*").alias("weight")))

    spread = classes.select("k", F.posexplode("bands").alias("band", "hash"))
    buckets = spread.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("k").alias("root")).where("n > 1").drop("n")
    buckets = cut(buckets)  # so that the join stands on plain exchanges and a common bucket can be split
    member = cut(spread.join(buckets, ["band", "hash"]))
    area = components(member.select(F.col("k").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "k", "root": "area"})

    # blocks of each area; classes that agree in the first band stand together
    cost = F.greatest("n_words", F.lit(BLOCK_WORDS // 256))
    place = area.join(classes.select("k", "row", "weight", cost.alias("cost"), F.md5(F.col("bands")[0].cast("string")).alias("_near")), "k").withColumn("_part", F.substring("_near", 1, 3))
    place = running(place, ["area"], "_part", ["_near", "k"], F.col("cost"), "_n")
    place = cut(place.select("k", "area", "row", "weight", F.floor((F.col("_n") - 1) / BLOCK_WORDS).cast("int").alias("block")))
    at = member.join(place.select("k", "area", "block"), "k").select("area", "band", "hash", "block").distinct()
    meet = at.select("area", "band", "hash", F.col("block").alias("a")).join(at.select("area", "band", "hash", F.col("block").alias("b")), ["area", "band", "hash"]).where("a <= b")
    meet = meet.select("area", "a", "b").distinct()
    ends = F.array_distinct(F.array("a", "b"))
    tasks = meet.select("area", F.explode(ends).alias("block"), F.struct("a", "b").alias("task")).groupBy("area", "block").agg(F.collect_list("task").alias("tasks"))
    wanted = place.join(tasks, ["area", "block"])

    source = table.select("row", "_text").join(wanted, "row").select("_text", "k", "area", "block", "weight", "tasks")
    sets = source.mapInArrow(_sets(ngram), "k binary, area binary, block int, weight long, tasks array<struct<a:int,b:int>>, grams array<long>")
    dealt = sets.select("k", "area", "block", "weight", "grams", F.explode("tasks").alias("task")).select("*", "task.a", "task.b").drop("task")
    found = cut(dealt.groupBy("area", "a", "b").applyInArrow(_verify(threshold), "k binary, links long, root binary"))

    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("k").alias("a"), F.col("root").alias("b")))
    named = classes.join(reach.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    lowest = cut(named.groupBy("root").agg(F.min("rep").alias("class_id")))
    named = named.join(links, "k", "left").where("weight > 1 or links > 0").join(lowest, "root")
    named = named.select("k", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = table.select("id", "k", "n_words").join(cut(named), "k", "left")
    return out.select(
        F.col("id").alias(key), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_words"
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_ngram_join": op2_ngram_join}
#: None: connected components and set similarity are held against brute force in the tests.
ORACLES: dict[str, str] = {}
