"""Exact nearest-neighbour join with pivots and triangle-inequality bounds.

Points are dealt to the cell of their nearest pivot. A query first visits its nearest cells, just enough of them to
hold ``k`` points, which bounds the distance of its k-th neighbour; then only cells that can still
hold a nearer point by the triangle inequality. Cells are split into parts of bounded size, a query
goes to each part of a cell, and a task compares blocks by array operations and keeps ``k`` rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import draw
from pairlane.functions.storage import checkpointed, saved
from pairlane.functions.tiles import dense

#: Pivots (their vectors are in every task); points in a part of a cell; distances held at once.
PIVOTS, PART, HELD = 64, 20_000, 2_000_000
#: Bounds are loosened by this share, so that rounding never loses a neighbour.
_SLACK = 1e-9


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1)) if len(x) else np.zeros((0, len(pivots)))


def _assigned(pivots: np.ndarray, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _to_pivots(dense(batch.column(1), batch.num_rows) if batch.num_rows else np.zeros((0, pivots.shape[1])), pivots)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "d"])

    return run


def _visits(pivots: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, again: bool):
    """Cells that each query visits: at first the nearest ones with more than ``k`` points, again those that its bound leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            d = _to_pivots(dense(batch.column(1), n), pivots)
            order = np.argsort(np.where(count > 0, d, np.inf), axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            near = np.zeros(d.shape, bool)
            np.put_along_axis(near, order, before < k + 1, axis=1)
            near &= count > 0
            if again:
                bound = np.array(batch.column(2).to_numpy(zero_copy_only=False), np.float64)
                bound = np.where(np.isnan(bound), np.inf, bound) * (1 + _SLACK) + 1e-12
                home = d.min(axis=1)
                nearest = np.maximum(np.maximum(d - high, low - d), (d - home[:, None]) / 2)  # no point of the cell is nearer
                near = ~near & (count > 0) & (nearest * (1 - _SLACK) <= bound[:, None])
            q, cell = np.nonzero(near)
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    return run


def nearest_within(queries: np.ndarray, query_rank: np.ndarray, points: np.ndarray, point_rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance) of the k nearest points of each query, equal distances by rank, a rank never with itself."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, HELD // max(1, len(points)))
    for first in range(0, len(queries), step):
        q = queries[first : first + step]
        d = np.zeros((len(q), len(points)))
        for i in range(queries.shape[1]):  # one dimension after another, as a plain loop would add them
            d += (q[:, i, None] - points[None, :, i]) ** 2
        d[query_rank[first : first + step, None] == point_rank[None, :]] = np.inf
        last = np.partition(d, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
        at, point = np.nonzero((d <= last[:, None]) & np.isfinite(d))
        by = np.lexsort((point_rank[point], d[at, point], at))
        at, point = at[by], point[by]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < k
        found.append((first + at[keep], point[keep], d[at[keep], point[keep]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compared(k: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = {"query_id": queries.schema.field("id").type, "neighbor_id": points.schema.field("id").type}
        names = ["query_id", "neighbor_id", "d2", "pairs"]
        if not points.num_rows or not queries.num_rows:
            return pa.table({**{c: pa.array([], t) for c, t in kinds.items()}, "d2": pa.array([], pa.float64()), "pairs": pa.array([], pa.int64())}).select(names)
        own, other = points.column("id").combine_chunks(), queries.column("id").combine_chunks()
        rank = np.unique(pc.rank(pa.concat_arrays([own, other]), tiebreaker="min").to_numpy(), return_inverse=True)[1]
        x, y = (dense(t.column("v").combine_chunks(), t.num_rows) for t in (points, queries))
        q, p, d2 = nearest_within(y, rank[len(own) :], x, rank[: len(own)], k)
        pairs = np.zeros(len(q), np.int64)
        pairs[np.r_[True, q[1:] != q[:-1]][: len(q)]] = len(own)  # once a query
        return pa.table([other.take(pa.array(q)), own.take(pa.array(p)), pa.array(d2), pa.array(pairs)], names=names)

    return run


def knn_join(queries: DataFrame, points: DataFrame, k: int, key: str = "cell_id", vec: str = "vec", pivots: int = PIVOTS, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest points of each query (query_id, neighbor_id, d2, rank; ties by id), not itself, and the work.

    The work is one row: pairs that were compared and pairs in all. Fewer than ``k`` points give fewer rows. Rows
    without a vector take no part; keys are unique. Up to ``pivots`` points, drawn by a hash of the
    key, are collected as pivots.
    """
    points = points.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    queries = queries.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    chosen = [r["v"] for r in points.orderBy(draw("pivot", F.col("id")), "id").limit(pivots).collect()]
    kind = points.schema["id"].dataType.simpleString()
    out = f"query_id {queries.schema['id'].dataType.simpleString()}, neighbor_id {kind}, d2 double, pairs long"
    if not chosen:
        none = points.sparkSession.createDataFrame([], out)
        return none.select("query_id", "neighbor_id", "d2", F.lit(1).alias("rank")), none.agg(F.lit(0).cast("long").alias("compared"), F.lit(0).cast("long").alias("pairs"))
    at = np.array(chosen, np.float64)
    cells = saved(points.mapInArrow(_assigned(at, part), f"id {kind}, v array<double>, cell int, d double"))
    count, low, high = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect():  # one row a pivot
        count[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    parts = np.maximum(1, -(-count // part)).tolist()
    of_cell = F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)
    dealt = cells.select("id", "v", "cell", F.pmod(F.xxhash64("id"), of_cell).cast("int").alias("part"))

    def visited(rows: DataFrame, again: bool) -> DataFrame:
        wanted = rows.mapInArrow(_visits(at, count, low, high, k, again), queries.select("id", "v", F.lit(0).alias("cell")).schema)
        wanted = wanted.select("*", F.explode(F.sequence(F.lit(0), of_cell - 1)).alias("part"))
        return dealt.groupBy("cell", "part").cogroup(wanted.groupBy("cell", "part")).applyInArrow(_compared(k), out)

    first = checkpointed(visited(queries, False))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "neighbor_id"))
    bound = first.withColumn("n", place).where(F.col("n") == k).select("query_id", F.sqrt("d2").alias("bound"))
    second = visited(queries.join(bound, F.col("id") == F.col("query_id"), "left").select("id", "v", "bound"), True)
    both = checkpointed(first.unionByName(second))
    work = both.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("compared")).withColumn("pairs", F.lit(int(count.sum()) * queries.count()))
    return both.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "neighbor_id", "d2", "rank"), work
