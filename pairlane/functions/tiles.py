"""Matrix sums over the rows of a table: each task adds up tiles, and tiles meet by key in a tree.

Rows are dense vectors of equal length in an array column. A matrix is never whole in a row or on the
driver unless one of its sides is a small parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a tile; first-round groups of a tree; bytes of rows that a task multiplies at once.
SIDE, FAN, ROWS_BYTES = 256, 256, 64 << 20


def dense(column: pa.Array, n: int) -> np.ndarray:
    """The rows of an array column as an n x length matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def tree_sum(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data): element-wise sums of float64 buffers, first over up to ``FAN`` groups of tasks (column part), then over the groups."""
    schema = ", ".join([*[f"{k} int" for k in keys], "data binary"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in group.column("data"))
        return pa.table({**{k: group.column(k).slice(0, 1) for k in keys}, "data": pa.array([total.tobytes()], pa.binary())})

    some = parts.withColumn("part", F.pmod("part", F.lit(FAN))).groupBy(*keys, "part")
    return some.applyInArrow(add, schema).groupBy(*keys).applyInArrow(add, schema)


def _emitted(keys: dict[str, int], data: np.ndarray) -> pa.RecordBatch:
    names = [*keys, "part", "data"]
    values = [pa.array([v], pa.int32()) for v in [*keys.values(), TaskContext.get().partitionId()]]
    return pa.RecordBatch.from_arrays([*values, pa.array([np.ascontiguousarray(data, np.float64).tobytes()], pa.binary())], names)


def summed(rows: DataFrame, vec: str, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum of ``of(matrix of rows)`` over all rows, a matrix with one bounded side, which comes to the driver; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(dense(batch.column(0), batch.num_rows))
                total = part if total is None else total + part
        if total is not None:
            total = np.atleast_2d(total)
            for tile, low in enumerate(range(0, len(total), SIDE)):
                yield _emitted({"tile": tile}, total[low : low + SIDE])

    width = np.atleast_2d(of(np.zeros((1, _length(rows, vec))))).shape[1]
    got = tree_sum(rows.select(F.col(vec).alias("v")).mapInArrow(run, "tile int, part int, data binary"), ["tile"]).collect()
    if not got:
        return None
    return np.concatenate([np.frombuffer(r["data"]).reshape(-1, width) for r in sorted(got, key=lambda r: r["tile"])])


def _length(rows: DataFrame, vec: str) -> int:
    first = rows.select(F.size(vec).alias("n")).first()
    return first["n"] if first else 0


def means(rows: DataFrame, vec: str) -> tuple[int, np.ndarray]:
    """(number of rows, mean of each dimension): as many numbers as a row has dimensions."""
    total = summed(rows, vec, lambda x: np.r_[x.sum(axis=0), len(x)][:, None])
    if total is None:
        return 0, np.zeros(0)
    return int(total[-1, 0]), total[:-1, 0] / total[-1, 0]


def gram(rows: DataFrame, vec: str, centre: np.ndarray) -> DataFrame:
    """(p, q, s) for p <= q: sums of products of the centred dimensions.

    A task gathers ``ROWS_BYTES`` of rows, or half as many rows as there are dimensions, and emits the upper tiles of
    their product; tiles are summed by (row block, column block), so what is shuffled is bounded by the
    tiles of these blocks and no task holds a whole matrix of all dimensions.
    """
    most = max(ROWS_BYTES // (8 * max(1, len(centre))), len(centre) // 2, 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i, low in enumerate(range(0, x.shape[1], SIDE)):
                for j, other in enumerate(range(low, x.shape[1], SIDE), i):
                    yield _emitted({"i": i, "j": j}, x[:, low : low + SIDE].T @ x[:, other : other + SIDE])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(dense(batch.column(0), batch.num_rows) - centre)
                n += batch.num_rows
            if n >= most:
                yield from tiles(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from tiles(np.concatenate(held))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                high = min(SIDE, len(centre) - SIDE * i)
                s = np.frombuffer(data).reshape(high, -1)
                p, q = np.indices(s.shape)
                p, q = p + SIDE * i, q + SIDE * j
                upper = p <= q
                yield pa.RecordBatch.from_arrays([pa.array(p[upper].astype(np.int32)), pa.array(q[upper].astype(np.int32)), pa.array(s[upper])], ["p", "q", "s"])

    parts = rows.select(F.col(vec).alias("v")).mapInArrow(products, "i int, j int, part int, data binary")
    return tree_sum(parts, ["i", "j"]).mapInArrow(entries, "p int, q int, s double")


def principal_axes(rows: DataFrame, vec: str, k: int, extra: int = 32, tolerance: float = 1e-12, most_passes: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, axes, variances) of the first ``k`` principal axes; axes are columns.

    Block Krylov iteration from a seeded random range of ``k + extra`` directions: a pass over the rows multiplies
    the newest block by the covariance (partial products of a few columns, summed in a tree), the block is
    made orthonormal by QR of a tall, thin matrix, and Rayleigh-Ritz vectors over all blocks are kept
    when a restart is due. The covariance itself is never formed. Passes end when the residuals
    of the first ``k`` pairs are below ``tolerance`` times the largest variance. Axes are signed so that
    their largest loading is positive; an axis without variance is 0.
    """
    n, centre = means(rows, vec)
    size = len(centre)
    k = min(k, size)
    width = min(size, k + extra)
    if n < 2 or not k:
        return centre, np.zeros((size, k)), np.zeros(k)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    value, vectors = np.zeros(k), np.zeros((size, k))
    for _ in range(most_passes):
        product = summed(rows, vec, lambda x, q=block: (x - centre).T @ ((x - centre) @ q)) / (n - 1)
        basis, image = np.hstack([basis, block]), np.hstack([image, product])
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        value, vectors = value[::-1][:k], (basis @ turn)[:, :k]
        left = np.linalg.norm((image @ turn)[:, :k] - vectors * value, axis=0)
        if left.max() <= tolerance * max(value[0], 1e-300) or basis.shape[1] >= size:
            break
        for _ in range(2):
            product = product - basis @ (basis.T @ product)
        block, weight = np.linalg.qr(product)
        block = block[:, np.abs(np.diag(weight)) > 1e-13 * max(value[0], 1e-300)][:, : size - basis.shape[1]]
        if not block.shape[1]:
            break
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if basis.shape[1] + width > 8 * width:  # the new block stands at right angles to all that is left out
            basis, image = (basis @ turn)[:, :width], (image @ turn)[:, :width]
    at = np.abs(vectors).argmax(axis=0)
    axes = vectors * np.where(vectors[at, np.arange(k)] > 0, 1.0, -1.0)
    return centre, np.where(value > 1e-12 * max(value[0], 1e-300), axes, 0.0), np.maximum(value, 0.0)


def projected(rows: DataFrame, vec: str, centre: np.ndarray, axes: np.ndarray, out: str) -> DataFrame:
    """``rows`` with the coordinates of ``vec`` on the axes as the array column ``out``; NULL vectors stay NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            there = v.is_valid().to_numpy(zero_copy_only=False)
            full = v.filter(pa.array(there))
            points = (dense(full, len(full)) - centre) @ axes if len(full) else np.zeros((0, axes.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * axes.shape[1], pa.int32()), pa.array(points.reshape(-1)))
            at = pa.array(np.where(there, np.cumsum(there) - 1, 0), pa.int64(), mask=~there)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.take(at)], ["row", out])

    kept = [c for c in rows.columns if c != out]
    whole = rows.select(F.struct(*kept).alias("row"), F.col(vec).alias("v"))
    done = whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, {out} array<double>")
    return done.select("row.*", out)
