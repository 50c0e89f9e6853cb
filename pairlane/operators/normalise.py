"""Normalisation, feature selection, reduction and token sequences over long matrices.

A long matrix has rows (cell_id, gene, value) for stored values only; statistics that
need the zeros divide by the number of all cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import draw, place
from pairlane.functions.storage import discard, saved
from pairlane.functions.tiles import dense, principal_axes, projected, summed
from pairlane.operators.neighbors import knn_join


def normalize_total(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """Each cell's values add up to ``target``; a cell whose sum is 0 stays 0."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.col("value") * F.lit(target) / F.when(total == 0, 1.0).otherwise(total))


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def gene_stats(expr: DataFrame, n_cells: int | None = None, floor: float = 1e-12) -> DataFrame:
    """Mean, variance (over all cells, at least 0), std (at least ``floor``) and non-zero share of each gene."""
    n = F.lit(n_cells) if n_cells is not None else F.col("_n")
    sums = expr.groupBy("gene").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"), F.count_if(F.col("value") != 0).alias("_k"))
    if n_cells is None:
        sums = sums.crossJoin(F.broadcast(expr.agg(F.count_distinct("cell_id").alias("_n"))))  # one row
    mean = F.col("_s") / n
    var = F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0))
    return sums.select("gene", mean.alias("mean"), var.alias("variance"), F.greatest(F.sqrt(var), F.lit(floor)).alias("std"), (F.col("_k") / n).alias("nonzero_frac"))


def scale_clip(expr: DataFrame, most: float) -> DataFrame:
    """z-scores of each gene over its rows (sample deviation), clipped at ``most``; dense matrices only."""
    stats = expr.groupBy("gene").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.when((F.col("_s") > 0), F.col("_s")).otherwise(1.0)
    return expr.join(stats, "gene").withColumn("value", F.least(z, F.lit(most))).drop("_m", "_s")


def _dispersion(expr: DataFrame, n_cells: int) -> DataFrame:
    """Mean and dispersion of each gene on the count scale of log values, zeros included."""
    x = F.expm1("value")
    sums = expr.groupBy("gene").agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    mean = F.col("_s") / n_cells
    var = (F.col("_q") - n_cells * mean * mean) / (n_cells - 1)
    safe = F.when(mean == 0, 1e-12).otherwise(mean)
    return sums.select("gene", mean.alias("mean"), (var / safe).alias("dispersion"))


def hvg_seurat(expr: DataFrame, n_cells: int, top: int, bins: int = 20) -> DataFrame:
    """Genes with log mean, log dispersion, its z-score within equal-width bins of the mean, rank and flag."""
    d = _dispersion(expr, n_cells).select("gene", F.log1p("mean").alias("mean"), F.when(F.col("dispersion") > 0, F.ln("dispersion")).alias("dispersion"))
    edges = d.agg(F.min("mean").alias("_low"), F.max("mean").alias("_high"))
    d = d.crossJoin(F.broadcast(edges))  # one row
    width = (F.col("_high") - F.col("_low")) / bins
    d = d.withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("mean") - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0).cast("int"))
    by = Window.partitionBy("bin")
    avg, std = F.avg("dispersion").over(by), F.stddev_samp("dispersion").over(by)
    # a bin with one gene gets deviation = its mean and mean 0, so that its score is 1
    single = std.isNull()
    z = (F.col("dispersion") - F.when(single, 0.0).otherwise(avg)) / F.when(single, avg).when(std > 0, std)
    d = d.withColumn("score", z).drop("_low", "_high")
    return _ranked(d, top)


def hvg_cell_ranger(expr: DataFrame, n_cells: int, top: int, bins: int = 20) -> DataFrame:
    """As ``hvg_seurat`` with percentile bins of the mean, the bin's median and its median absolute deviation."""
    d = _dispersion(expr, n_cells)
    cuts = d.agg(F.percentile("mean", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_cuts"))
    d = d.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("_cuts", lambda c: c < F.col("mean")))).drop("_cuts")  # one row
    mid = d.groupBy("bin").agg(F.percentile("dispersion", F.lit(0.5)).alias("_median"))
    d = d.join(mid, "bin")
    mad = d.groupBy("bin").agg(F.percentile(F.abs(F.col("dispersion") - F.col("_median")), F.lit(0.5)).alias("_mad"))
    d = d.join(mad, "bin").withColumn("score", (F.col("dispersion") - F.col("_median")) / F.when(F.col("_mad") > 0, F.col("_mad"))).drop("_median", "_mad")
    return _ranked(d, top)


def _ranked(d: DataFrame, top: int) -> DataFrame:
    """Rank by score and flag of the first ``top``. Scores are compared at nine decimals, equal ones rank by gene: the genes of any
    bin with two have +-sqrt(1/2) (or +-1), and the last bits of that are chance."""
    rank = F.row_number().over(Window.orderBy(F.round("score", 9).desc_nulls_last(), "gene"))
    return d.withColumn("hv_rank", rank).withColumn("highly_variable", (rank <= top) & F.col("score").isNotNull())


def select_program_genes(stats: DataFrame, least_mean: float, least_frac: float, top: int) -> DataFrame:
    """Flag the ``top`` genes by variance among those with enough mean and non-zero share."""
    good = stats.where((F.col("mean") >= least_mean) & (F.col("nonzero_frac") >= least_frac) & ~F.isnan("variance")).orderBy(F.desc("variance"), "gene").limit(top).select("gene", F.lit(True).alias("selected"))
    return stats.join(good, "gene", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def control_zscore(expr: DataFrame, stats: DataFrame) -> DataFrame:
    """z-scores with given gene statistics, centred and scaled again over the rows (sample deviation; tiny ones count as 1)."""
    z = expr.join(stats.select("gene", "mean", "std"), "gene").withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")
    again = z.groupBy("gene").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    spread = F.when(F.col("_s") > 1e-12, F.col("_s")).otherwise(1.0)
    return z.join(again, "gene").withColumn("value", (F.col("value") - F.col("_m")) / spread).drop("_m", "_s")


def pca(cells: DataFrame, fit_on: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """Components (column pca) of ``cells`` under a PCA of ``fit_on``: centred, and signed so that each axis' largest loading is positive.

    The axes come from passes over ``fit_on`` that multiply a few directions at once; nothing of size genes x genes is
    formed. Axes beyond the rank of ``fit_on`` are 0.
    """
    fitted = saved(fit_on.select(vec))
    centre, axes, _ = principal_axes(fitted, vec, k)
    discard(fitted)
    return projected(cells, vec, centre, axes, "pca")


def knn(queries: DataFrame, points: DataFrame, k: int, key: str = "cell_id", vec: str = "vec") -> DataFrame:
    """The ``k`` nearest points of each query (ties by id), not itself."""
    return knn_join(queries, points, k, key, vec)[0]


def group_means(expr: DataFrame, by: list[str], members: DataFrame) -> DataFrame:
    """Mean of each gene over all members of a group; members without a stored value count as 0."""
    size = members.groupBy(*by).agg(F.count("*").alias("n_cells"))
    sums = expr.groupBy(*by, "gene").agg(F.sum("value").alias("total"))
    return sums.join(size, by).withColumn("mean", F.col("total") / F.col("n_cells"))


def metacells(expr: DataFrame, membership: DataFrame) -> DataFrame:
    """Mean profile and size of each metacell."""
    return group_means(expr.join(membership, "cell_id"), ["metacell_id"], membership)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each row's nearest centre, the smallest of equal ones; squared distances to all centres)."""
    d = np.zeros((len(x), len(centres)))
    for i in range(x.shape[1]):
        d += (x[:, i, None] - centres[None, :, i]) ** 2
    return d.argmin(axis=1) if len(centres) else np.zeros(len(x), np.int64), d


def seeded_centres(drawn: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the drawn rows: the first one, then always the row farthest from all that were taken (the first of equal ones)."""
    taken = [0]
    d = nearest_centre(drawn, drawn[:1])[1][:, 0]
    while len(taken) < min(n, len(drawn)):
        rest = d.copy()
        rest[taken] = -1.0
        taken.append(int(rest.argmax()))
        d = np.minimum(d, nearest_centre(drawn, drawn[taken[-1:]])[1][:, 0])
    return drawn[taken]


def assign_metacells(cells: DataFrame, n: int, seed: int, vec: str = "vec", key: str = "cell_id", oversample: int = 4, rounds: int = 20) -> DataFrame:
    """(key, metacell_id): k-means on the embedding, the same for any partitioning. The reference algorithm is an archetype fit; this one differs.

    ``oversample * n`` cells are drawn by a seeded hash, and ``n`` of them that lie far apart are the
    first centres. In each round a cell belongs to its nearest centre (the first of equal ones), and tasks sum
    their cells by centre, so only ``n`` rows of sums are gathered; rounds end when no centre moves. A centre
    without cells stays where it is, and its metacell is empty. Fewer cells than ``n`` give as many metacells;
    cells without a vector are left out.
    """
    ready = saved(cells.where(F.col(vec).isNotNull()).select(F.col(key), F.transform(vec, lambda x: x.cast("double")).alias("v")))
    drawn = [r["v"] for r in ready.orderBy(draw("metacell", seed, F.col(key)), key).limit(oversample * n).collect()]
    centres = seeded_centres(np.array(drawn, np.float64), n) if drawn else np.zeros((0, 1))
    for _ in range(rounds if drawn else 0):

        def sums(x: np.ndarray, at: np.ndarray = centres) -> np.ndarray:
            own = np.eye(len(at))[nearest_centre(x, at)[0]]
            return own.T @ np.c_[x, np.ones(len(x))]

        total = summed(ready, "v", sums)
        size = total[:, -1:]
        moved = np.where(size > 0, total[:, :-1] / np.maximum(size, 1), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index = nearest_centre(dense(batch.column(1), batch.num_rows), centres)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"mc_{i}" for i in index.tolist()])], [key, "metacell_id"])

    return ready.mapInArrow(assign, f"{key} {ready.schema[key].dataType.simpleString()}, metacell_id string")


def rank_tokens(expr: DataFrame, most: int = 2048) -> DataFrame:
    """Per cell the token ids of its non-zero genes, largest values first (ties by gene position), at most ``most``."""
    ranked = expr.where("value > 0").withColumn("_n", place(["cell_id"], F.desc("value"), "gene_pos")).where(F.col("_n") <= most)
    lists = ranked.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("_n", "token_id"))).alias("_t"))
    return lists.select("cell_id", F.transform("_t", lambda x: x["token_id"]).alias("tokens"))


def gene_value_sequence(expr: DataFrame, cls_id: int, pad_value: float = 0.0) -> DataFrame:
    """Per cell (gene id, value) over non-zeros by gene, after a class item."""
    lists = expr.where("value <> 0").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct(F.col("gene_id").cast("int").alias("gene_id"), F.col("value").cast("double").alias("value")))).alias("_s"))
    head = F.array(F.struct(F.lit(cls_id).cast("int").alias("gene_id"), F.lit(pad_value).cast("double").alias("value")))
    return lists.select("cell_id", F.concat(head, "_s").alias("sequence"))


def mean_pool(rows: DataFrame, mask: str = "mask") -> DataFrame:
    """Mean of each dimension over the rows that the mask keeps."""
    return rows.where(F.col(mask)).groupBy("cell_id", "dim").agg(F.avg("value").alias("value"))


def l2_normalize(vec):
    """The array over its norm; a zero norm counts as 1."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
