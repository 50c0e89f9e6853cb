"""Control-distribution and effect-preservation metrics, and the shared vector metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import cosine, dot, draw, pearson, percentiles, place, rmse, tie_rank, value_ranks
from pairlane.functions.storage import checkpointed


def pair_metrics(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y", least: int = 3, large: bool = False) -> DataFrame:
    """Pearson, Spearman (mean ranks of ties), cosine, RMSE, MAE, and both root mean squares, by group.

    ``large``: groups may hold any share of the rows (not just the genes of a profile), so ranks come from counts by value.
    """
    a, b = F.col(x), F.col(y)
    known = pairs.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    if large:
        ranked = value_ranks(value_ranks(known, by, x, "_rx"), by, y, "_ry", stored=True)
    else:
        ranked = known.withColumn("_rx", tie_rank(by, a)).withColumn("_ry", tie_rank(by, b))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"), pearson(a, b, least).alias("pearson"), pearson(F.col("_rx"), F.col("_ry"), least).alias("spearman"), cosine(a, b, least).alias("cosine"),
        rmse(a, b).alias("rmse"), F.avg(F.abs(a - b)).alias("mae"), F.sqrt(F.avg(a * a)).alias("rms_x"), F.sqrt(F.avg(b * b)).alias("rms_y"),
    )


def close_to_constant(x, relative: float = 1e-5, absolute: float = 1e-8):
    """Whether all values of a group equal its first one but for the tolerances."""
    return F.max(x) - F.min(x) <= absolute + relative * F.abs(F.min(x))


def guarded_correlation(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Pearson and Spearman of at least two pairs; NULL where a side is constant within the tolerances of ``close_to_constant``."""
    known = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    flat = known.groupBy(*by).agg((close_to_constant(F.col(x)) | close_to_constant(F.col(y))).alias("_flat"))
    out = pair_metrics(known, by, x, y, least=2).join(flat, by)
    return out.select(*by, "n", *[F.when(~F.col("_flat"), F.col(c)).alias(c) for c in ("pearson", "spearman")])


def row_pearson(a, b):
    """Pearson as an aggregate, with 1e-12 in the denominator; NULL where it is 0 without it."""
    n = F.count("*")
    spread = F.sqrt(F.var_pop(a) * n * F.var_pop(b) * n)
    return F.when(spread > 0, F.covar_pop(a, b) * n / (spread + 1e-12))


def row_cosine(a, b):
    norm = F.sqrt(F.sum(a * a) * F.sum(b * b))
    return F.when(norm > 0, F.sum(a * b) / (norm + 1e-12))


def rowwise_metrics(pairs: DataFrame, row: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per row Pearson and cosine."""
    a, b = F.col(x), F.col(y)
    return pairs.groupBy(*row).agg(row_pearson(a, b).alias("pearson"), row_cosine(a, b).alias("cosine"))


def summarize(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows (by, metric): mean, median, population std, standard error, finite n. NaN counts as missing."""
    long = df.unpivot(by, columns, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), (F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("sem"), F.count("value").alias("n_valid"))
    out = stats.join(percentiles(long, [*by, "metric"], "value", "median"), [*by, "metric"])
    return out.select(*by, "metric", "mean", "median", "std", "sem", "n_valid")


def summarize_numeric(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row per group: mean, sample std, median, min, max and count of every column."""
    out = []
    for c in columns:
        v = F.when(~F.isnan(c), F.col(c))
        out += [F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"), F.count(v).alias(f"{c}_n")]
    long = df.unpivot(by, columns, "_metric", "_value").where(~F.isnan("_value"))
    middle = percentiles(long, [*by, "_metric"], "_value", "_median").groupBy(*by).agg(*[F.max(F.when(F.col("_metric") == c, F.col("_median"))).alias(f"{c}_median") for c in columns])
    whole = df.groupBy(*by).agg(*out).join(middle, by, "left")
    return whole.select(*by, *[f"{c}_{s}" for c in columns for s in ("mean", "std", "median", "min", "max", "n")])


def dimension_stats(expr: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population variance of every gene of dense rows, by group."""
    return expr.groupBy(*by, "gene").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


def profile_metrics(pseudo: DataFrame, control: DataFrame, by: list[str]) -> DataFrame:
    """Mean and variance profiles of ``pseudo`` (by, gene, value) against ``control`` (gene, value)."""
    p = dimension_stats(pseudo, by)
    c = dimension_stats(control, []).select("gene", F.col("mean").alias("_m"), F.col("variance").alias("_v"))
    both = p.join(c, "gene")
    r, v = pearson(F.col("mean"), F.col("_m")), pearson(F.col("variance"), F.col("_v"))
    return both.groupBy(*by).agg(
        r.alias("mean_pearson"), (r * r).alias("mean_r2"), rmse(F.col("mean"), F.col("_m")).alias("mean_rmse"), v.alias("variance_pearson"), (v * v).alias("variance_r2"), rmse(F.col("variance"), F.col("_v")).alias("variance_rmse"),
        pearson(F.log1p("variance"), F.log1p("_v")).alias("log_variance_pearson"), F.percentile(F.col("variance") / (F.col("_v") + 1e-12), F.lit(0.5)).alias("variance_ratio_median"),
    )


def centroid_metrics(pseudo: DataFrame, control: DataFrame, by: list[str]) -> DataFrame:
    """Distance of the centroids and ratio of the total variances, over given dimensions (gene column); ``control`` may have a copy for each run."""
    p, own = dimension_stats(pseudo, by), [c for c in by if c in control.columns]
    c = dimension_stats(control, own).select(*own, "gene", F.col("mean").alias("_m"), F.col("variance").alias("_v"))
    d = F.col("mean") - F.col("_m")
    return p.join(c, [*own, "gene"]).groupBy(*by).agg(F.sqrt(F.sum(d * d)).alias("centroid_distance"), F.try_divide(F.sum("variance"), F.sum("_v")).alias("total_variance_ratio"))


#: Rows of a block in the pairwise metrics: two blocks and their distances are what a task holds.
BLOCK = 1024


def project(cells: DataFrame, axes: DataFrame, vec: str = "vec") -> DataFrame:
    """``vec`` replaced by its products with the ``axes`` (axis, weights), whose number is a parameter of the experiment."""
    whole = axes.agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "weights"))), lambda x: x["weights"]).alias("_axes"))
    return cells.crossJoin(F.broadcast(whole)).withColumn(vec, F.transform("_axes", lambda w: dot(F.col(vec), w))).drop("_axes")  # one row


def _seeded_rows(rows: DataFrame, by: list[str], key: str, most: int, seed: str) -> DataFrame:
    """The first ``most`` rows of each group in a seeded order, numbered from 1 (``_n``); a group is cut down in 64 parts first."""
    spread = rows.withColumn("_d", draw(seed, F.col(key))).withColumn("_salt", F.pmod(F.hash(key), F.lit(64)))
    part = spread.withColumn("_n", place([*by, "_salt"], "_d", key)).where(F.col("_n") <= most)
    return part.withColumn("_n", place(by, "_d", key)).where(F.col("_n") <= most).drop("_d", "_salt")


def _met(own: DataFrame, by: list[str], source: str, ordered: bool, block: int) -> DataFrame:
    """Rows (``_n`` in each source) dealt to the pairs of blocks ``_a``, ``_b`` that they take part in, as ``_side`` 0 or 1."""
    own = own.withColumn("_block", F.struct(F.col(source).alias("s"), F.floor((F.col("_n") - 1) / block).alias("i")))
    blocks = own.select(*by, F.col("_block").alias("_a")).distinct()
    pairs = blocks.join(blocks.withColumnRenamed("_a", "_b"), by)
    pairs = pairs if ordered else pairs.where("_a <= _b")
    sides = [own.withColumnRenamed("_block", x).join(pairs, [*by, x]).withColumn("_side", F.lit(i)) for i, x in enumerate(("_a", "_b"))]
    return sides[0].unionByName(sides[1]).withColumn("_pair", F.to_json(F.struct("_a", "_b")))


def _matrix(table: pa.Table, vec: str) -> np.ndarray:
    return table.column(vec).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, each from its own differences, so that equal rows are equally far."""
    return np.stack([((y - row) ** 2).sum(axis=1) for row in x])


def mmd_rbf(rows: DataFrame, by: list[str], most: int = 3000, gamma_rows: int = 1000, key: str = "cell_id", vec: str = "vec", source: str = "source", block: int = BLOCK) -> DataFrame:
    """Biased RBF discrepancy of the two sources (0 and 1), diagonals included.

    The statistic is defined on a seeded sample of ``most`` rows of each source, and its width on the
    first ``gamma_rows`` pooled rows: both are the metric's own limits, so pairs stay bounded. Blocks
    of rows meet in pairs, one pair in a task, and give one sum each.
    """
    own = checkpointed(_seeded_rows(rows.select(*by, source, key, vec), [*by, source], key, most, "mmd"))
    pooled = own.withColumn("_i", place(by, source, "_n")).where(F.col("_i") <= gamma_rows)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)

    def width(names, table):
        d = np.concatenate([np.zeros(0), *[_squares(x[i : i + 1], x[:i])[0] for x in [_matrix(table, vec)] for i in range(1, len(x))]])
        d = d[d > 0]
        return pa.Table.from_pylist([dict(zip(by, [n.as_py() for n in names], strict=True)) | {"gamma": float(1 / np.median(d)) if len(d) else None}], pa.schema([*[table.schema.field(c) for c in by], ("gamma", pa.float64())]))

    gamma = pooled.select(*by, vec).groupBy(*by).applyInArrow(width, f"{kinds}, gamma double")

    def kernel(names, table):
        side, where = np.asarray(table.column("_side")), np.asarray(table.column(source))
        x, g = _matrix(table, vec), table.column("gamma")[0].as_py()
        a, b = int(where[side == 0][0]), int(where[side == 1][0])
        total = float(np.exp(-g * _squares(x[side == 0], x[side == 1])).sum()) if g is not None else None
        twice = 2 if a == b and table.column("_a")[0] != table.column("_b")[0] else 1
        own = dict(zip(by, [n.as_py() for n in names], strict=False))
        return pa.Table.from_pylist([own | {"a": a, "b": b, "gamma": g, "total": total * twice if g is not None else None, "n": int((side == 0).sum() * (side == 1).sum() * twice)}], pa.schema([*[table.schema.field(c) for c in by], ("a", pa.int32()), ("b", pa.int32()), ("gamma", pa.float64()), ("total", pa.float64()), ("n", pa.int64())]))

    met = _met(own, by, source, False, block).join(gamma, by)
    sums = met.groupBy(*by, "_pair").applyInArrow(kernel, f"{kinds}, a int, b int, gamma double, total double, n long")
    mean = lambda i, j: F.sum(F.when((F.col("a") == i) & (F.col("b") == j), F.col("total"))) / F.sum(F.when((F.col("a") == i) & (F.col("b") == j), F.col("n")))
    return sums.groupBy(*by).agg(F.max("gamma").alias("gamma"), (mean(0, 0) + mean(1, 1) - 2 * mean(0, 1)).alias("mmd2"))


def source_mixing(rows: DataFrame, by: list[str], k: int = 30, most: int = 10_000, key: str = "cell_id", vec: str = "vec", source: str = "source", block: int = BLOCK) -> DataFrame:
    """Mean share of the k nearest rows (not itself, ties by source and id) that come from the other source.

    Defined on a seeded sample of ``most`` rows of each source, the metric's own limit. Blocks of
    rows meet in pairs, one pair in a task, and give k candidates a row.
    """
    own = checkpointed(_seeded_rows(rows.select(*by, source, key, vec), [*by, source], key, most, "mixing"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    kind = rows.schema[key].dataType.simpleString()

    def nearest(names, table):
        side, where, x = np.asarray(table.column("_side")), np.asarray(table.column(source)), _matrix(table, vec)
        ids = table.column(key).to_numpy()
        q, p = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        d = _squares(x[q], x[p])
        d[(ids[q][:, None] == ids[p][None, :]) & (where[q][:, None] == where[p][None, :])] = np.inf
        by_id = np.lexsort((ids[p], where[p]))
        best = by_id[np.argsort(d[:, by_id], axis=1, kind="stable")[:, :k]]
        far = np.take_along_axis(d, best, axis=1)
        row, col = np.nonzero(np.isfinite(far))
        at = p[best[row, col]]
        out = [pa.array([n.as_py()] * len(row), table.schema.field(c).type) for c, n in zip(by, names, strict=False)]
        return pa.table([*out, pa.array(ids[q[row]]), pa.array(where[q[row]].astype(np.int32)), pa.array(ids[at]), pa.array(where[at].astype(np.int32)), pa.array(far[row, col])], names=[*by, "_ka", "_sa", "_kb", "_sb", "_d"])

    found = _met(own, by, source, True, block).groupBy(*by, "_pair").applyInArrow(nearest, f"{kinds}, _ka {kind}, _sa int, _kb {kind}, _sb int, _d double")
    near = found.withColumn("_n", place([*by, "_ka", "_sa"], "_d", "_sb", "_kb")).where(F.col("_n") <= k)
    share = near.groupBy(*by, "_ka", "_sa").agg(F.avg(F.when(F.col("_sa") != F.col("_sb"), 1.0).otherwise(0.0)).alias("share"))
    return share.groupBy(*by).agg(F.avg("share").alias("mixing"), F.avg(F.when(F.col("_sa") == 0, F.col("share"))).alias("mixing_control"), F.avg(F.when(F.col("_sa") == 1, F.col("share"))).alias("mixing_pseudo"))


def control_report(pseudo: DataFrame, control: DataFrame, points: DataFrame, pairs: DataFrame, used: DataFrame, n_metacells: DataFrame, by: list[str], most: int = 3000, gamma_rows: int = 1000, k: int = 30, overlap: int = 10_000) -> DataFrame:
    """Every control metric of a run in one row.

    ``pseudo`` and ``control``: long rows; ``points``: rows of both sources (0, 1) in the projected space;
    ``pairs``: control ids; ``used`` (used_id): metacells; ``n_metacells``: one row, their number.
    """
    flat = points.select(*by, "source", F.posexplode("vec").alias("gene", "value"))
    centre = centroid_metrics(flat.where("source = 1").drop("source"), flat.where("source = 0").drop("source").select("gene", "value", *by), by)
    out = profile_metrics(pseudo, control, by).join(centre, by).join(mmd_rbf(points, by, most, gamma_rows), by).join(source_mixing(points, by, k, overlap), by)
    return out.join(duplicate_stats(pairs, by), by).join(metacell_coverage(used, by, n_metacells), by)


def metacell_coverage(used: DataFrame, by: list[str], n_metacells: DataFrame, used_id: str = "used_id") -> DataFrame:
    """Metacells covered, their share of all (``n_metacells``: one row), normalised entropy of the uses, and the largest share."""
    from pairlane.operators.pairing import usage_entropy

    counts = used.groupBy(*by, used_id).agg(F.count("*").alias("times"))
    total = counts.groupBy(*by).agg((F.max("times") / F.sum("times")).alias("max_share"))
    out = usage_entropy(counts, by).join(total, by)
    return out.crossJoin(F.broadcast(n_metacells)).select(*by, F.col("n_used").alias("n_covered"), (F.col("n_used") / F.col("n_metacells")).alias("covered_fraction"), "entropy", "max_share")


def duplicate_stats(pairs: DataFrame, by: list[str], used: str = "control_id") -> DataFrame:
    return pairs.groupBy(*by).agg(F.count_distinct(used).alias("n_unique"), (1 - F.count_distinct(used) / F.count("*")).alias("duplicate_rate"))


def eligible_labels(rows: DataFrame, label: str, least: int) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= least)


def effect_deltas(treated: DataFrame, pseudo: DataFrame, control: DataFrame, by: list[str], label: str = "perturbation") -> DataFrame:
    """Per (run, label, gene): mean(treated) - mean(pseudo) as ``strategy_delta`` and mean(treated) - mean(control) as ``common_delta``."""
    t = treated.groupBy(label, "gene").agg(F.avg("value").alias("_t"))
    p = pseudo.groupBy(*by, label, "gene").agg(F.avg("value").alias("_p"))
    c = control.groupBy("gene").agg(F.avg("value").alias("_c"))
    both = p.join(t, [label, "gene"]).join(c, "gene")
    return both.select(*by, label, "gene", (F.col("_t") - F.col("_p")).alias("strategy_delta"), (F.col("_t") - F.col("_c")).alias("common_delta"))


def effect_similarity(deltas: DataFrame, by: list[str]) -> DataFrame:
    return pair_metrics(deltas.select(*by, F.col("strategy_delta").alias("x"), F.col("common_delta").alias("y")), by)


def effect_topk(deltas: DataFrame, by: list[str], k: int) -> DataFrame:
    """On the k genes with the largest common effect: similarity, sign agreement, and overlap with the k of the strategy's."""
    w = deltas.withColumn("_c", place(by, F.abs(F.col("common_delta")).desc(), "gene")).withColumn("_s", place(by, F.abs(F.col("strategy_delta")).desc(), "gene"))
    top = w.where(F.col("_c") <= k)
    metrics = pair_metrics(top.select(*by, F.col("strategy_delta").alias("x"), F.col("common_delta").alias("y")), by).select(*by, "pearson", "spearman", "cosine")
    agree = top.groupBy(*by).agg(F.avg(F.when(F.signum("strategy_delta") == F.signum("common_delta"), 1.0).otherwise(0.0)).alias("sign_agreement"), (F.count_if(F.col("_s") <= k) / F.count("*")).alias("overlap"))
    return metrics.join(agree, by)


def effect_table(deltas: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """All similarity columns of every run and perturbation, and those on the top genes as ``top<k>_...``."""
    out = effect_similarity(deltas, by)
    for k in ks:
        top = effect_topk(deltas, by, k)
        out = out.join(top.select(*by, *[F.col(c).alias(f"top{k}_{c}") for c in top.columns if c not in by]), by)
    return out


def effect_report(table: DataFrame, run: list[str], variant: list[str], label: str = "perturbation") -> DataFrame:
    """The three tables of the report as one: each perturbation's values, and their summaries by run and by variant (``level``)."""
    metrics = [c for c in table.columns if c not in (*run, label)]
    doubles = table.select(*run, label, *[F.col(c).cast("double").alias(c) for c in metrics])
    parts = [("perturbation", [*run, label]), ("run", run), ("variant", variant)]
    none = {c: F.lit(None).cast(t) for c, t in table.select(*run, label).dtypes}
    out = [summarize(doubles, by, metrics).select(F.lit(level).alias("level"), *[F.col(c) if c in by else none[c].alias(c) for c in none], "metric", "mean", "median", "std", "sem", "n_valid") for level, by in parts]
    return reduce(lambda a, b: a.unionByName(b), out)


def window_rank(by: list[str], order):
    return F.row_number().over(Window.partitionBy(*by).orderBy(order))
