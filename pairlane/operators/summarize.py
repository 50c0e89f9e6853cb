"""Aggregation over seeds, selection and comparison tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import nan_to_null, null_token
from pairlane.operators.manifest import EXPECTED_VARIANTS


def filter_by_map(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Equality or membership as text; columns that are not there are ignored."""
    for c, v in wanted.items():
        if c in df.columns:
            values = [str(x) for x in (v if isinstance(v, (list, tuple, set)) else [v])]
            df = df.where(F.col(c).cast("string").isin(values))
    return df


#: The final metrics of each task, with their formulas and source columns.
FINAL_METRICS = {
    "control_manifold": {
        "mean_expression_rmse": ("direct", ["mean_expression_rmse"]),
        "mean_expression_correlation": ("direct", ["mean_expression_pearson"]),
        "variance_pearson": ("direct", ["variance_pearson"]),
        "control_pseudo_local_mixing_score": ("direct", ["source_mixing_opposite_neighbor_fraction_mean"]),
        "pca_centroid_distance": ("direct", ["pca_mean_distance"]),
        "mmd_pca": ("direct", ["mmd_rbf_pca"]),
    },
    "perturbation_effect": {
        "perturbation_effect_rmse": ("direct", ["strategy_delta_rmse_common_mean"]),
        "perturbation_effect_pearson": ("direct", ["strategy_delta_pearson_common_mean"]),
        "perturbation_effect_magnitude_ratio": ("ratio", ["strategy_delta_norm_mean", "common_delta_norm_mean"]),
        "top100_perturbation_effect_correlation": ("direct", ["top100_common_delta_pearson_true_genes_mean"]),
    },
    "mlp_forward": {
        "input_only_mse": ("direct", ["input_only_mse_xt"]),
        "model_mse": ("direct", ["model_mse_xt"]),
        "absolute_mse_improvement": ("absolute_improvement", ["model_gain_mse_xt", "input_only_mse_xt", "model_mse_xt"]),
        "relative_mse_reduction": ("relative_reduction", ["model_gain_mse_xt_fraction", "input_only_mse_xt", "model_mse_xt"]),
        "input_only_mae": ("direct", ["input_only_mae_xt"]),
        "model_mae": ("direct", ["model_mae_xt"]),
        "absolute_mae_improvement": ("absolute_improvement", ["model_gain_mae_xt", "input_only_mae_xt", "model_mae_xt"]),
        "relative_mae_reduction": ("relative_reduction", ["input_only_mae_xt", "model_mae_xt"]),
        "input_common_reference_correlation": ("direct", ["input_common_delta_cell_pearson_mean"]),
        "model_common_reference_correlation": ("direct", ["model_common_delta_cell_pearson_mean"]),
        "absolute_correlation_improvement": ("correlation_gain", ["model_common_delta_cell_pearson_mean", "input_common_delta_cell_pearson_mean"]),
        "relative_correlation_improvement": ("relative_correlation_gain", ["model_common_delta_cell_pearson_mean", "input_common_delta_cell_pearson_mean"]),
    },
    "mlp_inverse": {
        "test_accuracy": ("direct", ["test_accuracy"]),
        "macro_f1": ("direct", ["test_macro_f1"]),
        "recall": ("direct", ["test_macro_recall"]),
        "precision": ("direct", ["test_macro_precision"]),
        "macro_auc": ("direct", ["test_macro_auc_ovr"]),
    },
}


def _source(df: DataFrame, name: str) -> Column:
    """A metric column, or the mean column of a table that has been summarised before; NULL if neither is there."""
    for c in (name, f"{name}_mean"):
        if c in df.columns:
            return nan_to_null(F.col(c).cast("double"))
    return F.lit(None).cast("double")


def _first_there(df: DataFrame, names: list[str]) -> Column:
    return next((nan_to_null(F.col(c).cast("double")) for c in names if c in df.columns), F.lit(None).cast("double"))


def _formula(kind: str, c: list[Column], given: Column) -> Column:
    """A derived metric; divisions by 0 give NULL. ``given``: whether a gain of three sources is given at all."""
    if kind == "direct":
        return c[0]
    if kind == "ratio":
        return F.try_divide(c[0], c[1])
    if kind == "absolute_improvement":
        return F.when(given, c[0]).otherwise(c[1] - c[2]) if len(c) == 3 else c[0] - c[1]
    if kind == "relative_reduction":
        return F.when(given, c[0]).otherwise(F.try_divide(c[1] - c[2], c[1])) if len(c) == 3 else F.try_divide(c[0] - c[1], c[0])
    if kind == "correlation_gain":
        return c[0] - c[1]
    if kind == "relative_correlation_gain":  # share of the headroom, in percent
        return F.try_divide(100 * (c[0] - c[1]), 1 - c[1])
    raise ValueError(f"unknown formula {kind}")


def derive_metrics(df: DataFrame, specs: dict[str, tuple[str, list[str]]], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Add the metrics of ``specs`` (name: (formula, sources)); also (metric, formula, columns, available).

    Where a gain's own column has a value anywhere, the whole metric is that column; else it is
    computed. Direct metrics bring ``<metric>_pre_std`` and ``<metric>_pre_n`` of a table that has been
    summarised before. A metric whose sources are not there is NULL, or an error if ``strict``.
    """
    report, gains = [], sorted({columns[0] for _, columns in specs.values() if len(columns) == 3})
    if gains:
        known = df.agg(*[(F.count(_source(df, g)) > 0).alias(f"_has_{i}") for i, g in enumerate(gains)])
        df = df.crossJoin(F.broadcast(known))  # one row
    added = {}
    for name, (kind, columns) in specs.items():
        needed = columns[1:] if len(columns) == 3 else columns
        there = all(c in df.columns or f"{c}_mean" in df.columns for c in needed)
        if strict and not there:
            raise ValueError(f"{name} needs {columns}")
        given = F.col(f"_has_{gains.index(columns[0])}") if len(columns) == 3 else F.lit(False)
        added[name] = _formula(kind, [_source(df, c) for c in columns], given)
        if kind == "direct":
            added[f"{name}_pre_std"] = _first_there(df, [f"{columns[0]}_std"])
            added[f"{name}_pre_n"] = _first_there(df, [f"{columns[0]}{x}" for x in ("_n", "_count", "_n_valid")])
        report.append((name, kind, "|".join(columns), there))
    out = df.withColumns(added).drop(*[f"_has_{i}" for i in range(len(gains))])
    return out, df.sparkSession.createDataFrame(report, "metric string, formula string, columns string, available boolean")


def mode_or_first(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Most frequent value that is not NULL; of equally frequent ones the smallest."""
    n = df.where(F.col(column).isNotNull()).groupBy(*by, column).count()
    w = Window.partitionBy(*by).orderBy(F.desc("count"), column)
    return n.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "count")


def _seed_stats(df: DataFrame, metric: str) -> tuple[Column, Column, Column]:
    """Mean, sample std and n over seeds; a std or n from before stands in where one value, or none, is left."""
    v, n = nan_to_null(F.col(metric).cast("double")), F.count(nan_to_null(F.col(metric).cast("double")))
    pre = lambda x: F.min(nan_to_null(F.col(f"{metric}_pre_{x}").cast("double"))) if f"{metric}_pre_{x}" in df.columns else F.lit(None).cast("double")
    return F.avg(v), F.when(n > 1, F.stddev_samp(v)).otherwise(pre("std")), F.when(n > 0, n).otherwise(F.coalesce(pre("n").cast("long"), F.lit(0)))


def seed_aggregate_wide(df: DataFrame, by: list[str], metrics: list[str], seed: str = "sampling_seed") -> DataFrame:
    """One row per variant: mean, sample std and n of each metric; runs and seeds. One seed has no std but one from before."""
    stats = [x.alias(f"{m}_{s}") for m in metrics for s, x in zip(("mean", "std", "n"), _seed_stats(df, m), strict=True)]
    return df.groupBy(*by).agg(*stats, F.count("*").alias("n_runs"), F.count_distinct(F.when(F.col(seed) >= 0, F.col(seed))).alias("n_random_seeds"))


def seed_aggregate_long(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """The same as rows (by, metric, mean, std, n)."""
    stats = [F.struct(F.lit(m).alias("metric"), *[x.alias(s) for s, x in zip(("mean", "std", "n"), _seed_stats(df, m), strict=True)]) for m in metrics]
    return df.groupBy(*by).agg(F.array(*stats).alias("_all")).select(*by, F.explode("_all").alias("m")).select(*by, "m.*")


def variant_order(df: DataFrame) -> DataFrame:
    """Rows numbered by strategy, metacells, k, top-k and id; missing first."""
    w = Window.orderBy(*[F.col(c).asc_nulls_first() for c in ("strategy_order", "n_metacells", "k", "top_k", "variant_id")])
    return df.withColumn("sort_no", F.row_number().over(w))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; the first repeated key raises an error when they are computed."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key")).isNull()).otherwise(F.lit(True))).drop("_n")


def variant_counts(df: DataFrame, expected: dict[str, int] = EXPECTED_VARIANTS) -> DataFrame:
    """Distinct variants of each expected strategy against the expected number."""
    table = df.sparkSession.createDataFrame(list(expected.items()), "strategy_canonical string, expected long")
    found = df.groupBy("strategy_canonical").agg(F.count_distinct("variant_id").alias("found"))
    out = table.join(found, "strategy_canonical", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn("matches", F.col("found") == F.col("expected"))


def coalesce_metadata(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """First value per key, in task order, that is not missing."""
    return df.groupBy(key).agg(*[F.min_by(v, F.when(v.isNotNull(), F.col(order))).alias(c) for c in columns for v in [null_token(F.col(c).cast("string"))]])


def selection_template(base: DataFrame, tasks: dict[str, DataFrame], key: str = "variant_id") -> DataFrame:
    """Base rows with each task's statistics as ``<task>__<column>`` and columns to edit."""
    out = base
    for task, df in tasks.items():
        out = out.join(df.select(key, *[F.col(c).alias(f"{task}__{c}") for c in df.columns if c != key]), key, "left")
    return out.withColumn("select_for_final", F.lit(False)).withColumn("final_label", F.lit(None).cast("string"))


#: Colours that the variants of a strategy take in turn.
COLOURS = ["#4c72b0", "#dd8452", "#55a868", "#c44e52", "#8172b3", "#937860"]


def selected_comparison(summary: DataFrame, selection: DataFrame, key: str = "variant_id", order: str = "selection_order", label: str = "final_label") -> DataFrame:
    """Selected variants in selection order, with a number within their strategy, a label and a colour.

    The label is the one given, else the strategy's short name, numbered where it has several variants.
    """
    given = selection.select(key, order, *([label] if label in selection.columns else []))
    out = summary.join(given, key)
    own = Window.partitionBy("strategy_canonical")
    out = out.withColumn("number_in_strategy", F.row_number().over(own.orderBy(order)))
    short = F.substring("strategy_canonical", 1, 2)
    made = F.when(F.count("*").over(own) > 1, F.concat(short, F.lit(" #"), F.col("number_in_strategy").cast("string"))).otherwise(short)
    shown = F.coalesce(null_token(F.col(label)), made) if label in selection.columns else made
    return out.withColumn("display_label", shown).withColumn("colour", F.element_at(F.array(*map(F.lit, COLOURS)), (F.col("number_in_strategy") - 1) % len(COLOURS) + 1))


def reference_line(df: DataFrame, strategy: str, metric: str) -> DataFrame:
    """Mean, sample std and number of a reference strategy's values."""
    v = nan_to_null(F.col(metric))
    return df.where(F.col("strategy_canonical") == strategy).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


#: Axes of each strategy's heat map: rows, columns.
HEAT_AXES = {"S3_SEACell_metacell_average": ("n_metacells", "k"), "S4_SEACell_balanced_random_sample": ("n_metacells", None), "S5_SEACell_OT_sampled_average": ("n_metacells", "top_k")}


def heatmap_cells(df: DataFrame, metric: str, axes: dict[str, tuple[str, str | None]] = HEAT_AXES) -> DataFrame:
    """Cells of each strategy's heat map, on its own axes: mean, sample std and n of the metric."""
    pick = lambda i: F.coalesce(*[F.when(F.col("strategy_canonical") == s, F.col(x[i]).cast("double")) for s, x in axes.items() if x[i]], F.lit(None).cast("double"))
    v = nan_to_null(F.col(metric))
    cells = df.where(F.col("strategy_canonical").isin(list(axes))).groupBy("strategy_canonical", pick(0).alias("row_value"), pick(1).alias("column_value"))
    return cells.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def heatmap(df: DataFrame, rows: str, columns: str, values: list, metric: str) -> DataFrame:
    """Mean metric, rows by columns; ``values``: the column values."""
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(metric))


def merge_records(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key of several metric tables: the mean of each metric, NULL where no table has it, and how many tables have the key."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)])
    metrics = [c for c in all_.columns if c not in (*keys, "_table")]
    return all_.groupBy(*keys).agg(*[F.avg(nan_to_null(F.col(c).cast("double"))).alias(c) for c in metrics], F.count_distinct("_table").alias("n_tables"))


def ablation(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean, pooled std, total n and the variants of each setting; input has mean, std, n, variant_id."""
    return df.groupBy(*by).agg(F.avg("mean").alias("mean"), F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("pooled_std"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("variant_id")), "|").alias("variants"))


def best_per_group(df: DataFrame, by: list[str], metric: str, higher: bool, order: str) -> DataFrame:
    """Best row of each group; ties by ``order``."""
    value = F.col(metric).desc_nulls_last() if higher else F.col(metric).asc_nulls_last()
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(value, order))).where("_n = 1").drop("_n")


def error_scatter(df: DataFrame, selected: DataFrame, reference: str) -> DataFrame:
    """Selected rows with the reference's mean errors and whether they are worse."""
    ref = df.where(F.col("strategy_canonical") == reference).agg(F.avg("input_error").alias("ref_input"), F.avg("model_error").alias("ref_model"))
    out = df.join(selected, "variant_id", "left_semi").crossJoin(F.broadcast(ref))  # one row
    return out.withColumn("input_worse", F.col("input_error") > F.col("ref_input")).withColumn("model_worse", F.col("model_error") > F.col("ref_model"))


def axis_limits(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("x_low"), F.max(x).alias("x_high"), F.min(y).alias("y_low"), F.max(y).alias("y_high"))


def comparison_scatter(df: DataFrame, selected: DataFrame, reference: str, x: str, y: str, group: str, key: str = "variant_id") -> DataFrame:
    """Selected variants and the reference strategy of each group with both metrics, and the limits common to all groups."""
    chosen = df.join(selected.select(key, F.lit(True).alias("_s")).distinct(), key, "left")
    kept = chosen.where(F.col("_s") | (F.col("strategy_canonical") == reference))
    out = kept.select(group, key, "strategy_canonical", x, y, (F.col("strategy_canonical") == reference).alias("is_reference"))
    return out.crossJoin(F.broadcast(axis_limits(out, x, y)))  # one row


def values_with_fallback(seeds: DataFrame, means: DataFrame, key: str = "variant_id") -> DataFrame:
    """Seed values; variants without any take their aggregate row (source tells which)."""
    have = seeds.where("value is not null")
    rest = means.join(have.select(key), key, "left_anti").select(key, F.lit(None).cast("int").alias("sampling_seed"), F.col("mean").alias("value"), F.lit("aggregate").alias("source"))
    return have.select(key, "sampling_seed", "value", F.lit("seed").alias("source")).unionByName(rest)


def rank_tables(df: DataFrame, metrics: list[str], table: str = "table_id", variant: str = "variant_id", seed: str = "sampling_seed") -> DataFrame:
    """Candidate tables, best first, with what decides: median seeds of a variant at least 2, median, least, most, a seed column with values, metrics with values, name."""
    per = df.groupBy(table, variant).agg(F.count_distinct(seed).alias("_n"))
    s = per.groupBy(table).agg(F.percentile("_n", F.lit(0.5)).alias("median_n"), F.min("_n").alias("min_n"), F.max("_n").alias("max_n"))
    filled = sum((F.when(F.count(nan_to_null(F.col(m).cast("double"))) > 0, 1).otherwise(0) for m in metrics), F.lit(0))
    s = s.join(df.groupBy(table).agg((F.count(seed) > 0).alias("has_seed"), filled.alias("n_metrics"), F.count("*").alias("n_rows")), table)
    w = Window.orderBy(F.desc(F.col("median_n") >= 2), F.desc("median_n"), F.desc("min_n"), F.desc("max_n"), F.desc("has_seed"), F.desc("n_metrics"), table)
    return s.withColumn("table_rank", F.row_number().over(w))


def variant_stats(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean, sample std (0 for one value) and n."""
    v = nan_to_null(F.col(metric))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.count(v).alias("n"))


def fixed_variants(df: DataFrame, wanted: list[str], always: list[str], key: str = "variant_id") -> DataFrame:
    """Rows of a fixed ordered list and of the references, one for each key; a wanted one that is missing raises an error."""
    table = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys([*wanted, *always]))], f"{key} string, fixed_order int")
    joined = F.broadcast(table).join(df.withColumn("_there", F.lit(True)), key, "left")  # a fixed list
    bad = F.col("_there").isNull() & F.col(key).isin(wanted)
    checked = joined.where(F.when(bad, F.raise_error(F.lit("a variant is missing")).isNull()).otherwise(F.col("_there").isNotNull()))
    return checked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("fixed_order"))).where("_n = 1").drop("_n", "_there")


