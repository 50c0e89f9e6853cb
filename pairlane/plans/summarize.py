"""Seed aggregation, selection and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.exprs import as_bool, r6
from pairlane.operators import summarize as S
from pairlane.plans.evaluate import _rounded
from pairlane.plans.manifest import RUN, runs
from pairlane.plans.registry import query

#: Columns that the final metrics are made of, beside the two errors that runs have: (factor, period) of a stand-in made of the run's number.
MADE = {
    "mean_expression_rmse": (0.1, 7), "mean_expression_pearson": (0.02, 11), "variance_pearson": (0.03, 13), "source_mixing_opposite_neighbor_fraction_mean": (0.01, 17), "pca_mean_distance": (0.2, 5), "mmd_rbf_pca": (0.001, 19),
    "strategy_delta_rmse_common_mean": (0.04, 23), "strategy_delta_pearson_common_mean": (0.02, 29), "strategy_delta_norm_mean": (0.5, 9), "common_delta_norm_mean": (0.25, 6), "top100_common_delta_pearson_true_genes_mean": (0.01, 31),
    "input_only_mae_xt": (0.3, 8), "model_mae_xt": (0.2, 10), "input_common_delta_cell_pearson_mean": (0.05, 21), "model_common_delta_cell_pearson_mean": (0.04, 22),
    "test_accuracy": (0.01, 37), "test_macro_f1": (0.02, 41), "test_macro_recall": (0.01, 43), "test_macro_precision": (0.02, 47), "test_macro_auc_ovr": (0.01, 53),
}
SPECS = {name: spec for task in S.FINAL_METRICS.values() for name, spec in task.items()}


def full_runs(t):
    """Runs with every source column. The gain of the MSE is given in some rows, that of the MAE and the fraction in none."""
    made = {c: F.col("run_no") % period * factor for c, (factor, period) in MADE.items()}
    given = F.when(F.col("run_no") % 4 != 0, F.col("run_no") % 15 * 0.1)
    return runs(t).withColumns(made | {"model_gain_mse_xt": given, "model_gain_mse_xt_fraction": F.lit(None).cast("double"), "model_gain_mae_xt": F.lit(float("nan"))})


DER = RUN + ", d as (select *, input_only_mse_xt as x, model_mse_xt as y, input_only_mse_xt - model_mse_xt as imp, (input_only_mse_xt - model_mse_xt) / nullif(input_only_mse_xt, 0) as red from m)"
AGG = DER + ", ag as (select variant_id, strategy_canonical, strategy_order, avg(x) as x_mean, stddev_samp(x) as x_std, count(x) as x_n, avg(y) as y_mean, stddev_samp(y) as y_std, count(y) as y_n, count(*) as n_runs, count(distinct sampling_seed) as n_random_seeds from d group by variant_id, strategy_canonical, strategy_order)"
SD = DER + ", sd as (select variant_id, strategy_canonical, sampling_seed, avg(y) as value from d group by all)"


def derived(t):
    return S.derive_metrics(full_runs(t), SPECS)[0]


def wide(t):
    return S.seed_aggregate_wide(derived(t).select("*", F.col("input_only_mse").alias("x"), F.col("model_mse").alias("y")), ["variant_id", "strategy_canonical", "strategy_order"], ["x", "y"])


def seeds(t):
    return derived(t).groupBy("variant_id", "strategy_canonical", "sampling_seed").agg(F.avg("model_mse").alias("value"))


def _r(df, *keys):
    return _rounded(df, list(keys))


@query("filter_rows_by_map", RUN + " select run_no from m where sampling_seed in (1, 3) and s2 = 'S3'")
def _(t):
    return S.filter_by_map(runs(t), {"sampling_seed": [1, 3], "strategy_canonical": "S3_SEACell_metacell_average", "no_such_column": "x"}).select("run_no")


_FULL = RUN + ", fr as (select *, " + ", ".join(f"(run_no % {period}) * {factor}::DOUBLE as {c}" for c, (factor, period) in MADE.items()) + ", case when run_no % 4 <> 0 then (run_no % 15) * 0.1::DOUBLE end as model_gain_mse_xt from m)"
_DERIVED = {
    "mean_expression_rmse": "mean_expression_rmse", "mean_expression_correlation": "mean_expression_pearson", "variance_pearson": "variance_pearson", "control_pseudo_local_mixing_score": "source_mixing_opposite_neighbor_fraction_mean", "pca_centroid_distance": "pca_mean_distance", "mmd_pca": "mmd_rbf_pca",
    "perturbation_effect_rmse": "strategy_delta_rmse_common_mean", "perturbation_effect_pearson": "strategy_delta_pearson_common_mean", "perturbation_effect_magnitude_ratio": "strategy_delta_norm_mean / nullif(common_delta_norm_mean, 0)", "top100_perturbation_effect_correlation": "top100_common_delta_pearson_true_genes_mean",
    "input_only_mse": "input_only_mse_xt", "model_mse": "model_mse_xt", "absolute_mse_improvement": "model_gain_mse_xt", "relative_mse_reduction": "(input_only_mse_xt - model_mse_xt) / nullif(input_only_mse_xt, 0)",
    "input_only_mae": "input_only_mae_xt", "model_mae": "model_mae_xt", "absolute_mae_improvement": "input_only_mae_xt - model_mae_xt", "relative_mae_reduction": "(input_only_mae_xt - model_mae_xt) / nullif(input_only_mae_xt, 0)",
    "input_common_reference_correlation": "input_common_delta_cell_pearson_mean", "model_common_reference_correlation": "model_common_delta_cell_pearson_mean", "absolute_correlation_improvement": "model_common_delta_cell_pearson_mean - input_common_delta_cell_pearson_mean",
    "relative_correlation_improvement": "100 * (model_common_delta_cell_pearson_mean - input_common_delta_cell_pearson_mean) / nullif(1 - input_common_delta_cell_pearson_mean, 0)",
    "test_accuracy": "test_accuracy", "macro_f1": "test_macro_f1", "recall": "test_macro_recall", "precision": "test_macro_precision", "macro_auc": "test_macro_auc_ovr",
}


@query("derive_metrics", _FULL + " select run_no, " + ", ".join(f"round({x}, 5) + 0.0 as {n}" for n, x in _DERIVED.items()) + " from fr")
def _(t):
    return derived(t).select("run_no", *[(F.round(n, 5) + F.lit(0.0)).alias(n) for n in SPECS])


@query("metric_source_report", RUN + ", s as (select unnest([" + ", ".join(repr(n) for n in _DERIVED) + "]) as metric, unnest([" + ", ".join(str(n in ("input_only_mse", "model_mse", "absolute_mse_improvement", "relative_mse_reduction")).lower() for n in _DERIVED) + "]) as available) select metric, available, count(run_no) as n_runs from s, m group by all")
def _(t):
    r = runs(t)
    report = S.derive_metrics(r, SPECS, strict=False)[1].select("metric", "available")
    return report.crossJoin(F.broadcast(r.agg(F.count("run_no").alias("n_runs"))))  # one row


@query("mode_or_first", RUN + " select strategy_canonical, parameter_label from m group by strategy_canonical, parameter_label qualify row_number() over (partition by strategy_canonical order by count(*) desc, parameter_label) = 1")
def _(t):
    return S.mode_or_first(runs(t), ["strategy_canonical"], "parameter_label")


@query("seed_aggregate_wide", AGG + " select variant_id, strategy_canonical, strategy_order, round(x_mean, 6) + 0.0 as x_mean, round(x_std, 6) + 0.0 as x_std, x_n, round(y_mean, 6) + 0.0 as y_mean, round(y_std, 6) + 0.0 as y_std, y_n, n_runs, n_random_seeds from ag")
def _(t):
    return _r(wide(t), "variant_id")


@query("seed_aggregate_long", DER + ", e as (select variant_id, x, case when s2 <> 'S4' or sampling_seed = 0 and run_no = (select min(run_no) from d z where z.variant_id = d.variant_id and z.sampling_seed = 0) then y end as y, 0.25::DOUBLE as ys, 7 as yn from d where s2 <> 'S1'), e2 as (select variant_id, x, y, ys, yn from e union all select variant_id, x, null, 0.25, 7 from d where s2 = 'S1') select variant_id, 'x' as metric, round(avg(x), 6) + 0.0 as mean, round(stddev_samp(x), 6) + 0.0 as std, count(x) as n from e2 group by variant_id union all select variant_id, 'y', round(avg(y), 6) + 0.0, round(case when count(y) > 1 then stddev_samp(y) else 0.25 end, 6) + 0.0, case when count(y) > 0 then count(y) else 7 end from e2 group by variant_id")
def _(t):
    # of S4 one value is left and of S1 none, so a std and a number from before stand in
    from pyspark.sql import Window

    s2 = F.substring("strategy_canonical", 1, 2)
    nth = F.row_number().over(Window.partitionBy("variant_id", "sampling_seed").orderBy("run_no"))
    left = F.when(~s2.isin("S1", "S4") | ((s2 == "S4") & (F.col("sampling_seed") == 0) & (F.col("nth") == 1)), F.col("model_mse"))
    d = derived(t).withColumn("nth", nth).select("variant_id", F.col("input_only_mse").alias("x"), left.alias("y"), F.lit(0.25).alias("y_pre_std"), F.lit(7).alias("y_pre_n"))
    return _r(S.seed_aggregate_long(d, ["variant_id"], ["x", "y"]), "variant_id")


@query("variant_sort", RUN + ", v as (select variant_id, strategy_order, min(n_metacells) as n_metacells, min(k) as k, min(top_k) as top_k from m group by all) select variant_id, row_number() over (order by strategy_order nulls first, n_metacells nulls first, k nulls first, top_k nulls first, variant_id nulls first) as sort_no from v")
def _(t):
    v = runs(t).groupBy("variant_id", "strategy_order").agg(F.min("n_metacells").alias("n_metacells"), F.min("k").alias("k"), F.min("top_k").alias("top_k"))
    return S.variant_order(v).select("variant_id", "sort_no")


@query("assert_unique_key", AGG + " select variant_id, n_runs from ag")
def _(t):
    return S.assert_unique(wide(t), ["variant_id"]).select("variant_id", "n_runs")


@query("variant_count_check", RUN + ", e as (select unnest(['S0_naive_mean_control_reference', 'S1_random_single_control', 'S2_random_average_controls', 'S3_SEACell_metacell_average', 'S4_SEACell_balanced_random_sample', 'S5_SEACell_OT_sampled_average']) as strategy_canonical, unnest([1, 1, 1, 15, 5, 15])::BIGINT as expected), f as (select strategy_canonical, count(distinct variant_id) as found from m group by all) select strategy_canonical, expected, coalesce(found, 0) as found, coalesce(found, 0) = expected as matches from e left join f using (strategy_canonical)")
def _(t):
    return S.variant_counts(runs(t))


@query("coalesce_base_metadata", RUN + ", v as (select variant_id, min(run_no) filter (run_no % 3 = 0) as a from m group by all) select variant_id, parameter_label as label from v left join run on run.run_no = v.a")
def _(t):
    r = runs(t).withColumn("label", F.when(F.col("run_no") % 3 == 0, F.col("parameter_label")).otherwise(" nan "))
    return S.coalesce_metadata(r, "variant_id", ["label"], "run_no")


@query("selection_template", AGG + " select variant_id, round(x_mean, 6) + 0.0 as forward__mean, n_runs as inverse__n, false as select_for_final, null::VARCHAR as final_label from ag")
def _(t):
    w = wide(t)
    return S.selection_template(w.select("variant_id"), {"forward": w.select("variant_id", r6(F.col("x_mean")).alias("mean")), "inverse": w.select("variant_id", F.col("n_runs").alias("n"))})


_SEL = ", se as (select variant_id, row_number() over (order by variant_id desc) as selection_order from (select distinct variant_id from m) where variant_id like '%50%')"


def _selected(t):
    from pyspark.sql import Window

    v = runs(t).select("variant_id").distinct().where(F.col("variant_id").contains("50"))
    return v.withColumn("selection_order", F.row_number().over(Window.orderBy(F.desc("variant_id"))))


@query("selected_comparison", AGG + _SEL + ", q as (select variant_id, strategy_canonical, selection_order, row_number() over (partition by strategy_canonical order by selection_order) as number_in_strategy, count(*) over (partition by strategy_canonical) as c, y_mean from ag join se using (variant_id)) select variant_id, selection_order, number_in_strategy, round(y_mean, 6) + 0.0 as y_mean, case when selection_order = 1 then 'mine' when c > 1 then left(strategy_canonical, 2) || ' #' || number_in_strategy else left(strategy_canonical, 2) end as display_label, ['#4c72b0', '#dd8452', '#55a868', '#c44e52', '#8172b3', '#937860'][(number_in_strategy - 1) % 6 + 1] as colour from q")
def _(t):
    chosen = _selected(t).withColumn("final_label", F.when(F.col("selection_order") == 1, "mine").otherwise("nan"))
    return S.selected_comparison(wide(t), chosen).select("variant_id", "selection_order", "number_in_strategy", r6(F.col("y_mean")).alias("y_mean"), "display_label", "colour")


@query("reference_line", DER + " select round(avg(y), 6) + 0.0 as mean, round(stddev_samp(y), 6) + 0.0 as std, count(y) as n from d where s2 = 'S1'")
def _(t):
    return _r(S.reference_line(derived(t), "S1_random_single_control", "model_mse"))


@query("heatmap_grid", DER + " select strategy_canonical, n_metacells as row_value, case s2 when 'S3' then k when 'S5' then top_k end as column_value, round(avg(y), 6) + 0.0 as mean, round(stddev_samp(y), 6) + 0.0 as std, count(y) as n from d where s2 in ('S3', 'S4', 'S5') group by all")
def _(t):
    return _r(S.heatmap_cells(derived(t), "model_mse"), "strategy_canonical", "row_value", "column_value")


@query("ablation_table", DER + ", v as (select n_metacells, variant_id, avg(y) as mean, stddev_samp(y) as std, count(y) as n from d where s2 in ('S3', 'S5') group by all) select n_metacells, round(avg(mean), 6) + 0.0 as mean, round(sqrt(avg(std * std)), 6) + 0.0 as pooled_std, sum(n)::BIGINT as n, string_agg(distinct variant_id, '|' order by variant_id) as variants from v group by all")
def _(t):
    d = derived(t).where("strategy_canonical like 'S3%' or strategy_canonical like 'S5%'")
    v = d.groupBy("n_metacells", "variant_id").agg(F.avg("model_mse").alias("mean"), F.stddev_samp("model_mse").alias("std"), F.count("model_mse").alias("n"))
    return _r(S.ablation(v, ["n_metacells"]), "n_metacells", "variants")


@query("encoder_metric_merge", _FULL + ", fw as (select sampling_seed as model, variant_id, avg(model_mse_xt) as mse, avg(model_common_delta_cell_pearson_mean) as correlation from fr where s2 <> 'S2' group by all), iv as (select sampling_seed as model, variant_id, avg(test_accuracy) as accuracy from fr where s2 <> 'S1' group by all) select model, variant_id, round(mse, 6) + 0.0 as mse, round(correlation, 6) + 0.0 as correlation, round(accuracy, 6) + 0.0 as accuracy, (mse is not null)::BIGINT + (accuracy is not null)::BIGINT as n_tables from fw full join iv using (model, variant_id)")
def _(t):
    r, by = full_runs(t), [F.col("sampling_seed").alias("model"), "variant_id"]
    forward = r.where("strategy_canonical not like 'S2%'").groupBy(*by).agg(F.avg("model_mse_xt").alias("mse"), F.avg("model_common_delta_cell_pearson_mean").alias("correlation"))
    inverse = r.where("strategy_canonical not like 'S1%'").groupBy(*by).agg(F.avg("test_accuracy").alias("accuracy"))
    return _r(S.merge_records([forward, inverse], ["model", "variant_id"]), "model", "variant_id")


@query("best_variant_per_model", SD + " select sampling_seed, variant_id, round(value, 6) + 0.0 as value from sd qualify row_number() over (partition by sampling_seed order by value nulls last, variant_id) = 1")
def _(t):
    return _r(S.best_per_group(seeds(t), ["sampling_seed"], "value", False, "variant_id").select("sampling_seed", "variant_id", "value"), "sampling_seed")


@query("error_scatter_table", AGG + _SEL + ", rf as (select avg(x_mean) as a, avg(y_mean) as b from ag where strategy_canonical like 'S1%') select variant_id, round(x_mean, 6) + 0.0 as input_error, round(y_mean, 6) + 0.0 as model_error, x_mean > a as input_worse, y_mean > b as model_worse from ag join se using (variant_id), rf")
def _(t):
    w = wide(t).select("variant_id", "strategy_canonical", F.col("x_mean").alias("input_error"), F.col("y_mean").alias("model_error"))
    return S.error_scatter(w, _selected(t), "S1_random_single_control").select("variant_id", r6(F.col("input_error")).alias("input_error"), r6(F.col("model_error")).alias("model_error"), "input_worse", "model_worse")


@query("mixing_vs_effect_table", _FULL + _SEL + ", ps as (select sampling_seed % 2 as perturbed_group, variant_id, strategy_canonical, avg(source_mixing_opposite_neighbor_fraction_mean) as mixing, avg(strategy_delta_pearson_common_mean) as effect from fr group by all), kp as (select * from ps where variant_id in (select variant_id from se) or strategy_canonical = 'S1_random_single_control') select perturbed_group, variant_id, strategy_canonical, round(mixing, 6) + 0.0 as mixing, round(effect, 6) + 0.0 as effect, strategy_canonical = 'S1_random_single_control' as is_reference, round(min(mixing) over (), 6) + 0.0 as x_low, round(max(mixing) over (), 6) + 0.0 as x_high, round(min(effect) over (), 6) + 0.0 as y_low, round(max(effect) over (), 6) + 0.0 as y_high from kp")
def _(t):
    d = derived(t).groupBy((F.col("sampling_seed") % 2).alias("perturbed_group"), "variant_id", "strategy_canonical").agg(F.avg("control_pseudo_local_mixing_score").alias("mixing"), F.avg("perturbation_effect_pearson").alias("effect"))
    out = S.comparison_scatter(d, _selected(t), "S1_random_single_control", "mixing", "effect", "perturbed_group")
    return _r(out, "perturbed_group", "variant_id", "strategy_canonical", "is_reference")


@query("seed_level_reduce", SD + " select variant_id, sampling_seed, round(value, 6) + 0.0 as value from sd")
def _(t):
    return _r(seeds(t).select("variant_id", "sampling_seed", "value"), "variant_id", "sampling_seed")


@query("metric_values_with_fallback", SD + ", h as (select variant_id, sampling_seed, value from sd where strategy_canonical not like 'S4%'), a as (select variant_id, avg(value) as mean from sd group by all) select variant_id, sampling_seed, round(value, 6) + 0.0 as value, 'seed' as source from h union all select variant_id, null, round(mean, 6) + 0.0, 'aggregate' from a where variant_id not in (select variant_id from h)")
def _(t):
    s = seeds(t)
    means = s.groupBy("variant_id").agg(F.avg("value").alias("mean"))
    return S.values_with_fallback(s.where("strategy_canonical not like 'S4%'"), means).withColumn("value", r6(F.col("value")))


@query("metric_alias_fill", RUN + " select run_no, coalesce(case when run_no % 2 = 0 then model_mse_xt end, input_only_mse_xt) as metric from m")
def _(t):
    from pairlane.operators.prepare import coalesce_numeric

    r = runs(t).withColumn("first_alias", F.when(F.col("run_no") % 2 == 0, F.col("model_mse_xt").cast("string")).otherwise("NA"))
    return r.select("run_no", coalesce_numeric("first_alias", "input_only_mse_xt").alias("metric"))


@query("metric_table_rank", RUN + ", tb as (select run_no % 4 as table_id, variant_id, case when run_no % 4 <> 3 then sampling_seed end as seed, model_mse_xt as a, case when run_no % 4 <> 1 then input_only_mse_xt end as b from m where run_no % 4 < 2 or sampling_seed = 0), p as (select table_id, variant_id, count(distinct seed) as n from tb group by all), s as (select table_id, median(n)::DOUBLE as median_n, min(n) as min_n, max(n) as max_n from p group by all), f as (select table_id, count(seed) > 0 as has_seed, (count(a) > 0)::INT + (count(b) > 0)::INT as n_metrics, count(*) as n_rows from tb group by all) select *, row_number() over (order by median_n >= 2 desc, median_n desc, min_n desc, max_n desc, has_seed desc, n_metrics desc, table_id) as table_rank from s join f using (table_id)")
def _(t):
    r = runs(t).withColumn("table_id", F.col("run_no") % 4).where("table_id < 2 or sampling_seed = 0")
    r = r.withColumn("sampling_seed", F.when(F.col("table_id") != 3, F.col("sampling_seed"))).withColumn("b", F.when(F.col("table_id") != 1, F.col("input_only_mse_xt")))
    return S.rank_tables(r, ["model_mse_xt", "b"])


@query("selected_seed_rows", RUN + ", ks as (select strategy_canonical || case s2 when 'S2' then '__k_' || k::BIGINT when 'S3' then '__nmc_' || n_metacells::BIGINT || '__k_' || k::BIGINT when 'S4' then '__nmc_' || n_metacells::BIGINT when 'S5' then '__nmc_' || n_metacells::BIGINT || '__topk_' || top_k::BIGINT || '__spm_' || k::BIGINT else '' end as metric_variant_id, s2 || '|' || case when s2 in ('S3', 'S4', 'S5') then n_metacells::BIGINT::VARCHAR else '' end || '|' || case s2 when 'S3' then k::BIGINT::VARCHAR when 'S5' then top_k::BIGINT::VARCHAR else '' end as match_key, sampling_seed, avg(model_mse_xt) as value from m group by all), sx as (select variant_id, any_value(s2 || '|' || case when s2 in ('S3', 'S4', 'S5') then n_metacells::BIGINT::VARCHAR else '' end || '|' || case s2 when 'S3' then k::BIGINT::VARCHAR when 'S5' then top_k::BIGINT::VARCHAR else '' end) as match_key from m where variant_id like '%50%' group by variant_id union all select 'S9__none', 'S9||') select match_key, sx.variant_id as selected_variant_id, metric_variant_id, sampling_seed, round(value, 6) + 0.0 as value, metric_variant_id is not null as matched from sx left join ks using (match_key)")
def _(t):
    from pairlane.operators import manifest as M

    keyed = runs(t).withColumn("match_key", M.match_key(F.col("strategy_canonical")))
    own = keyed.withColumn("variant_id", M.variant_id_program(F.col("strategy_canonical"))).groupBy("match_key", "variant_id", "sampling_seed").agg(F.avg("model_mse_xt").alias("value"))
    chosen = keyed.where("variant_id like '%50%'").select("variant_id", "match_key").distinct().unionByName(t.spark.createDataFrame([("S9__none", "S9||")], "variant_id string, match_key string"))
    return _r(M.seed_rows(own, chosen).select("match_key", "selected_variant_id", "metric_variant_id", "sampling_seed", "value", "matched"), "match_key", "selected_variant_id", "metric_variant_id", "sampling_seed", "matched")


@query("fixed_variant_join", AGG + ", f as (select unnest(['S2_random_average_controls__default', 'S4_SEACell_balanced_random_sample__nmc_100', 'S1_random_single_control__default']) as variant_id, unnest([0, 1, 2])::INT as fixed_order) select variant_id, fixed_order, n_runs from f join ag using (variant_id)")
def _(t):
    out = S.fixed_variants(wide(t), ["S2_random_average_controls__default", "S4_SEACell_balanced_random_sample__nmc_100"], ["S1_random_single_control__default"])
    return out.select("variant_id", "fixed_order", "n_runs")


@query("variant_metric_stats", SD + " select variant_id, round(avg(value), 6) + 0.0 as mean, round(coalesce(stddev_samp(value), 0), 6) + 0.0 as std, count(value) as n from sd group by all")
def _(t):
    return _r(S.variant_stats(seeds(t), ["variant_id"], "value"), "variant_id")


@query("selection_flags", RUN + " select distinct variant_id, variant_id like '%50%' as selected from m")
def _(t):
    v = runs(t).select("variant_id").distinct()
    return v.select("variant_id", as_bool(F.when(F.col("variant_id").contains("50"), " Yes").otherwise("no")).alias("selected"))
