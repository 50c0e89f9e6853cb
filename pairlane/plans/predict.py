"""Prediction and classification queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.exprs import draw_sql, r6
from pairlane.functions.storage import checkpointed, saved
from pairlane.operators import evaluate as E
from pairlane.operators import pairing as M
from pairlane.operators import predict as P
from pairlane.plans.evaluate import _AX, _axes, _rounded
from pairlane.plans.registry import query
from pairlane.sources.fixtures import cte


def _pairs_long(t):
    """(cell_id, perturbation, gene, x0, xt) of one S1 seed."""
    n = t.cell().where("analysis_group = 'control'").count()
    p = M.random_single(t.treated(), t.control(), n, [0]).select("cell_id", "perturbation", F.posexplode("profile").alias("i", "x"))
    x0 = p.select("cell_id", "perturbation", F.format_string("g%03d", "i").alias("gene"), F.col("x").cast("double").alias("x0"))
    return x0.join(t.expr().select("cell_id", "gene", F.col("value").alias("xt")), ["cell_id", "gene"])


@query("label_encode", cte("cell") + ", g as (select perturbation, row_number() over (order by perturbation) - 1 as label_id from (select perturbation from cell group by all having count(*) >= 50)) select cell_id, perturbation, coalesce(label_id, -1) as label_id from cell left join g using (perturbation)")
def _(t):
    return P.label_encode(t.cell().select("cell_id", "perturbation"), "perturbation", 50)


_SPLIT = f", sz as (select perturbation, count(*) as n from cell group by all), sc as (select perturbation, n, greatest(floor(n * 0.15), 1) as nv, greatest(n - greatest(floor(n * 0.7), 1) - greatest(floor(n * 0.15), 1), 1) as nt from sz where n >= 3), sp as (select cell_id, perturbation, row_number() over (partition by perturbation order by {draw_sql(chr(39) + 'split' + chr(39), '4', 'cell_id')}, cell_id) as i, n - nv - nt as cut, nv from cell join sc using (perturbation)), split as (select cell_id, perturbation, case when i <= cut then 'train' when i <= cut + nv then 'valid' else 'test' end as split from sp)"


@query("stratified_split", cte("cell") + _SPLIT + " select * from split")
def _(t):
    return P.stratified_split(t.cell().select("cell_id", "perturbation"), "perturbation", "cell_id", 4)


_PAIR = cte("expr", "control", "treated") + f", n as (select count(*) as n from control), p as (select t.cell_id, t.perturbation, c.cell_id as control_id from treated t, n join control c on c.control_pos = {draw_sql(chr(39) + 's1' + chr(39), '0', 't.cell_id')} % n.n), px as (select p.cell_id, p.perturbation, e.gene, e0.value as x0, e.value as xt from p join expr e on e.cell_id = p.cell_id join expr e0 on e0.cell_id = p.control_id and e0.gene = e.gene), cm as (select gene, avg(value) as control_mean from expr where analysis_group = 'control' group by all)"


@query("delta_features", _PAIR + " select cell_id, gene, round(xt - x0, 6) + 0.0 as strategy_delta, round(xt - control_mean, 6) + 0.0 as common_delta from px join cm using (gene)")
def _(t):
    mean = t.expr().where("analysis_group = 'control'").groupBy("gene").agg(F.avg("value").alias("control_mean"))
    out = P.delta_features(_pairs_long(t), mean)
    return out.select("cell_id", "gene", r6(F.col("strategy_delta")).alias("strategy_delta"), r6(F.col("common_delta")).alias("common_delta"))


@query("representation_targets", _PAIR + _AX + ", rp as (select cell_id, perturbation, analysis_group, unnest(list_transform(axes, lambda w: list_sum(list_transform(list_zip(vec, w), lambda x: x[1]::DOUBLE * x[2])))) as x, unnest(range(8)) as dimension from cell, ax), rc as (select dimension, avg(x) as c from rp where analysis_group = 'control' group by all) select perturbation, dimension, count(*) as n, round(avg(x - c), 6) + 0.0 as target from rp join rc using (dimension) where analysis_group <> 'control' group by all")
def _(t):
    own, control = (E.project(df, _axes(t)) for df in (t.treated(), t.control()))
    out = P.representation_targets(own, control, ["perturbation"])
    return out.withColumn("target", r6(F.col("target")))


_FWD = _PAIR + _SPLIT + ", ps as (select px.*, split from px join split using (cell_id)), tr as (select perturbation, gene, avg(xt - x0) as d from ps where split = 'train' group by all), pd as (select ps.*, x0 + d as pred from ps join tr using (perturbation, gene) where split = 'test')"


def _forward(t):
    split = P.stratified_split(t.cell().select("cell_id", "perturbation"), "perturbation", "cell_id", 4).select("cell_id", "split")
    rows = _pairs_long(t).join(split, "cell_id")
    return P.forward_baseline(rows.where("split = 'train'"), rows.where("split = 'test'"), [])


@query("forward_baseline_predict", _FWD + " select cell_id, gene, round(pred, 6) + 0.0 as pred from pd")
def _(t):
    return _forward(t).select("cell_id", "gene", r6(F.col("pred")).alias("pred"))


def _predicted(t):
    mean = t.expr().where("analysis_group = 'control'").groupBy("gene").agg(F.avg("value").alias("control_mean"))
    return _forward(t).join(mean, "gene").withColumn("run_id", F.lit(0))


_CELL = {
    "model_cell_pearson_xt": "corr(pred, xt)", "input_cell_pearson_xt": "corr(x0, xt)", "model_cell_cosine_xt": "sum(pred * xt) / sqrt(sum(pred * pred) * sum(xt * xt))", "input_cell_cosine_xt": "sum(x0 * xt) / sqrt(sum(x0 * x0) * sum(xt * xt))",
    "strategy_delta_cell_pearson": "corr(pred - x0, xt - x0)", "strategy_delta_cell_cosine": "sum((pred - x0) * (xt - x0)) / sqrt(sum((pred - x0) * (pred - x0)) * sum((xt - x0) * (xt - x0)))",
    "model_common_delta_cell_pearson": "corr(pred - control_mean, xt - control_mean)", "input_common_delta_cell_pearson": "corr(x0 - control_mean, xt - control_mean)",
}
_ERR = {"model_mse_xt": "avg((pred - xt) * (pred - xt))", "model_mae_xt": "avg(abs(pred - xt))", "input_only_mse_xt": "avg((x0 - xt) * (x0 - xt))", "input_only_mae_xt": "avg(abs(x0 - xt))", "strategy_specific_delta_mse": "avg((pred - xt) * (pred - xt))", "strategy_specific_delta_mae": "avg(abs(pred - xt))"}
_GAIN = {"model_gain_mse_xt": "input_only_mse_xt - model_mse_xt", "model_gain_mae_xt": "input_only_mae_xt - model_mae_xt", "model_gain_mse_xt_fraction": "(input_only_mse_xt - model_mse_xt) / input_only_mse_xt"}
_STAT = {"mean": "avg({})", "median": "median({})", "std": "stddev_pop({})", "sem": "stddev_pop({}) / sqrt(count({}))"}
_PD = _FWD + ", pc as (select pd.*, control_mean from pd join cm using (gene))"
_PER = (
    _PD
    + ", g as (select perturbation, gene, avg(pred - control_mean) as x, avg(xt - control_mean) as y from pc group by all), gr as (select *, rank() over (partition by perturbation order by x) as rx, rank() over (partition by perturbation order by y) as ry, row_number() over (partition by perturbation order by abs(x) desc, gene) as nx, row_number() over (partition by perturbation order by abs(y) desc, gene) as ny from g)"
    + ", nt as (select perturbation, count(distinct cell_id) as n_test_cells from pc group by all), pp as (select perturbation, any_value(n_test_cells) as n_test_cells, corr(x, y) as common_delta_pearson, corr(rx, ry) as common_delta_spearman, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) as common_delta_cosine, sqrt(avg((x - y) * (x - y))) as common_delta_l2"
    + "".join(f", corr(x, y) filter (ny <= {k}) as top{k}_common_delta_pearson, sum(x * y) filter (ny <= {k}) / sqrt(sum(x * x) filter (ny <= {k}) * sum(y * y) filter (ny <= {k})) as top{k}_common_delta_cosine, count(*) filter (ny <= {k} and nx <= {k}) / count(*) filter (ny <= {k}) as top{k}_common_delta_overlap" for k in (20, 50))
    + " from gr join nt using (perturbation) group by perturbation)"
)
_PERS = ["common_delta_pearson", "common_delta_spearman", "common_delta_cosine", "common_delta_l2", *[f"top{k}_common_delta_{m}" for k in (20, 50) for m in ("pearson", "cosine", "overlap")]]


@query(
    "forward_metrics",
    _PER + ", er as (select " + ", ".join(f"{x} as {n}" for n, x in _ERR.items()) + " from pc), ce as (select cell_id, " + ", ".join(f"{x} as {n}" for n, x in _CELL.items()) + " from pc group by cell_id), st as (select "
    + ", ".join([*[f"{f.format(n, n)} as {n}_{s}" for n in _CELL for s, f in _STAT.items()], *[f"count({n}) as {n}_n_valid" for n in _CELL]]) + " from ce), pa as (select count(*) as n_perturbations_evaluated, " + ", ".join(f"{f.format(n)} as per_perturbation_{n}_{s}" for n in _PERS for s, f in _STAT.items() if s in ("mean", "median")) + " from pp) select 0 as run_id, n_perturbations_evaluated, "
    + ", ".join([*[f"round({n}, 6) + 0.0 as {n}" for n in _ERR], *[f"round({x}, 6) + 0.0 as {n}" for n, x in _GAIN.items()], *[f"round({n}_{s}, 6) + 0.0 as {n}_{s}" for n in _CELL for s in _STAT], *[f"{n}_n_valid" for n in _CELL], *[f"round(per_perturbation_{n}_{s}, 6) + 0.0 as per_perturbation_{n}_{s}" for n in _PERS for s in ("mean", "median")]]) + " from er, st, pa",
)
def _(t):
    return _rounded(P.forward_report(saved(_predicted(t)), ["run_id"], [20, 50]), ["run_id"])


@query("forward_per_perturbation", _PER + " select perturbation, n_test_cells, " + ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in _PERS) + " from pp")
def _(t):
    return _rounded(P.forward_per_perturbation(_predicted(t), [], [20, 50]), ["perturbation"])


_D = "sqrt(list_sum(list_transform(list_zip(c.vec, m.vec), lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2]))))"
_PROB = cte("cell") + f", ce as (select label, unnest(vec)::DOUBLE as x, generate_subscripts(vec, 1) as i from cell where label <> 0), mu as (select label, i, avg(x) as x from ce group by all), m as (select label as class, list(x order by i) as vec from mu group by all), ds as (select c.cell_id, c.label as y_true, m.class, -{_D} as d from cell c, m where c.label <> 0), ex as (select *, exp(d - max(d) over (partition by cell_id)) as e from ds), prob as (select cell_id, y_true, class, e / sum(e) over (partition by cell_id) as p from ex), pred as (select cell_id, y_true, class as y_pred from prob qualify row_number() over (partition by cell_id order by p desc, class) = 1)"


def _prob(t):
    """Softmax of minus the distance to each label's mean vector; labels are the classes."""
    cells = t.cell().where("label <> 0")
    mean = cells.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    return P.softmax_distance(cells.select("cell_id", F.col("label").alias("y_true"), "vec"), centres, [])


def _pred(t):
    from pairlane.functions.exprs import place

    return _prob(t).withColumn("_n", place(["cell_id"], F.desc("p"), "class")).where("_n = 1").select("cell_id", "y_true", F.col("class").alias("y_pred"))


@query("confusion_counts", _PROB + " select y_true, y_pred, count(*) as n from pred group by all")
def _(t):
    return P.confusion(_pred(t), [])


_PC = _PROB + ", a as (select y_true as label, count(*) as support, count(*) filter (y_true = y_pred) as hit from pred group by all), b as (select y_pred as label, count(*) as predicted from pred group by all), pc0 as (select coalesce(a.label, b.label) as label, coalesce(support, 0) as support, coalesce(hit, 0) as hit, coalesce(predicted, 0) as predicted from a full join b on a.label = b.label), pc1 as (select *, coalesce(hit / nullif(predicted, 0), 0) as pr, coalesce(hit / nullif(support, 0), 0) as re from pc0), pc as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) as f1 from pc1)"


@query("classification_metrics", _PC + " select round(sum(hit) / sum(support), 6) + 0.0 as accuracy, round(avg(re) filter (support > 0), 6) + 0.0 as balanced_accuracy, round(avg(pr), 6) + 0.0 as macro_precision, round(avg(re), 6) + 0.0 as macro_recall, round(avg(f1), 6) + 0.0 as macro_f1, round(sum(pr * support) / sum(support), 6) + 0.0 as weighted_precision, round(sum(re * support) / sum(support), 6) + 0.0 as weighted_recall, round(sum(f1 * support) / sum(support), 6) + 0.0 as weighted_f1 from pc")
def _(t):
    return _rounded(P.classification_metrics(_pred(t), []), [])


@query("log_loss", _PROB + " select round(avg(-ln(least(greatest(p, 1e-15), 1 - 1e-15))), 6) + 0.0 as log_loss from prob where class = y_true")
def _(t):
    return _rounded(P.log_loss(_prob(t), []), [])


@query("topk_accuracy", _PROB + ", r as (select *, row_number() over (partition by cell_id order by p desc, class) as r from prob), n as (select count(distinct class) as n from prob) select k, round(avg((r <= k)::INT), 6) + 0.0 as topk_accuracy from r, n, (select unnest([3, 5, 10]) as k) where class = y_true and k <= n group by k")
def _(t):
    return P.topk_accuracy(_prob(t), [], [3, 5, 10]).withColumn("topk_accuracy", r6(F.col("topk_accuracy")))


_AUC = _PROB + ", r as (select *, rank() over (partition by class order by p) + (count(*) over (partition by class, p) - 1) / 2.0::DOUBLE as r, (class = y_true)::INT as y from prob), au as (select class, sum(y) as support, (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0) as auc from r group by class)"


@query("auc_ovr", _AUC + " select round(avg(auc), 6) + 0.0 as macro_auc, round(sum(auc * support) / sum(support) filter (auc is not null), 6) + 0.0 as weighted_auc, count(auc) as n_valid, count(*) as n_classes from au")
def _(t):
    return _rounded(P.auc_ovr(_prob(t), []), ["n_valid", "n_classes"])


@query("per_class_report", _PC + _AUC[len(_PROB):] + " select pc.label, pc.support, round(pr, 6) + 0.0 as precision, round(re, 6) + 0.0 as recall, round(f1, 6) + 0.0 as f1, round(auc, 6) + 0.0 as auc from pc join au on au.class = pc.label")
def _(t):
    auc = P.auc_per_class(_prob(t), []).select(F.col("class").alias("label"), "auc")
    out = P.per_class(_pred(t), []).select("label", "support", "precision", "recall", "f1").join(auc, "label")
    return _rounded(out, ["label", "support"])


@query("chance_baseline", cte("run") + ", c as (select strategy, median(n_metacells_requested) filter (n_metacells_requested > 0) as a, median(sampling_seed - 1) filter (sampling_seed > 1) as b from run group by all) select strategy, coalesce(a, b)::DOUBLE as n_classes, 1.0::DOUBLE / coalesce(a, b) as accuracy_baseline from c")
def _(t):
    r = t.view("run").withColumn("n_labels", F.col("sampling_seed") - 1)
    return P.chance_baseline(r, ["strategy"], ["n_classes", "n_metacells_requested", "n_labels"])


def _classifier(t, common: bool):
    pairs = M.random_single(t.treated(), t.control(), t.cell().where("analysis_group = 'control'").count(), [0])
    if common:
        pairs = pairs.drop("profile").crossJoin(F.broadcast(M.mean_profile(t.control())))  # one row
    rows = P.label_encode(pairs.select("cell_id", "perturbation", F.zip_with("vec", "profile", lambda a, b: a.cast("double") - b.cast("double")).alias("delta")), "perturbation", 3)
    split = P.stratified_split(rows.select("cell_id", "perturbation"), "perturbation", "cell_id", 4).select("cell_id", "split")
    ready = saved(rows.join(split, "cell_id"))
    return checkpointed(P.multinomial(ready.where("split = 'train'"), ready.where("split = 'test'"), "label_id", "delta"))


_COMMON = ", 'COMMON_REFERENCE_DELTA' as strategy"


def _inverse_sql(common: bool, ridge: float = 0.02, rounds: int = 130, rate: float = 1.5, keep: float = 0.7) -> str:
    """The same minimum by gradient rounds with momentum, one after another from weights of 0, and every summary of it."""
    x, where = ("m.value", "") if common else ("e0.value", f" join n on true join control c on c.control_pos = {draw_sql(chr(39) + 's1' + chr(39), '0', 't.cell_id')} % n.n")
    other = "(select gene_pos, avg(value) as value from expr where analysis_group = 'control' group by all) m on m.gene_pos = e.gene_pos" if common else "expr e0 on e0.cell_id = c.cell_id and e0.gene_pos = e.gene_pos"
    delta = f"select t.cell_id, e.gene_pos + 1 as i, e.value - {x} as x from treated t{where} join expr e on e.cell_id = t.cell_id join {other}"
    out = [
        cte("expr", "control", "treated") + _SPLIT + f", n as (select count(*) as n from control), dl as materialized ({delta}), lb as (select perturbation, row_number() over (order by perturbation) - 1 as y from (select perturbation from treated group by all having count(*) >= 3)), ly as materialized (select cell_id, y, split.split from split join lb using (perturbation))",
        "sl as materialized (select sqrt(avg(q)) as s from (select cell_id, sum(x * x) as q from dl join ly using (cell_id) where split = 'train' group by all))",
        "ex as materialized (select cell_id, i, x / s as x, split, y from dl join ly using (cell_id), sl union all select cell_id, 0, 1.0::DOUBLE, split, y from ly), tx as materialized (from ex where split = 'train'), tn as (select count(*) as n from ly where split = 'train')",
        "w0 as materialized (select y as class, i, 0.0::DOUBLE as w, 0.0::DOUBLE as v from lb, (select distinct i from ex))",
    ]
    soft = "select cell_id, class, e / sum(e) over (partition by cell_id) as p from (select cell_id, class, exp(z - max(z) over (partition by cell_id)) as e from ({}))"
    for r in range(1, rounds + 1):
        score = f"select cell_id, class, sum(x * (w + {keep} * v)) as z from tx join w{r - 1} using (i) group by all"
        out.append(f"p{r} as materialized ({soft.format(score)}), g{r} as materialized (select class, i, sum((p - (class = y)::INT) * x) / any_value(tn.n) as g from p{r} join tx using (cell_id), tn group by all)")
        step = f"{keep} * v - {rate} * (g + {ridge} * (i > 0)::INT * (w + {keep} * v))"
        out.append(f"w{r} as materialized (select class, i, w + {step} as w, {step} as v from w{r - 1} join g{r} using (class, i))")
    score = f"select cell_id, class, sum(x * w) as z from ex join w{rounds} using (i) where split = 'test' group by all"
    out.append(f"pt as materialized ({soft.format(score)}), prob as materialized (select pt.cell_id, ly.y as y_true, class, p from pt join ly using (cell_id)), pred as (select cell_id, y_true, class as y_pred from prob qualify row_number() over (partition by cell_id order by p desc, class) = 1)")
    parts = {"accuracy": "sum(hit) / sum(support)", "balanced_accuracy": "avg(re) filter (support > 0)", "macro_precision": "avg(pr)", "macro_recall": "avg(re)", "macro_f1": "avg(f1)", "weighted_precision": "sum(pr * support) / sum(support)", "weighted_recall": "sum(re * support) / sum(support)", "weighted_f1": "sum(f1 * support) / sum(support)"}
    cm = "cm as (select " + ", ".join(f"round({x}, 6) + 0.0 as {n}" for n, x in parts.items()) + " from pc)"
    ll = "ll as (select round(avg(-ln(least(greatest(p, 1e-15), 1 - 1e-15))), 6) + 0.0 as log_loss from prob where class = y_true)"
    tk = "tk as (select " + ", ".join(f"case when max(nc) >= {k} then round(avg((place <= {k})::INT), 6) + 0.0 end as top{k}_accuracy" for k in (3, 5)) + " from (select *, row_number() over (partition by cell_id order by p desc, class) as place, (select count(distinct class) from prob) as nc from prob) where class = y_true)"
    au = "ao as (select round(avg(auc), 6) + 0.0 as macro_auc, round(sum(auc * support) / sum(support) filter (auc is not null), 6) + 0.0 as weighted_auc, count(auc) as n_valid, count(*) as n_classes from au)"
    return ", ".join(out) + _PC[len(_PROB) :] + _AUC[len(_PROB) :] + f", {cm}, {ll}, {tk}, {au} select *{_COMMON if common else ''} from cm, ll, tk, ao"


@query("inverse_classifier", _inverse_sql(False))
def _(t):
    return _rounded(P.inverse_report(_classifier(t, False), [3, 5]), [])


@query("inverse_common_reference", _inverse_sql(True))
def _(t):
    return _rounded(P.inverse_report(_classifier(t, True), [3, 5]), []).withColumn("strategy", F.lit("COMMON_REFERENCE_DELTA"))
