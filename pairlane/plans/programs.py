"""Gene program queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.exprs import draw_sql, r6
from pairlane.functions.storage import checkpointed, saved
from pairlane.operators import normalise as N
from pairlane.operators import pairing as M
from pairlane.operators import programs as G
from pairlane.operators.evaluate import summarize
from pairlane.plans.evaluate import _rounded
from pairlane.plans.registry import query
from pairlane.sources.fixtures import cte

R, DEGREE, SIZE = 0.1, 2, 3

_CORR = cte("expr", "control", "treated", recursive=True) + ", ctl as (select * from expr where analysis_group = 'control'), cor as (select a.gene as g1, b.gene as g2, coalesce(corr(a.value, b.value), 0) as r from ctl a join ctl b using (cell_id) where a.gene < b.gene group by all)"
_EDGE = _CORR + f", e0 as (select * from cor where r >= {R}), dg as (select gene, count(*) as degree from (select g1 as gene from e0 union all select g2 from e0) group by all), kp as (select gene from dg where degree >= {DEGREE} or (select max(degree) from dg) < {DEGREE}), ed as (select * from e0 where g1 in (from kp) and g2 in (from kp))"
_COMP = _EDGE + ", sy as (select g1 as a, g2 as b from ed union select g2, g1 from ed), rc as (select a as gene, a as reach from sy union select rc.gene, sy.b from rc join sy on rc.reach = sy.a), cp as (select gene, min(reach) as component from rc group by all)"
_PROG = (
    _COMP
    + f", cs as (select component, count(*) as n from cp group by all having count(*) >= {SIZE}), ins as (select a.gene as gene, a.component as component, cs.n as n, coalesce(sum(cor.r), 0) / (cs.n - 1) as cc from cp a join cs using (component) left join cp b on b.component = a.component and b.gene <> a.gene left join cor on cor.g1 = least(a.gene, b.gene) and cor.g2 = greatest(a.gene, b.gene) group by a.gene, a.component, cs.n), gd as (select *, count(*) filter (cc >= 0.05) over (partition by component) as good from ins), rk as (select *, row_number() over (partition by component order by cc desc, gene) as rnk from gd where good < {SIZE} or cc >= 0.05), rl as (select * from rk where rnk <= 20), ps as (select component, count(*) as program_size from rl group by all), pi as (select *, 'GP' || lpad((row_number() over (order by program_size desc, component))::VARCHAR, 4, '0') as program_id from ps), pg as (select program_id, gene, rnk as gene_rank_in_program, component as raw_cluster, cc as centroid_corr, program_size from rl join pi using (component))"
)
_WT = _PROG + ", gs as (select gene, avg(value) as mean, sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)) as std from ctl group by all), w0 as (select program_id, gene, mean, greatest(std, 1e-12) as std, count(*) over (partition by program_id) as n_usable from pg join gs using (gene)), w as (select program_id, gene, 1 / (std * sqrt(n_usable)) as weight, mean, n_usable from w0), wi as (select program_id, sum(weight * mean) as intercept from w group by all), sc as (select e.cell_id, e.perturbation, e.analysis_group, w.program_id, sum(w.weight * e.value) - any_value(wi.intercept) as score from expr e join w using (gene) join wi using (program_id) group by e.cell_id, e.perturbation, e.analysis_group, w.program_id)"
_EFF = _WT + f", tm as (select perturbation, program_id, avg(score) as s from sc group by all), tr as (select a.perturbation, a.program_id, a.s - b.s as effect, a.s from tm a join tm b on b.perturbation = 'control' and a.program_id = b.program_id where a.perturbation <> 'control'), nn as (select count(*) as n from control), pr as (select t.perturbation, x.sampling_seed, c.cell_id from treated t, nn, (select unnest([0, 1]) as sampling_seed) x join control c on c.control_pos = {draw_sql(chr(39) + 's1' + chr(39), 'x.sampling_seed', 't.cell_id')} % nn.n), pm as (select sampling_seed, perturbation, program_id, avg(score) as s from pr join sc using (cell_id) group by all)".replace("join sc using (cell_id)", "join (select cell_id, program_id, score from sc) using (cell_id)") + ", pe as (select sampling_seed, perturbation, program_id, tr.s - pm.s as pseudo, tr.effect as true_effect from pm join tr using (perturbation, program_id))"


def _corr(t):
    width = t.control().agg(F.max(F.size("vec")).alias("n"))
    names = width.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")).select("pos", F.format_string("g%03d", "pos").alias("gene"))
    return G.gene_correlation(t.control(), names)


def _programs(t):
    corr = checkpointed(_corr(t))
    return G.refine_programs(G.gene_components(G.gene_edges(corr, R, DEGREE)), corr, SIZE, 0.05, 20)


def _weights(t):
    control = t.expr().where("analysis_group = 'control'")
    return checkpointed(G.program_weights(_programs(t), N.gene_stats(control)))


def _scores(t):
    return G.program_scores(t.expr(), _weights(t), t.cell())


def _labels(t):
    return t.cell().select("cell_id", "perturbation")


def _effects(t):
    """(sampling_seed, perturbation, program_id, pseudo, true)."""
    scores = saved(_scores(t))  # for the true effects and for the pseudo ones
    means = G.group_scores(scores, _labels(t), ["perturbation"])
    base = means.where("perturbation = 'control'").drop("perturbation")
    true = G.effects(means.where("perturbation <> 'control'"), base, ["program_id"]).withColumnRenamed("effect", "true")
    pairs = M.random_single(t.treated(), t.control(), t.cell().where("analysis_group = 'control'").count(), [0, 1])
    used = pairs.select("sampling_seed", "perturbation", F.col("control_id").alias("cell_id"))
    pseudo = used.join(scores, "cell_id").groupBy("sampling_seed", "perturbation", "program_id").agg(F.avg("score").alias("_p"))
    treated = means.select("perturbation", "program_id", "mean_score")
    return pseudo.join(treated, ["perturbation", "program_id"]).join(true, ["perturbation", "program_id"]).select("sampling_seed", "perturbation", "program_id", (F.col("mean_score") - F.col("_p")).alias("pseudo"), "true")


@query("gene_correlation", _CORR + " select g1, g2, round(r, 6) + 0.0 as r from cor")
def _(t):
    return _rounded(_corr(t), ["g1", "g2"])


@query("gene_edges", _EDGE + " select g1, g2, round(r, 6) + 0.0 as r from ed")
def _(t):
    return _rounded(G.gene_edges(_corr(t), R, DEGREE).select("g1", "g2", "r"), ["g1", "g2"])


@query("gene_components", _COMP + " select gene, component from cp")
def _(t):
    return G.gene_components(G.gene_edges(_corr(t), R, DEGREE))


@query("program_refine", _PROG + " select program_id, gene, gene_rank_in_program, raw_cluster, round(centroid_corr, 6) + 0.0 as centroid_corr, program_size from pg")
def _(t):
    return _programs(t).withColumn("centroid_corr", r6(F.col("centroid_corr")))


@query("program_build", _PROG + " select program_id, count(*) as n_genes, min(raw_cluster) as raw_cluster, round(avg(centroid_corr), 6) + 0.0 as mean_corr from pg group by all")
def _(t):
    p = _programs(t)
    return p.groupBy("program_id").agg(F.count("*").alias("n_genes"), F.min("raw_cluster").alias("raw_cluster"), r6(F.avg("centroid_corr")).alias("mean_corr"))


@query("program_weights", _WT + " select program_id, gene, round(weight, 6) + 0.0 as weight, round(intercept, 6) + 0.0 as intercept, n_usable from w join wi using (program_id)")
def _(t):
    return _rounded(_weights(t), ["program_id", "gene"])


@query("program_scores", _WT + " select cell_id, program_id, round(score, 5) + 0.0 as score from sc")
def _(t):
    return _scores(t).withColumn("score", F.round("score", 5) + F.lit(0.0))


@query("program_scores_labelled", _WT + " select cell_id, perturbation, program_id, round(score, 5) + 0.0 as score from sc")
def _(t):
    return _scores(t).join(_labels(t), "cell_id").select("cell_id", "perturbation", "program_id", (F.round("score", 5) + F.lit(0.0)).alias("score"))


@query("program_group_means", _EFF + " select perturbation, program_id, round(s, 6) + 0.0 as mean_score from tm")
def _(t):
    return _rounded(G.group_scores(_scores(t), _labels(t), ["perturbation"]), ["perturbation"])


@query("program_true_effects", _EFF + " select perturbation, program_id, round(effect, 6) + 0.0 as effect from tr")
def _(t):
    means = G.group_scores(_scores(t), _labels(t), ["perturbation"])
    return _rounded(G.effects(means.where("perturbation <> 'control'"), means.where("perturbation = 'control'").drop("perturbation"), ["program_id"]).select("perturbation", "program_id", "effect"), ["perturbation"])


@query("program_pseudo_effects", _EFF + " select sampling_seed, perturbation, program_id, round(pseudo, 6) + 0.0 as pseudo from pe")
def _(t):
    return _rounded(_effects(t).drop("true"), ["sampling_seed"])


_MM = "round(sqrt(avg((pseudo - true_effect) * (pseudo - true_effect))), 6) + 0.0 as rmse, round(avg(abs(pseudo - true_effect)), 6) + 0.0 as mae, round(corr(pseudo, true_effect), 6) + 0.0 as pearson, round(corr(rx, ry), 6) + 0.0 as spearman, round(sqrt(sum(pseudo * pseudo)) / sqrt(sum(true_effect * true_effect)), 6) + 0.0 as magnitude_ratio, round(case when count(*) >= 2 then sum(pseudo * true_effect) / sqrt(sum(pseudo * pseudo) * sum(true_effect * true_effect)) end, 6) + 0.0 as cosine, count(*) as n"


def _metric_sql(by: str) -> str:
    return _EFF + f", rr as (select *, rank() over (partition by {by} order by pseudo) as rx, rank() over (partition by {by} order by true_effect) as ry from pe) select {by}, {_MM} from rr group by {by}"


@query("effect_matrix_metrics", _metric_sql("sampling_seed"))
def _(t):
    return _rounded(G.matrix_metrics(_effects(t), ["sampling_seed"]), ["sampling_seed"])


@query("per_program_metrics", _metric_sql("sampling_seed, program_id"))
def _(t):
    return _rounded(G.matrix_metrics(_effects(t), ["sampling_seed", "program_id"]), ["sampling_seed"])


@query("per_perturbation_metrics", _metric_sql("sampling_seed, perturbation"))
def _(t):
    return _rounded(G.matrix_metrics(_effects(t), ["sampling_seed", "perturbation"]), ["sampling_seed"])


_PP = _EFF + ", pp as (select sampling_seed, program_id, corr(pseudo, true_effect) as pearson from pe group by all)"


@query("correlation_table_summary", _PP + " select sampling_seed, 'pearson' as metric, round(avg(pearson), 6) + 0.0 as mean, round(median(pearson), 6) + 0.0 as median, round(stddev_pop(pearson), 6) + 0.0 as std, round(stddev_pop(pearson) / sqrt(count(pearson)), 6) + 0.0 as sem, count(pearson) as n_valid from pp group by all")
def _(t):
    return _rounded(summarize(G.matrix_metrics(_effects(t), ["sampling_seed", "program_id"]), ["sampling_seed"], ["pearson"]), ["sampling_seed"])


@query("program_seed_average", _PP + " select program_id, round(avg(pearson), 6) + 0.0 as pearson, count(*) as n_rows from pp group by all")
def _(t):
    m = G.matrix_metrics(_effects(t), ["sampling_seed", "program_id"])
    return m.groupBy("program_id").agg(r6(F.avg("pearson")).alias("pearson"), F.count("*").alias("n_rows"))
