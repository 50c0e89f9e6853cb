"""Control-distribution and effect metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.exprs import draw, draw_sql, r6
from pairlane.functions.storage import saved
from pairlane.operators import evaluate as E
from pairlane.operators import pairing as M
from pairlane.plans.registry import query
from pairlane.sources.fixtures import SHARED, cte

SEEDS = [0, 1]


def _n(t) -> int:
    return t.cell().where("analysis_group = 'control'").count()


def _pairs(t):
    return M.random_single(t.treated(), t.control(), _n(t), SEEDS).select("cell_id", "perturbation", "sampling_seed", "control_id", "profile")


def _pseudo(t, pairs=None):
    """Constructed rows of S1 in long form, as often as they are used."""
    long = (pairs or _pairs(t)).select("sampling_seed", "cell_id", "perturbation", F.posexplode("profile").alias("i", "x"))
    return long.select("sampling_seed", "cell_id", "perturbation", F.format_string("g%03d", "i").alias("gene"), F.col("x").cast("double").alias("value"))


def _control(t):
    return t.expr().where("analysis_group = 'control'")


def _rounded(df, keys):
    return df.select(*[c if c in keys or dict(df.dtypes)[c] in ("bigint", "int", "string") else r6(F.col(c)).alias(c) for c in df.columns])


_S1 = cte("expr", "control", "treated") + f", n as (select count(*) as n from control), s as (select unnest([0, 1]) as sampling_seed), p as (select t.cell_id, t.perturbation, s.sampling_seed, {draw_sql(chr(39) + 's1' + chr(39), 's.sampling_seed', 't.cell_id')} % n as control_pos from treated t, s, n), pc as (select p.*, c.cell_id as control_id from p join control c using (control_pos)), ps as (select pc.sampling_seed, pc.cell_id, pc.perturbation, e.gene, e.value from pc join expr e on e.cell_id = pc.control_id)"
_PROF = _S1 + ", a as (select sampling_seed, gene, avg(value) as m, var_pop(value) as v from ps group by all), b as (select gene, avg(value) as cm, var_pop(value) as cv from expr where analysis_group = 'control' group by all), ab as (select * from a join b using (gene))"


@query("mean_profile_metrics", _PROF + " select sampling_seed, round(corr(m, cm), 6) + 0.0 as mean_pearson, round(corr(m, cm) * corr(m, cm), 6) + 0.0 as mean_r2, round(sqrt(avg((m - cm) * (m - cm))), 6) + 0.0 as mean_rmse from ab group by all")
def _(t):
    return _rounded(E.profile_metrics(_pseudo(t), _control(t), ["sampling_seed"]).select("sampling_seed", "mean_pearson", "mean_r2", "mean_rmse"), ["sampling_seed"])


@query(
    "variance_profile_metrics",
    _PROF + " select sampling_seed, round(corr(v, cv), 6) + 0.0 as variance_pearson, round(corr(v, cv) * corr(v, cv), 6) + 0.0 as variance_r2, round(sqrt(avg((v - cv) * (v - cv))), 6) + 0.0 as variance_rmse, round(corr(ln(1 + v), ln(1 + cv)), 6) + 0.0 as log_variance_pearson, round(median(v / (cv + 1e-12)), 6) + 0.0 as variance_ratio_median from ab group by all",
)
def _(t):
    return _rounded(E.profile_metrics(_pseudo(t), _control(t), ["sampling_seed"]).drop("mean_pearson", "mean_r2", "mean_rmse"), ["sampling_seed"])


AXES = 8
_AX = f", ax as (select list(w order by a) as axes from (select a, list((({draw_sql(chr(39) + 'axis' + chr(39), 'a', 'i')}) % 2 * 2 - 1) / 8.0::DOUBLE order by i) as w from (select unnest(range({AXES})) as a) x, (select unnest(range(64)) as i) y group by a))"
_PT = (
    _AX
    + ", r0 as (select d.sampling_seed, 0 as source, c.cell_id, c.vec from control c, (select distinct sampling_seed from pc) d union all select pc.sampling_seed, 1, pc.cell_id, c.vec from pc join control c on c.cell_id = pc.control_id)"
    + ", pt as (select sampling_seed, source, cell_id, list_transform(axes, lambda w: list_sum(list_transform(list_zip(vec, w), lambda x: x[1]::DOUBLE * x[2]))) as vec from r0, ax)"
)
_CENT = _PT + ", pe as (select sampling_seed, source, unnest(vec) as x, generate_subscripts(vec, 1) as i from pt), pm as (select sampling_seed, source, i, avg(x) as m, var_pop(x) as v from pe group by all), ct as (select a.sampling_seed, sqrt(sum((a.m - b.m) * (a.m - b.m))) as centroid_distance, sum(a.v) / sum(b.v) as total_variance_ratio from pm a join pm b on a.sampling_seed = b.sampling_seed and a.i = b.i and a.source = 1 and b.source = 0 group by a.sampling_seed)"


def _axes(t):
    """Eight seeded directions of +-1/8: a projection that SQL can state. ``pca_fit_transform`` gives fitted ones."""
    grid = t.spark.range(AXES).select(F.col("id").alias("axis"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    weight = (draw("axis", F.col("axis"), F.col("i")) % 2 * 2 - 1) / 8.0
    return grid.groupBy("axis").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", weight.alias("w")))), lambda x: x["w"]).alias("weights"))


def _sources(t, pairs=None):
    """Controls (source 0, once for each seed) and the constructed rows of each seed (source 1), in the projected space."""
    a = t.control().select(F.explode(F.array(*map(F.lit, SEEDS))).alias("sampling_seed"), F.lit(0).alias("source"), "cell_id", "vec")
    b = (pairs or _pairs(t)).select("sampling_seed", F.lit(1).alias("source"), "cell_id", F.col("profile").alias("vec"))
    return E.project(a.unionByName(b), _axes(t))


@query("pca_centroid_metrics", _S1 + _CENT + " select sampling_seed, round(centroid_distance, 6) + 0.0 as centroid_distance, round(total_variance_ratio, 6) + 0.0 as total_variance_ratio from ct")
def _(t):
    flat = _sources(t).select("sampling_seed", "source", F.posexplode("vec").alias("gene", "value"))
    return _rounded(E.centroid_metrics(flat.where("source = 1").drop("source"), flat.where("source = 0").drop("source"), ["sampling_seed"]), ["sampling_seed"])


_D2 = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_MMD = (
    f", mn as (select *, row_number() over (partition by sampling_seed, source order by {draw_sql(chr(39) + 'mmd' + chr(39), 'cell_id')}, cell_id) as n from pt), mr as (select * from mn where n <= 3000)"
    + f", mi as (select *, row_number() over (partition by sampling_seed order by source, n) as i from mr), mg as (select sampling_seed, 1.0::DOUBLE / median(d2) as gamma from (select a.sampling_seed, {_D2} as d2 from mi a join mi b on a.sampling_seed = b.sampling_seed and a.i < b.i where a.i <= 1000 and b.i <= 1000) where d2 > 0 group by all)"
    + f", mk as (select a.sampling_seed, a.source as sa, b.source as sb, gamma, exp(-gamma * {_D2}) as k from mr a join mr b on a.sampling_seed = b.sampling_seed and a.source <= b.source join mg on mg.sampling_seed = a.sampling_seed)"
    + ", mm as (select sampling_seed, max(gamma) as gamma, avg(k) filter (sa = 0 and sb = 0) + avg(k) filter (sa = 1 and sb = 1) - 2 * avg(k) filter (sa = 0 and sb = 1) as mmd2 from mk group by all)"
)
_MIX = (
    f", xn as (select *, row_number() over (partition by sampling_seed, source order by {draw_sql(chr(39) + 'mixing' + chr(39), 'cell_id')}, cell_id) as n from pt), xr as (select * from xn where n <= 10000)"
    + f", xd as (select a.sampling_seed, a.cell_id as ka, a.source as sa, b.cell_id as kb, b.source as sb, {_D2} as d from xr a join xr b on a.sampling_seed = b.sampling_seed and not (a.cell_id = b.cell_id and a.source = b.source)), xq as (select *, row_number() over (partition by sampling_seed, ka, sa order by d, sb, kb) as n from xd qualify n <= 30), xs as (select sampling_seed, ka, sa, avg((sa <> sb)::INT) as share from xq group by all)"
    + ", mx as (select sampling_seed, avg(share) as mixing, avg(share) filter (sa = 0) as mixing_control, avg(share) filter (sa = 1) as mixing_pseudo from xs group by all)"
)
_R = lambda *names: ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


@query("mmd_rbf", _S1 + _PT + _MMD + f" select sampling_seed, {_R('gamma', 'mmd2')} from mm")
def _(t):
    return _rounded(E.mmd_rbf(_sources(t), ["sampling_seed"]), ["sampling_seed"])


@query("source_mixing", _S1 + _PT + _MIX + f" select sampling_seed, {_R('mixing', 'mixing_control', 'mixing_pseudo')} from mx")
def _(t):
    return _rounded(E.source_mixing(_sources(t), ["sampling_seed"]), ["sampling_seed"])


_COV = ", us as (select pc.sampling_seed, m.metacell_id, count(*) as times from pc join membership m on m.cell_id = pc.control_id group by all), uq as (select *, times / sum(times) over (partition by sampling_seed) as p from us), cv as (select sampling_seed, count(*) as n_covered, count(*) / (select count(distinct metacell_id) from membership) as covered_fraction, case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) else 0 end as entropy, max(p) as max_share from uq group by all)"
_S1M = _S1 + ", membership as (" + SHARED["membership"].replace("{embeddings}", "embeddings") + ")"


def _used(t, pairs=None):
    return (pairs or _pairs(t)).join(t.view("membership").select(F.col("cell_id").alias("control_id"), F.col("metacell_id").alias("used_id")), "control_id")


def _metacells(t):
    return t.view("membership").agg(F.count_distinct("metacell_id").alias("n_metacells"))


@query("metacell_coverage", _S1M + _COV + f" select sampling_seed, n_covered, {_R('covered_fraction', 'entropy', 'max_share')} from cv")
def _(t):
    return _rounded(E.metacell_coverage(_used(t), ["sampling_seed"], _metacells(t)), ["sampling_seed"])


@query("duplicate_stats", _S1 + " select sampling_seed, count(distinct control_id) as n_unique, round(1 - count(distinct control_id) / count(*), 6) + 0.0 as duplicate_rate from pc group by all")
def _(t):
    return _rounded(E.duplicate_stats(_pairs(t), ["sampling_seed"]), ["sampling_seed"])


_PROFILES = ", pf as (select sampling_seed, corr(m, cm) as mean_pearson, corr(m, cm) * corr(m, cm) as mean_r2, sqrt(avg((m - cm) * (m - cm))) as mean_rmse, corr(v, cv) as variance_pearson, corr(v, cv) * corr(v, cv) as variance_r2, sqrt(avg((v - cv) * (v - cv))) as variance_rmse, corr(ln(1 + v), ln(1 + cv)) as log_variance_pearson, median(v / (cv + 1e-12)) as variance_ratio_median from ab group by all), du as (select sampling_seed, count(distinct control_id) as n_unique, 1 - count(distinct control_id) / count(*) as duplicate_rate from pc group by all)"
_FIELDS = ["mean_pearson", "mean_r2", "mean_rmse", "variance_pearson", "variance_r2", "variance_rmse", "log_variance_pearson", "variance_ratio_median", "centroid_distance", "total_variance_ratio", "gamma", "mmd2", "mixing", "mixing_control", "mixing_pseudo", "duplicate_rate", "covered_fraction", "entropy", "max_share"]


@query(
    "control_manifold_report",
    _S1M + _PROF[len(_S1) :] + _CENT + _MMD + _MIX + _PROFILES + _COV + f" select sampling_seed, {_R(*_FIELDS)}, n_unique, n_covered from pf join ct using (sampling_seed) join mm using (sampling_seed) join mx using (sampling_seed) join du using (sampling_seed) join cv using (sampling_seed)",
)
def _(t):
    by = ["sampling_seed"]
    pairs = saved(_pairs(t))  # every part of the report reads them
    points = saved(_sources(t, pairs))
    return _rounded(E.control_report(_pseudo(t, pairs), _control(t), points, pairs, _used(t, pairs), _metacells(t), by), by)


@query("eligible_labels", cte("cell") + " select perturbation, count(*) as n_cells from cell group by all having count(*) >= 50")
def _(t):
    return E.eligible_labels(t.cell(), "perturbation", 50)


def _deltas(t):
    return E.effect_deltas(t.expr().where("analysis_group <> 'control'"), _pseudo(t), _control(t), ["sampling_seed"])


_BY = ["sampling_seed", "perturbation"]
_DELTA = _S1 + ", tm as (select perturbation, gene, avg(value) as tv from expr where analysis_group <> 'control' group by all), pm as (select sampling_seed, perturbation, gene, avg(value) as pv from ps group by all), cm as (select gene, avg(value) as cv from expr where analysis_group = 'control' group by all), dl as (select sampling_seed, perturbation, gene, tv - pv as x, tv - cv as y from pm join tm using (perturbation, gene) join cm using (gene)), rk as (select *, rank() over (partition by sampling_seed, perturbation order by x) + (count(*) over (partition by sampling_seed, perturbation, x) - 1) / 2.0::DOUBLE as rx, rank() over (partition by sampling_seed, perturbation order by y) + (count(*) over (partition by sampling_seed, perturbation, y) - 1) / 2.0::DOUBLE as ry from dl)"
_SIM = "count(*) as n, round(corr(x, y), 6) + 0.0 as pearson, round(corr(rx, ry), 6) + 0.0 as spearman, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) + 0.0 as cosine, round(sqrt(avg((x - y) * (x - y))), 6) + 0.0 as rmse, round(avg(abs(x - y)), 6) + 0.0 as mae, round(sqrt(avg(x * x)), 6) + 0.0 as rms_x, round(sqrt(avg(y * y)), 6) + 0.0 as rms_y"


@query("effect_deltas", _DELTA + " select sampling_seed, perturbation, gene, round(x, 6) + 0.0 as strategy_delta, round(y, 6) + 0.0 as common_delta from dl")
def _(t):
    return _rounded(_deltas(t), _BY)


@query("effect_similarity", _DELTA + f" select sampling_seed, perturbation, {_SIM} from rk group by sampling_seed, perturbation")
def _(t):
    return _rounded(E.effect_similarity(_deltas(t), _BY), _BY)


_TOP = _DELTA + ", tk as (select *, row_number() over (partition by sampling_seed, perturbation order by abs(y) desc, gene) as nc, row_number() over (partition by sampling_seed, perturbation order by abs(x) desc, gene) as ns from dl), t10 as (select *, rank() over (partition by sampling_seed, perturbation order by x) as rx, rank() over (partition by sampling_seed, perturbation order by y) as ry from tk where nc <= 20)"


@query("effect_topk", _TOP + " select sampling_seed, perturbation, round(corr(x, y), 6) + 0.0 as pearson, round(corr(rx, ry), 6) + 0.0 as spearman, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) + 0.0 as cosine, round(avg((sign(x) = sign(y))::INT), 6) + 0.0 as sign_agreement, round(count(*) filter (ns <= 20) / count(*), 6) + 0.0 as overlap from t10 group by all")
def _(t):
    return _rounded(E.effect_topk(_deltas(t), _BY, 20), _BY)


_ALL = (
    _TOP
    + ", e1 as (select sampling_seed, perturbation, count(*)::DOUBLE as n, corr(x, y) as pearson, corr(rx, ry) as spearman, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) as cosine, sqrt(avg((x - y) * (x - y))) as rmse, avg(abs(x - y)) as mae, sqrt(avg(x * x)) as rms_x, sqrt(avg(y * y)) as rms_y from rk group by sampling_seed, perturbation)"
    + ", e2 as (select sampling_seed, perturbation, corr(x, y) as top20_pearson, corr(rx, ry) as top20_spearman, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) as top20_cosine, avg((sign(x) = sign(y))::INT) as top20_sign_agreement, count(*) filter (ns <= 20) / count(*) as top20_overlap from t10 group by sampling_seed, perturbation)"
    + ", lg as (unpivot (select * from e1 join e2 using (sampling_seed, perturbation)) on columns(* exclude (sampling_seed, perturbation)) into name metric value value)"
)
_STATS = "round(avg(value), 6) + 0.0 as mean, round(median(value), 6) + 0.0 as median, round(stddev_pop(value), 6) + 0.0 as std, round(stddev_pop(value) / sqrt(count(value)), 6) + 0.0 as sem, count(value) as n_valid from lg group by all"


@query("effect_run_summary", _ALL + f" select sampling_seed, metric, {_STATS}")
def _(t):
    table = E.effect_table(_deltas(t), _BY, [20]).withColumn("n", F.col("n").cast("double"))
    return _rounded(E.summarize(table, ["sampling_seed"], [c for c in table.columns if c not in _BY]), ["sampling_seed", "metric"])


@query(
    "effect_report",
    _ALL + f" select 'perturbation' as level, sampling_seed, perturbation, metric, {_STATS} union all select 'run', sampling_seed, null, metric, {_STATS} union all select 'variant', null, null, metric, {_STATS}",
)
def _(t):
    report = E.effect_report(E.effect_table(_deltas(t), _BY, [20]), ["sampling_seed"], [])
    return _rounded(report, ["level", "sampling_seed", "perturbation", "metric"])


_ROW = _S1 + ", pr as (select ps.cell_id, ps.value as x, e.value as y, e.gene, ps.sampling_seed from ps join expr e on e.cell_id = ps.cell_id and e.gene = ps.gene)"


def _rows(t):
    own = t.expr().select("cell_id", "gene", F.col("value").alias("y"))
    return _pseudo(t).select("sampling_seed", "cell_id", "gene", F.col("value").alias("x")).join(own, ["cell_id", "gene"])


@query("rowwise_pearson", _ROW + " select sampling_seed, cell_id, round(corr(x, y), 6) + 0.0 as pearson from pr group by all")
def _(t):
    return _rounded(E.rowwise_metrics(_rows(t), ["sampling_seed", "cell_id"]).select("sampling_seed", "cell_id", "pearson"), ["sampling_seed", "cell_id"])


@query("rowwise_cosine", _ROW + " select sampling_seed, cell_id, round(sum(x * y) / (sqrt(sum(x * x) * sum(y * y)) + 1e-12), 6) + 0.0 as cosine from pr group by all")
def _(t):
    return _rounded(E.rowwise_metrics(_rows(t), ["sampling_seed", "cell_id"]).select("sampling_seed", "cell_id", "cosine"), ["sampling_seed", "cell_id"])


_XY = cte("run") + ", xy as (select strategy, sampling_seed, input_only_mse_xt as x, case when run_no % 10 <> 0 then model_mse_xt end as y from run)"


def _xy(t):
    return t.view("run").select("strategy", "sampling_seed", F.col("input_only_mse_xt").alias("x"), F.when(F.col("run_no") % 10 != 0, F.col("model_mse_xt")).alias("y"))


@query("safe_pearson", _XY + " select strategy, round(corr(x, y), 6) + 0.0 as pearson from xy where y is not null group by all")
def _(t):
    return _rounded(E.pair_metrics(_xy(t), ["strategy"]).select("strategy", "pearson"), ["strategy"])


@query("safe_cosine", _XY + " select strategy, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) + 0.0 as cosine from xy where y is not null group by all")
def _(t):
    return _rounded(E.pair_metrics(_xy(t), ["strategy"]).select("strategy", "cosine"), ["strategy"])


@query("safe_spearman", _XY + ", r as (select strategy, rank() over (partition by strategy order by x) + (count(*) over (partition by strategy, x) - 1) / 2.0::DOUBLE as rx, rank() over (partition by strategy order by y) + (count(*) over (partition by strategy, y) - 1) / 2.0::DOUBLE as ry from xy where y is not null) select strategy, round(corr(rx, ry), 6) + 0.0 as spearman from r group by all")
def _(t):
    return _rounded(E.pair_metrics(_xy(t), ["strategy"], large=True).select("strategy", "spearman"), ["strategy"])


@query("safe_corr2", _XY + ", z as (select strategy, sampling_seed, x, case when sampling_seed = 4 then 3.0::DOUBLE + 1e-7 * (x > 0)::INT else y end as y from xy where y is not null), zr as (select *, rank() over (partition by strategy, sampling_seed order by x) + (count(*) over (partition by strategy, sampling_seed, x) - 1) / 2.0::DOUBLE as rx, rank() over (partition by strategy, sampling_seed order by y) + (count(*) over (partition by strategy, sampling_seed, y) - 1) / 2.0::DOUBLE as ry from z) select strategy, sampling_seed, count(*) as n, case when sampling_seed <> 4 then round(corr(x, y), 6) + 0.0 end as pearson, case when sampling_seed <> 4 then round(corr(rx, ry), 6) + 0.0 end as spearman from zr group by strategy, sampling_seed")
def _(t):
    close = F.when(F.col("y").isNotNull() & (F.col("sampling_seed") == 4), 3.0 + F.when(F.col("x") > 0, 1e-7).otherwise(0.0)).otherwise(F.col("y"))
    by = ["strategy", "sampling_seed"]
    return _rounded(E.guarded_correlation(_xy(t).withColumn("y", close), by), by)


@query("summarize_array", _XY + ", l as (unpivot (select strategy, x, y from xy) on x, y into name metric value value) select strategy, metric, round(avg(value), 6) + 0.0 as mean, round(median(value), 6) + 0.0 as median, round(stddev_pop(value), 6) + 0.0 as std, round(stddev_pop(value) / sqrt(count(value)), 6) + 0.0 as sem, count(value) as n_valid from l group by all")
def _(t):
    return _rounded(E.summarize(_xy(t), ["strategy"], ["x", "y"]), ["strategy", "metric"])


@query("summarize_numeric", _XY + " select strategy, sampling_seed, round(avg(y), 6) + 0.0 as y_mean, round(stddev_samp(y), 6) + 0.0 as y_std, round(median(y), 6) + 0.0 as y_median, round(min(y), 6) + 0.0 as y_min, round(max(y), 6) + 0.0 as y_max, count(y) as y_n from xy group by all")
def _(t):
    return _rounded(E.summarize_numeric(_xy(t), ["strategy", "sampling_seed"], ["y"]), ["strategy", "sampling_seed"])
