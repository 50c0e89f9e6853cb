"""Matching strategies over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.exprs import draw_sql, numbered, r6
from pairlane.functions.storage import new_folder
from pairlane.operators import normalise as N
from pairlane.operators import pairing as M
from pairlane.plans.registry import query
from pairlane.sources.fixtures import cte
from pairlane.sources.tables import write_table

SEEDS = [0, 1, 2]


def _n(t) -> int:
    return t.cell().where("analysis_group = 'control'").count()


def _long(cells, *keys):
    """Array profiles as rounded (gene, value) rows."""
    return cells.select(*keys, F.posexplode("profile").alias("i", "x")).select(*keys, F.format_string("g%03d", "i").alias("gene"), r6(F.col("x").cast("double")).alias("value"))


_BASE = cte("expr", "control", "treated") + ", n as (select count(*) as n from control), s as (select unnest([0, 1, 2]) as sampling_seed)"
_S0 = _BASE + ", m as (select gene, avg(value) as value from expr where analysis_group = 'control' group by all) select cell_id, gene, round(value, 6) + 0.0 as value from treated, m"


@query("s0_mean_control", _S0)
def _(t):
    return _long(M.mean_control(t.treated(), t.control()), "cell_id")


@query("write_repeated_profile", _S0.replace("select cell_id, gene,", "select perturbation, cell_id, gene,"))
def _(t):
    path = new_folder(t.spark, "profiles")
    write_table(M.mean_control(t.treated().select("cell_id", "perturbation"), t.control()), path, ["perturbation"])
    return _long(t.spark.read.parquet(path), "perturbation", "cell_id")


_S1 = _BASE + f", p as (select t.cell_id, t.perturbation, t.pos, s.sampling_seed, {draw_sql(chr(39) + 's1' + chr(39), 's.sampling_seed', 't.cell_id')} % n as control_pos from treated t, s, n)"


@query("s1_random_single", _S1 + " select p.cell_id, p.sampling_seed, c.cell_id as control_id from p join control c using (control_pos)")
def _(t):
    return M.random_single(t.treated(), t.control(), _n(t), SEEDS).select("cell_id", "sampling_seed", "control_id")


@query("gather_rows", _S1 + " select p.cell_id, p.sampling_seed, e.gene, round(e.value, 6) + 0.0 as value from p join control c using (control_pos) join expr e on e.cell_id = c.cell_id")
def _(t):
    pairs = M.random_single(t.treated(), t.control(), _n(t), SEEDS).select("cell_id", "sampling_seed", "control_id")
    rows = t.expr().select(F.col("cell_id").alias("control_id"), "gene", "value")
    return pairs.join(rows, "control_id").select("cell_id", "sampling_seed", "gene", r6(F.col("value")).alias("value"))


@query("pair_ids", _BASE + " select cell_id, 'pair_' || lpad(pos::VARCHAR, 12, '0') as pair_id from treated")
def _(t):
    return M.pair_ids(t.numbered_treated(), "pos").select("cell_id", "pair_id")


@query("pair_output_obs", _S1 + " select p.cell_id, p.pos as pairing_pos, p.perturbation as pairing_perturbation, p.sampling_seed as pairing_seed, c.cell_id as pairing_control_id, 'S1' as pairing_strategy, true as pairing_available from p join control c using (control_pos)")
def _(t):
    pairs = M.random_single(t.numbered_treated(), t.control(), _n(t), SEEDS)
    return pairs.select("cell_id", F.col("pos").alias("pairing_pos"), F.col("perturbation").alias("pairing_perturbation"), F.col("sampling_seed").alias("pairing_seed"), F.col("control_id").alias("pairing_control_id"), F.lit("S1").alias("pairing_strategy"), F.lit(True).alias("pairing_available"))


_USE = _S1 + ", u as (select p.sampling_seed, c.cell_id as control_id, count(*) as times from p join control c using (control_pos) group by all)"


@query("usage_summary", _USE + " select * from u")
def _(t):
    return M.usage(M.random_single(t.treated(), t.control(), _n(t), SEEDS), ["sampling_seed"])


@query("pairing_qc", _USE + " select sampling_seed, count(*) as n_used, round(avg(times), 6) + 0.0 as mean_use, median(times)::DOUBLE as median_use, max(times) as max_use, sum(times)::BIGINT as n_rows from u group by all")
def _(t):
    return M.usage_qc(M.random_single(t.treated(), t.control(), _n(t), SEEDS), ["sampling_seed"]).withColumn("mean_use", r6(F.col("mean_use")))


@query("usage_entropy", _USE + ", q as (select *, times / sum(times) over (partition by sampling_seed) as p from u) select sampling_seed, count(*) as n_used, round(-sum(p * ln(p)) / ln(count(*)), 6) + 0.0 as entropy from q group by all")
def _(t):
    used = M.usage(M.random_single(t.treated(), t.control(), _n(t), SEEDS), ["sampling_seed"])
    return M.usage_entropy(used, ["sampling_seed"]).withColumn("entropy", r6(F.col("entropy")))


_S2 = _BASE + f", d as (select t.cell_id, s.sampling_seed, j, {draw_sql(chr(39) + 's2' + chr(39), 's.sampling_seed', 't.cell_id', 'j')} % n as control_pos from treated t, s, n, (select unnest(range(5)) as j))"


@query("s2_random_average", _S2 + " select d.cell_id, d.sampling_seed, e.gene, round(sum(e.value) / 5, 6) + 0.0 as value from d join control c using (control_pos) join expr e on e.cell_id = c.cell_id group by all")
def _(t):
    draws = M.random_draws(t.treated(), _n(t), 5, SEEDS, "s2", "control_pos")
    vectors = t.control().select("control_pos", "vec")
    return _long(M.average_profiles(draws, vectors, "control_pos", 5), "cell_id", "sampling_seed")


@query(
    "s2_without_replacement",
    _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f", fl(cell_id, sampling_seed, j, chosen) as (select t.cell_id, s.sampling_seed, n - 5, []::BIGINT[] from treated t, s, n union all select cell_id, sampling_seed, j + 1, list_append(chosen, case when list_contains(chosen, {draw_sql(chr(39) + 's2d' + chr(39), 'sampling_seed', 'cell_id', 'j')} % (j + 1)) then j else {draw_sql(chr(39) + 's2d' + chr(39), 'sampling_seed', 'cell_id', 'j')} % (j + 1) end) from fl, n where j < n.n), ls as (select cell_id, sampling_seed, unnest(chosen) as control_pos, unnest(range(5)) as draw_no from fl where len(chosen) = 5) select ls.cell_id, ls.sampling_seed, ls.draw_no, c.cell_id as control_id from ls join control c using (control_pos)",
)
def _(t):
    return M.distinct_draws(t.treated(), t.control(), _n(t), 5, SEEDS).select("cell_id", "sampling_seed", "draw_no", "control_id")


_MC = ", mi as (select metacell_id, row_number() over (order by metacell_id) - 1 as mc_index, count(*) as mc_size from membership group by metacell_id), mm as (select m.*, mi.mc_index, mi.mc_size from membership m join mi using (metacell_id))"
_S3 = cte("expr", "control", "treated", "membership") + _MC + f", s as (select unnest([0, 1, 2]) as sampling_seed), k as (select count(*) as n from mi), mp as (select mc_index, gene, avg(value) as value from expr join mm using (cell_id) group by all), d as (select t.cell_id, s.sampling_seed, {draw_sql(chr(39) + 's3' + chr(39), 's.sampling_seed', 't.cell_id', 'j')} % n as mc_index from treated t, s, k, (select unnest(range(3)) as j))"


@query("s3_metacell_average", _S3 + " select d.cell_id, d.sampling_seed, gene, round(sum(value) / 3, 6) + 0.0 as value from d join mp using (mc_index) group by all")
def _(t):
    n = t.view("membership").select("metacell_id").distinct().count()
    draws = M.random_draws(t.treated(), n, 3, SEEDS, "s3", "mc_index")
    return _long(M.average_profiles(draws, _metacells(t), "mc_index", 3, "profile"), "cell_id", "sampling_seed")


_S4 = cte("treated", "membership") + _MC + f", k as (select count(*) as n from mi), a as (select *, row_number() over (partition by perturbation order by {draw_sql(chr(39) + 's4' + chr(39), '7', 'cell_id')}, cell_id) - 1 as o from treated), b as (select cell_id, perturbation, o % n as mc_index, o // n as use_no from a, k), r as (select *, count(*) over (partition by perturbation, mc_index) as rows_ from b), mb as (select *, row_number() over (partition by metacell_id order by {draw_sql(chr(39) + 'member' + chr(39), '7', 'cell_id')}, cell_id) - 1 as member_no from mm), q as (select r.cell_id, r.mc_index, case when rows_ <= mc_size then use_no else {draw_sql(chr(39) + 's4m' + chr(39), '7', 'r.cell_id')} % mc_size end as member_no from r join mi using (mc_index))"


def _assigned(t):
    return M.balanced_metacells(t.treated().select("cell_id", "perturbation"), t.view("membership").select("metacell_id").distinct().count(), 7)


@query("s4_balanced_assign", _S4 + " select cell_id, perturbation, mc_index, use_no from b")
def _(t):
    return _assigned(t)


@query("s4_member_sample", _S4 + " select q.cell_id, q.mc_index, q.member_no, mb.cell_id as control_id from q join mb using (mc_index, member_no)")
def _(t):
    return M.sample_members(_assigned(t), M.members(t.view("membership"), 7), 7).select("cell_id", "mc_index", "member_no", "control_id")


@query("s4_balanced_sample", _S4 + ", e as (select vec_id as cell_id, embedding from embeddings) select q.cell_id, mb.metacell_id, mb.cell_id as control_id, round(e.embedding[1]::DOUBLE, 6) + 0.0 as first_value from q join mb using (mc_index, member_no) join e on e.cell_id = mb.cell_id")
def _(t):
    pairs = M.sample_members(_assigned(t), M.members(t.view("membership"), 7), 7)
    out = pairs.join(t.control().select(F.col("cell_id").alias("control_id"), "vec"), "control_id")
    return out.select("cell_id", "metacell_id", "control_id", r6(F.get("vec", F.lit(0)).cast("double")).alias("first_value"))


def _metacells(t):
    """(mc_index, n_cells, profile)."""
    member = M.members(t.view("membership"), 0).select("metacell_id", "mc_index").distinct()
    means = N.metacells(t.expr(), t.view("membership")).join(member, "metacell_id")
    return means.groupBy("mc_index", "n_cells").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene", "mean"))), lambda s: s["mean"]).alias("profile"))


@query("ot_mass", cte("membership") + _MC + " select mc_index, round(mc_size / sum(mc_size) over (), 6) + 0.0 as mass from mi")
def _(t):
    return M.control_mass(_metacells(t)).select("mc_index", r6(F.col("mass")).alias("mass"))


_COST = cte("expr", "treated", "membership") + _MC + ", mp as (select mc_index, gene, avg(value) as value from expr join mm using (cell_id) group by all), ds as (select t.cell_id, t.perturbation, mp.mc_index, sqrt(sum((e.value - mp.value) * (e.value - mp.value))) as distance from treated t join expr e using (cell_id) join mp using (gene) group by all), co as (select *, distance / median(distance) filter (distance > 0) over (partition by perturbation) as cost from ds)"


@query("ot_cost", _COST + " select cell_id, mc_index, round(distance, 5) + 0.0 as distance, round(cost, 5) + 0.0 as cost from co")
def _(t):
    out = M.transport_cost(t.treated(), _metacells(t))
    return out.select("cell_id", "mc_index", (F.round("distance", 5) + F.lit(0.0)).alias("distance"), (F.round("cost", 5) + F.lit(0.0)).alias("cost"))


def _plan(t):
    metacell = _metacells(t)
    return M.sinkhorn(M.transport_cost(t.treated(), metacell), M.control_mass(metacell))


#: The same scaling as recursive SQL, one row for each perturbation and iteration.
_OT = _COST.replace("WITH ", "WITH RECURSIVE ", 1) + (
    ", am as (select list(mc_size::DOUBLE / (select sum(mc_size) from mi) order by mc_index) as a from mi), lo as (select *, min(cost) over (partition by perturbation, cell_id) as low from co)"
    ", kr as (select perturbation, cell_id, list(greatest(exp(-(cost - low) / 0.05::DOUBLE), 1e-250) order by mc_index) as r from lo group by all), k0 as (select perturbation, list(r order by cell_id) as m, list(cell_id order by cell_id) as cells, count(*) as n from kr group by all)"
    ", km as (select *, list_transform(range(1, len(m[1]) + 1), lambda i: list_transform(m, lambda r: r[i])) as t from k0)"
    ", it(perturbation, i, v, done) as (select perturbation, 0::BIGINT, list_transform(m, lambda r: 1.0::DOUBLE / n / (list_sum(r) / len(r))), false from km union all select perturbation, i + 1, case when near then v else w end, near from ("
    "select *, i % 10 = 0 and sqrt(list_sum(list_transform(list_zip(v, w), lambda x: (x[1] / x[2] - 1) * (x[1] / x[2] - 1)))) / n < 1e-7 as near from (select *, list_transform(m, lambda r: 1.0::DOUBLE / n / list_dot_product(r, u)) as w from ("
    "select it.perturbation, it.i, it.v, km.m, km.n, list_transform(list_zip(am.a, km.t), lambda x: x[1] / list_dot_product(x[2], it.v)) as u from it join km on km.perturbation = it.perturbation, am where not it.done and it.i < 1999))))"
    ", fin as (select perturbation, arg_max(v, i) as v from it group by all), fu as (select km.perturbation, km.cells, km.m, fin.v, list_transform(list_zip(am.a, km.t), lambda x: x[1] / list_dot_product(x[2], fin.v)) as u from km join fin using (perturbation), am)"
    ", fc as (select perturbation, u, unnest(cells) as cell_id, unnest(m) as r, unnest(v) as v from fu), fl as (select perturbation, cell_id, unnest(range(len(r))) as mc_index, unnest(list_transform(list_zip(r, u), lambda x: x[1] * x[2] * v)) as flow from fc)"
    ", sh as (select *, flow / sum(flow) over (partition by perturbation, cell_id) as w, row_number() over (partition by perturbation, cell_id order by flow desc, mc_index) as rank from fl), en as (select perturbation, cell_id, -sum(w * ln(w + 1e-12)) / ln(count(*)) as entropy, sum(w) filter (rank <= 3) as top from sh group by all)"
    ", tp as (select sh.perturbation, sh.cell_id, sh.rank, sh.mc_index, sh.w / en.top as weight, en.entropy from sh join en using (perturbation, cell_id) where rank <= 3)"
)


@query("ot_sinkhorn", _OT + " select perturbation, cell_id, mc_index, round(flow, 8) + 0.0 as flow from fl")
def _(t):
    return _plan(t).withColumn("flow", F.round("flow", 8) + F.lit(0.0))


def _top(t):
    n = t.view("membership").select("metacell_id").distinct().count()
    return M.top_transport(_plan(t), 3, n)


@query("ot_topk", _OT + " select perturbation, cell_id, rank, mc_index, round(weight, 6) + 0.0 as weight, round(entropy, 6) + 0.0 as entropy from tp")
def _(t):
    out = _top(t).select("perturbation", "cell_id", "entropy", F.explode("top").alias("t"))
    return out.select("perturbation", "cell_id", F.col("t.rank").alias("rank"), F.col("t.mc_index").alias("mc_index"), r6(F.col("t.weight")).alias("weight"), r6(F.col("entropy")).alias("entropy"))


@query("ot_assign", _OT + " select tp.perturbation, tp.cell_id, tp.mc_index, round(tp.weight, 6) + 0.0 as dominant_weight, round(tp.entropy, 6) + 0.0 as entropy, round(ds.distance, 5) + 0.0 as distance from tp join ds using (cell_id, mc_index) where tp.rank = 1")
def _(t):
    raw = M.transport_cost(t.treated(), _metacells(t)).select("cell_id", "mc_index", "distance")
    first = F.get("top", F.lit(0))
    top = _top(t).select("perturbation", "cell_id", r6(F.col("entropy")).alias("entropy"), first["mc_index"].alias("mc_index"), r6(first["weight"]).alias("dominant_weight"))
    return top.join(raw, ["cell_id", "mc_index"]).withColumn("distance", F.round("distance", 5) + F.lit(0.0))


@query(
    "s5_ot_sampled_average",
    _OT + f", mb as (select *, row_number() over (partition by metacell_id order by {draw_sql(chr(39) + 'member' + chr(39), '7', 'cell_id')}, cell_id) - 1 as member_no from mm), pk as (select tp.perturbation, tp.cell_id, tp.weight / 2 as weight, tp.mc_index, {draw_sql(chr(39) + 's5' + chr(39), '7', 'tp.cell_id', 'tp.mc_index', 'j')} % mi.mc_size as member_no from tp join mi using (mc_index), (select unnest([0, 1]) as j)) select pk.perturbation, pk.cell_id, e.gene, round(sum(pk.weight * e.value), 6) + 0.0 as value from pk join mb using (mc_index, member_no) join expr e on e.cell_id = mb.cell_id group by all",
)
def _(t):
    return _long(M.transport_profiles(_top(t), M.members(t.view("membership"), 7), t.control(), 2, 7), "perturbation", "cell_id")


@query(
    "strategy_grid",
    cte("cell") + ", g as (select distinct perturbation from cell where analysis_group <> 'control'), s as (select unnest([0, 1, 2]) as sampling_seed), m as (select unnest([50, 100]) as n_metacells), k as (select unnest([3, 5]) as k), tk as (select unnest([1, 3]) as top_k), r as (select 'S0' as strategy, null::INT as n_metacells, null::INT as k, null::INT as top_k, -1 as sampling_seed union all select 'S1', null, null, null, sampling_seed from s union all select 'S2', null, k, null, sampling_seed from s, k union all select 'S3', n_metacells, k, null, sampling_seed from s, m, k union all select 'S4', n_metacells, null, null, sampling_seed from s, m union all select 'S5', n_metacells, null, top_k, sampling_seed from s, m, tk) select perturbation, strategy, sampling_seed, case when n_metacells is null and k is null and top_k is null then 'default' else concat_ws('__', 'nmc_' || n_metacells, 'k_' || k, 'topk_' || top_k) end as parameter_label from g, r",
)
def _(t):
    groups = t.cell().where("analysis_group <> 'control'").select("perturbation").distinct()
    return M.strategy_grid(groups, SEEDS, [3, 5], [50, 100], [1, 3]).select("perturbation", "strategy", "sampling_seed", "parameter_label")
