"""Normalisation, gene selection, reduction and token queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import draw_sql, r6
from pairlane.operators import normalise as N
from pairlane.plans.registry import query
from pairlane.sources.fixtures import cte


def _n_cells(t) -> int:
    return t.view("counts").select("cell_id").distinct().count()


_NORM = cte("counts", "var") + ", norm as (select cell_id, gene, value * 10000.0::DOUBLE / sum(value) over (partition by cell_id) as value from counts), lg as (select cell_id, gene, ln(1 + value) as value from norm), nc as (select count(distinct cell_id) as n from counts)"


def _norm(t):
    return N.normalize_total(t.view("counts"))


@query("normalize_total", _NORM + " select cell_id, gene, round(value, 6) + 0.0 as value from norm")
def _(t):
    return _norm(t).select("cell_id", "gene", r6(F.col("value")).alias("value"))


@query("log1p_transform", _NORM + " select cell_id, gene, round(value, 6) + 0.0 as value from lg")
def _(t):
    return N.log1p(_norm(t)).select("cell_id", "gene", r6(F.col("value")).alias("value"))


@query("scale_clip", cte("expr") + ", s as (select gene, avg(value) as m, stddev_samp(value) as s from expr group by all) select cell_id, gene, round(least((value - m) / case when s > 0 then s else 1.0 end, 1.5), 6) + 0.0 as value from expr join s using (gene)")
def _(t):
    return N.scale_clip(t.expr(), 1.5).select("cell_id", "gene", r6(F.col("value")).alias("value"))


_DISP = _NORM + ", dp as (select gene, sum(exp(value) - 1) / n as mean, (sum((exp(value) - 1) * (exp(value) - 1)) - n * (sum(exp(value) - 1) / n) * (sum(exp(value) - 1) / n)) / (n - 1) as var from lg, nc group by gene, n), d as (select gene, mean, var / case when mean = 0 then 1e-12 else mean end as dispersion from dp)"


@query(
    "hvg_seurat",
    _DISP
    + """, x as (select gene, ln(1 + mean) as mean, ln(dispersion) as dispersion from d),
b as (select *, case when max(mean) over () > min(mean) over () then least(floor((mean - min(mean) over ()) / ((max(mean) over () - min(mean) over ()) / 8)), 7) else 0 end::INT as bin from x),
z as (select *, avg(dispersion) over (partition by bin) as a, stddev_samp(dispersion) over (partition by bin) as s from b),
q as (select gene, bin, case when s is null then dispersion / a when s > 0 then (dispersion - a) / s end as score from z)
select gene, bin, round(score, 5) + 0.0 as score, row_number() over (order by round(score, 9) desc nulls last, gene) as hv_rank from q""",
)
def _(t):
    out = N.hvg_seurat(N.log1p(_norm(t)), _n_cells(t), 10, bins=8)
    return out.select("gene", "bin", (F.round("score", 5) + F.lit(0.0)).alias("score"), "hv_rank")


@query(
    "hvg_cell_ranger",
    _DISP
    + """, c as (select quantile_cont(mean, [0.2, 0.4, 0.6, 0.8]) as cuts from d),
b as (select d.*, (mean > cuts[1])::INT + (mean > cuts[2])::INT + (mean > cuts[3])::INT + (mean > cuts[4])::INT as bin from d, c),
m as (select *, median(dispersion) over (partition by bin) as md from b), k as (select *, median(abs(dispersion - md)) over (partition by bin) as mad from m)
select gene, bin, round((dispersion - md) / nullif(mad, 0), 4) + 0.0 as score from k""",
)
def _(t):
    out = N.hvg_cell_ranger(N.log1p(_norm(t)), _n_cells(t), 10, bins=5)
    return out.select("gene", "bin", (F.round("score", 4) + F.lit(0.0)).alias("score"))


_STATS = cte("counts") + ", nc as (select count(distinct cell_id) as n from counts), st as (select gene, sum(value) / n as mean, greatest(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 0) as variance, count(*) filter (value <> 0) / n as nonzero_frac from counts, nc group by gene, n)"


@query("gene_stats", _STATS + " select gene, round(mean, 6) + 0.0 as mean, round(variance, 5) + 0.0 as variance, round(greatest(sqrt(variance), 1e-12), 6) + 0.0 as std, round(nonzero_frac, 6) + 0.0 as nonzero_frac from st")
def _(t):
    s = N.gene_stats(t.view("counts"))
    return s.select("gene", r6(F.col("mean")).alias("mean"), (F.round("variance", 5) + F.lit(0.0)).alias("variance"), r6(F.col("std")).alias("std"), r6(F.col("nonzero_frac")).alias("nonzero_frac"))


@query("select_program_genes", _STATS + ", top as (select gene from st where mean >= 3 and nonzero_frac >= 0.1 order by variance desc, gene limit 10) select gene, gene in (select gene from top) as selected from st")
def _(t):
    return N.select_program_genes(N.gene_stats(t.view("counts")), 3.0, 0.1, 10).select("gene", "selected")


@query("control_zscore", cte("expr") + ", c as (select * from expr where analysis_group = 'control'), s as (select gene, avg(value) as m, stddev_samp(value) as s from c group by all) select cell_id, gene, round((value - m) / s, 5) + 0.0 as value from c join s using (gene)")
def _(t):
    control = t.expr().where("analysis_group = 'control'")
    return N.control_zscore(control, N.gene_stats(control)).select("cell_id", "gene", (F.round("value", 5) + F.lit(0.0)).alias("value"))


def _axes_sql(fit: str, points: str, k: int, doublings: int = 32) -> str:
    """Axes of ``fit`` (cell_id, i, x) by squaring the covariance over and over and taking each axis out of it; coordinates of ``points``."""
    return f"""
, fm as (select i, avg(x) as m from {fit} group by i), fc as (select cell_id, i, x - m as x from {fit} join fm using (i)),
co as (select a.i, b.i as j, sum(a.x * b.x) as s from fc a join fc b using (cell_id) group by all), cr as (select i, list(s order by j) as r from co group by i), cm as (select list(r order by i) as c from cr),
pw as (
  select 0 as axis, 0 as step, c as m, c, null::DOUBLE[] as v from cm
  union all
  select axis + (step = {doublings})::INT, (step + 1) % {doublings + 1}, list_transform(nm, lambda r: list_transform(r, lambda x: x / tr)), nc, nv
  from (select *, list_sum(list_transform(range(1, len(nm) + 1), lambda i: nm[i][i])) as tr from (
    select axis, step, nv, case when nv is null then c else list_transform(range(1, len(c) + 1), lambda i: list_transform(range(1, len(c) + 1), lambda j: c[i][j] - ev * nv[i] * nv[j])) end as nc,
           case when nv is null then list_transform(m, lambda r: list_transform(m, lambda k: list_dot_product(r, k))) else nc end as nm
    from (select *, list_dot_product(nv, list_transform(c, lambda r: list_dot_product(r, nv))) as ev from (
      select *, case when step = {doublings} then list_transform(m[big], lambda x: x / sqrt(list_dot_product(m[big], m[big]))) end as nv
      from (select *, list_position(dg, list_max(dg)) as big from (select *, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) as dg from pw where axis < {k}))))))
),
ax as (select axis - 1 as axis, unnest(v) * case when list_max(v) >= -list_min(v) then 1 else -1 end as w, generate_subscripts(v, 1) as i from pw where v is not null)
select p.cell_id, ax.axis, round(sum((p.x - fm.m) * ax.w), 4) + 0.0 as value from {points} p join fm using (i) join ax using (i) group by all"""


def _long(df):
    return df.select("cell_id", F.posexplode("pca").alias("axis", "value")).withColumn("value", F.round("value", 4) + F.lit(0.0))


@query("pca_fit_transform", cte("cell", recursive=True) + ", pt as (select cell_id, analysis_group, unnest(vec)::DOUBLE as x, generate_subscripts(vec, 1) as i from cell), ft as (select * from pt where analysis_group = 'control')" + _axes_sql("ft", "pt", 8))
def _(t):
    return _long(N.pca(t.cell().select("cell_id", "vec"), t.control().select("vec"), 8))


@query(
    "hvg_pca_embedding",
    _DISP.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, x as (select gene, ln(1 + mean) as mean, ln(dispersion) as dispersion from d),
b as (select *, case when max(mean) over () > min(mean) over () then least(floor((mean - min(mean) over ()) / ((max(mean) over () - min(mean) over ()) / 8)), 7) else 0 end::INT as bin from x),
z as (select *, avg(dispersion) over (partition by bin) as a, stddev_samp(dispersion) over (partition by bin) as s from b),
q as (select gene, case when s is null then dispersion / a when s > 0 then (dispersion - a) / s end as score from z),
hv as (select gene, row_number() over (order by gene) as i from (select gene, row_number() over (order by score desc nulls last, gene) as n from q where score is not null) where n <= 10),
cl as (select distinct cell_id from lg join hv using (gene)), pt as (select cl.cell_id, hv.i, coalesce(lg.value, 0) as x from cl cross join hv left join lg on lg.cell_id = cl.cell_id and lg.gene = hv.gene)"""
    + _axes_sql("pt", "pt", 4),
)
def _(t):
    logs = N.log1p(_norm(t))
    genes = N.hvg_seurat(logs, _n_cells(t), 10, bins=8).where("highly_variable").select("gene")
    order = genes.withColumn("i", F.row_number().over(Window.orderBy("gene")) - 1)
    rows = logs.join(order, "gene").groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    dense = rows.select("cell_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))
    return _long(N.pca(dense, dense, 4))


@query(
    "knn_graph",
    cte("cell") + ", q as (select cell_id as query_id, vec as a from cell where cell_id % 100 = 0), d as (select query_id, cell_id as neighbor_id, list_sum(list_transform(list_zip(a, vec), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) as d2 from q join cell on query_id <> cell_id) select query_id, neighbor_id, round(d2, 5) + 0.0 as d2, row_number() over (partition by query_id order by d2, neighbor_id) as rank from d qualify rank <= 10",
)
def _(t):
    cells = t.cell().select("cell_id", "vec")
    return N.knn(cells.where(F.col("cell_id") % 100 == 0), cells, 10).withColumn("d2", F.round("d2", 5) + F.lit(0.0))


_MEANS = cte("expr") + ", gm as (select perturbation, gene, avg(value) as mean, sum(value) as total, count(*) as n from expr group by all)"


@query("group_mean", _MEANS + " select perturbation, gene, round(mean, 6) + 0.0 as mean from gm")
def _(t):
    return N.group_means(t.expr(), ["perturbation"], t.cell()).select("perturbation", "gene", r6(F.col("mean")).alias("mean"))


@query("group_sum", _MEANS + " select perturbation, gene, round(total, 6) + 0.0 as total from gm")
def _(t):
    return N.group_means(t.expr(), ["perturbation"], t.cell()).select("perturbation", "gene", r6(F.col("total")).alias("total"))


@query("metacell_build", cte("expr", "membership") + " select metacell_id, gene, count(*) as n_cells, round(avg(value), 6) + 0.0 as mean from expr join membership using (cell_id) group by all")
def _(t):
    return N.metacells(t.expr(), t.view("membership")).select("metacell_id", "gene", "n_cells", r6(F.col("mean")).alias("mean"))


def _kmeans_sql(n: int, seed: int, rounds: int = 20) -> str:
    """Far-apart first centres and Lloyd rounds, one after another; a round after the last move changes nothing."""
    d2 = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = [cte("control") + f", v as (select cell_id, list_transform(vec, lambda x: x::DOUBLE) as vec, row_number() over (order by {draw_sql(chr(39) + 'metacell' + chr(39), str(seed), 'cell_id')}, cell_id) as o from control), dr as (select * from v where o <= {4 * n}), f0 as materialized (select o, vec, 0 as j from dr where o = 1)"]
    for j in range(1, n):
        out.append(f"f{j} as materialized (from f{j - 1} union all (select o, vec, {j} from (select o, vec, (select min({d2.format('dr.vec', 'f.vec')}) from f{j - 1} f) as d from dr where o not in (select o from f{j - 1})) order by d desc, o limit 1))")
    out.append(f"c0 as materialized (select j, vec from f{n - 1})")
    for r in range(1, rounds + 1):
        near = f"select cell_id, vec, arg_min(j, (d, j)) as j from (select v.cell_id, v.vec, c.j, {d2.format('v.vec', 'c.vec')} as d from v, c{r - 1} c) group by all"
        out.append(f"n{r} as materialized ({near}), m{r} as materialized (select j, list(x order by i) as vec from (select j, i, avg(x) as x from (select j, unnest(vec) as x, generate_subscripts(vec, 1) as i from n{r}) group by all) group by j), c{r} as materialized (select c.j, coalesce(m.vec, c.vec) as vec from c{r - 1} c left join m{r} m using (j))")
    return ", ".join(out)


@query("metacell_assign", _kmeans_sql(12, 1) + f" select cell_id, 'mc_' || arg_min(j, (d, j)) as metacell_id from (select v.cell_id, c.j, list_sum(list_transform(list_zip(v.vec, c.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v, c20 c) group by cell_id")
def _(t):
    return N.assign_metacells(t.control().select("cell_id", "vec"), 12, 1)


@query("rank_tokens", cte("counts", "var") + ", s as (select cell_id, gene_pos, row_number() over (partition by cell_id order by value desc, gene_pos) as n from counts join var using (gene) where value > 0) select cell_id, string_agg((gene_pos + 100)::VARCHAR, ' ' order by n) as tokens from s where n <= 2048 group by all")
def _(t):
    expr = t.view("counts").join(t.view("var").select("gene", "gene_pos", (F.col("gene_pos") + 100).alias("token_id")), "gene")
    return N.rank_tokens(expr, 2048).select("cell_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


@query("gene_value_sequence", cte("counts", "var") + " select cell_id, '-1:0 ' || string_agg(gene_pos || ':' || value::BIGINT, ' ' order by gene_pos) as sequence, count(*) + 1 as length from counts join var using (gene) group by all")
def _(t):
    expr = t.view("counts").join(t.view("var").select("gene", F.col("gene_pos").alias("gene_id")), "gene")
    out = N.gene_value_sequence(expr, -1)
    text = F.array_join(F.transform("sequence", lambda s: F.concat_ws(":", s["gene_id"].cast("string"), s["value"].cast("bigint").cast("string"))), " ")
    return out.select("cell_id", text.alias("sequence"), F.size("sequence").cast("long").alias("length"))


@query("mean_pool", cte("expr") + " select cell_id, gene_pos % 8 as dim, round(avg(value), 6) + 0.0 as value from expr where gene_pos // 8 < 1 + cell_id % 7 group by all")
def _(t):
    rows = t.expr().select("cell_id", (F.col("gene_pos") % 8).alias("dim"), "value", (F.floor(F.col("gene_pos") / 8) < 1 + F.col("cell_id") % 7).alias("mask"))
    return N.mean_pool(rows).select("cell_id", "dim", r6(F.col("value")).alias("value"))


@query("l2_normalize", cte("expr") + " select cell_id, gene, round(value / sqrt(sum(value * value) over (partition by cell_id)), 6) + 0.0 as value from expr")
def _(t):
    long = t.cell().select("cell_id", F.posexplode(N.l2_normalize(F.col("vec"))).alias("i", "x"))
    return long.select("cell_id", F.format_string("g%03d", "i").alias("gene"), r6(F.col("x")).alias("value"))
