"""Statistical comparison queries. Blocks are seeds; methods are canonical variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.exprs import r6
from pairlane.operators import stats as S
from pairlane.plans.evaluate import _rounded
from pairlane.plans.manifest import RUN, runs
from pairlane.plans.registry import query

#: Seed means of every strategy: all five strategies of the view have the same five seeds.
SEED = RUN + ", sm as (select strategy_canonical as method, sampling_seed, avg(model_mse_xt) as value, avg(input_only_mse_xt) as other from m group by all)"
_REF = "S1_random_single_control"


def seed_means(t):
    return runs(t).groupBy(F.col("strategy_canonical").alias("method"), "sampling_seed").agg(F.avg("model_mse_xt").alias("value"), F.avg("input_only_mse_xt").alias("other"))


def _against(t):
    """(method, x, y): each method's seed mean and the reference's."""
    s = seed_means(t)
    ref = s.where(F.col("method") == _REF).select("sampling_seed", F.col("value").alias("y"))
    return s.where(F.col("method") != _REF).join(ref, "sampling_seed").select("method", F.col("value").alias("x"), "y")


def _sides(t):
    """Each method's values as side x, the reference's as side y."""
    s = seed_means(t)
    ref = s.where(F.col("method") == _REF).select(F.col("value").alias("value"))
    names = s.where(F.col("method") != _REF).select("method").distinct()
    return s.where(F.col("method") != _REF).select("method", F.lit("x").alias("side"), "value").unionByName(names.join(F.broadcast(ref)).select("method", F.lit("y").alias("side"), "value"))


def _t_even(t: str, df: int) -> str:
    """Two-sided p of Student's t with an even number of degrees of freedom, in closed form."""
    x = f"atan(abs({t}) / sqrt({df}.0::DOUBLE))"
    terms, c = ["1"], 1.0
    for i in range(1, df // 2):
        c *= (2 * i - 1) / (2 * i)
        terms.append(f"{c!r}::DOUBLE * pow(cos({x}), {2 * i})")
    return f"(1 - sin({x}) * ({' + '.join(terms)}))"


_PAIR = SEED + f", pr as (select a.method, a.value as x, b.value as y from sm a join sm b using (sampling_seed) where b.method = '{_REF}' and a.method <> '{_REF}')"


@query("paired_design_check", SEED + ", s as (select method, list_sort(list(distinct sampling_seed)) as s from sm group by all) select count(distinct s) = 1 and min(len(s)) >= 2 as paired, max(len(s))::INT as n_seeds from s")
def _(t):
    return S.paired_design(seed_means(t), [], "method", "sampling_seed")


@query("paired_t", _PAIR + " select method, count(*) as n, round(avg(x - y), 6) + 0.0 as mean_difference, count(*) - 1 as df, round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 5) + 0.0 as t, round(" + _t_even("(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))))", 4) + ", 6) + 0.0 as p from pr group by all")
def _(t):
    return S.paired_t(_against(t), ["method"]).select("method", "n", r6(F.col("mean_difference")).alias("mean_difference"), "df", (F.round("t", 5) + F.lit(0.0)).alias("t"), r6(F.col("p")).alias("p"))


#: Two-sided p of Student's t for any degrees of freedom: Simpson's rule over the density from 0 to |t|.
_T_ANY = ", ti as (select *, abs({t}) / 4000 as step, exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) as c from w), tq as (select *, 1 - 2 * c * step / 3 * list_sum(list_transform(range(0, 4001), lambda i: (case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(1 + pow(i * step, 2) / {df}, -({df} + 1) / 2))) as p from ti)"
#: Two-sided p of a normal z by the power series of the error function.
_NORMAL = "(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda n: pow(-1.0, n) * pow(abs({z}) / sqrt(2.0), 2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1)))))"


@query("welch_t", SEED + f", x as (select method, count(*) as n_x, avg(value) as mx, var_samp(value) as vx from sm where method <> '{_REF}' group by all), y as (select count(*) as n_y, avg(value) as my, var_samp(value) as vy from sm where method = '{_REF}'), w as (select *, (vx / n_x + vy / n_y) * (vx / n_x + vy / n_y) / ((vx / n_x) * (vx / n_x) / (n_x - 1) + (vy / n_y) * (vy / n_y) / (n_y - 1)) as df, (mx - my) / sqrt(vx / n_x + vy / n_y) as t from x, y)" + _T_ANY.replace("{t}", "t").replace("{df}", "df") + " select method, n_x, n_y, round(mx, 6) + 0.0 as mean_x, round(my, 6) + 0.0 as mean_y, round(df, 5) + 0.0 as df, round(t, 5) + 0.0 as t, round(p, 6) + 0.0 as p from tq")
def _(t):
    w = S.welch_t(_sides(t), ["method"])
    return w.select("method", "n_x", "n_y", r6(F.col("mean_x")).alias("mean_x"), r6(F.col("mean_y")).alias("mean_y"), (F.round("df", 5) + F.lit(0.0)).alias("df"), (F.round("t", 5) + F.lit(0.0)).alias("t"), r6(F.col("p")).alias("p"))


#: S5 has seeds of its own, so it is tested without pairs.
_TESTS = (
    SEED
    + f", a as (select method as variant_id, sampling_seed + 100 * (method like 'S5%')::INT as seed, value from sm), ref as (select seed, value as y from a where variant_id = '{_REF}'), j as (select variant_id, value as x, y from a left join ref using (seed) where variant_id <> '{_REF}')"
    + ", g as (select variant_id, count(y) >= 2 and count(y) = count(*) as paired, count(*) as n_x, avg(x) as mean_x, var_samp(x) as vx, count(y) - 1 as pairs, avg(x - y) / (stddev_samp(x - y) / sqrt(count(y))) as pt from j group by all), y as (select count(*) as n_y, avg(y) as mean_y, var_samp(y) as vy from ref)"
    + ", w as (select *, case when paired then pairs::DOUBLE else pow(vx / n_x + vy / n_y, 2) / (pow(vx / n_x, 2) / (n_x - 1) + pow(vy / n_y, 2) / (n_y - 1)) end as df, case when paired then pt else (mean_x - mean_y) / sqrt(vx / n_x + vy / n_y) end as t from g, y)"
    + _T_ANY.replace("{t}", "t").replace("{df}", "df")
    + ", th as (select *, row_number() over (order by p, variant_id) as r, count(*) over () as m from tq), ta as (select *, least(max((m - r + 1) * p) over (order by r rows unbounded preceding), 1) as p_holm from th)"
)


@query(
    "reference_tests",
    _TESTS + " select variant_id, case when paired then 'paired' else 'welch' end as test, round(mean_x, 6) + 0.0 as mean_x, round(mean_y, 6) + 0.0 as mean_y, round(t, 5) + 0.0 as t, round(p, 6) + 0.0 as p, round(p_holm, 6) + 0.0 as p_holm, case when p_holm <= 1e-4 then '****' when p_holm <= 1e-3 then '***' when p_holm <= 1e-2 then '**' when p_holm <= 0.05 then '*' else 'ns' end as stars from ta",
)
def _(t):
    own = seed_means(t).withColumn("sampling_seed", F.col("sampling_seed") + 100 * F.col("method").startswith("S5").cast("int"))
    out = S.reference_tests(own.withColumnRenamed("method", "variant_id"), _REF, [])
    return out.select("variant_id", "test", r6(F.col("mean_x")).alias("mean_x"), r6(F.col("mean_y")).alias("mean_y"), (F.round("t", 5) + F.lit(0.0)).alias("t"), r6(F.col("p")).alias("p"), r6(F.col("p_holm")).alias("p_holm"), "stars")


#: One group more: the reference with itself, whose pairs are all equal.
_ABS = _PAIR + f", pa as (select * from pr union all select 'same', value, value from sm where method = '{_REF}'), al as (select method, count(*) as pairs, max(abs(x - y)) <= 1e-8 as same from pa group by all), d as (select method, x - y as d, rank() over (partition by method order by abs(x - y)) + (count(*) over (partition by method, abs(x - y)) - 1) / 2.0::DOUBLE as r from pa where x <> y)"
#: Exact p by listing all choices of signs, and of places of the one sample.
_SIGNS = "(select least(1.0, 2.0::DOUBLE * count(*) filter (list_sum(list_transform(range(z.n), lambda i: ((b.c >> i::INT) & 1) * (i + 1))) <= z.statistic) / count(*)) from (select unnest(range(1::BIGINT << z.n::INT)) as c) b)"
_PLACES = "(select least(1.0, 2.0::DOUBLE * count(*) filter (list_sum(list_transform(range(z.n_x + z.n_y), lambda i: ((b.c >> i::INT) & 1) * (i + 1))) - z.n_x * (z.n_x + 1) / 2 <= least(z.u, z.n_x * z.n_y - z.u)) / count(*)) from (select unnest(range(1::BIGINT << (z.n_x + z.n_y)::INT)) as c) b where bit_count(b.c) = z.n_x)"


@query("wilcoxon", _ABS + ", w as (select al.method, al.pairs, al.same, count(d) as n, coalesce(sum(r) filter (d > 0), 0) as w_plus, coalesce(sum(r) filter (d < 0), 0) as w_minus, sum(c * c - 1) as tie from al left join (select *, count(*) over (partition by method, abs(d)) as c from d) q using (method) group by all), z as (select *, case when same then 0 else least(w_plus, w_minus) end as statistic, not same and n = pairs and tie = 0 and n <= 50 as exact, case when not same then (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) end as z from w) select method, n, round(w_plus, 6) + 0.0 as w_plus, round(w_minus, 6) + 0.0 as w_minus, round(statistic, 6) + 0.0 as statistic, exact, round(z, 6) + 0.0 as z, round(case when same then 1 when exact then " + _SIGNS + " else " + _NORMAL.replace("{z}", "z.z") + " end, 6) + 0.0 as p from z")
def _(t):
    own = seed_means(t).where(F.col("method") == _REF)
    equal = own.select(F.lit("same").alias("method"), F.col("value").alias("x"), F.col("value").alias("y"))
    return _rounded(S.wilcoxon(_against(t).select("method", "x", "y").unionByName(equal), ["method"]), ["method", "exact"])


@query("mann_whitney", SEED + f", b as (select method, 'x' as side, value from sm where method <> '{_REF}' union all select n.method, 'y', r.value from (select distinct method from sm where method <> '{_REF}') n, sm r where r.method = '{_REF}'), r as (select *, rank() over (partition by method order by value) + (count(*) over (partition by method, value) - 1) / 2.0::DOUBLE as r, count(*) over (partition by method, value) as c from b), w as (select method, count(*) filter (side = 'x') as n_x, count(*) filter (side = 'y') as n_y, sum(r) filter (side = 'x') - count(*) filter (side = 'x') * (count(*) filter (side = 'x') + 1) / 2.0::DOUBLE as u, sum(c * c - 1) as tie from r group by all), z as (select *, tie = 0 and least(n_x, n_y) <= 8 as exact, sign(u - n_x * n_y / 2) * (abs(u - n_x * n_y / 2) - 0.5) / sqrt(n_x * n_y / 12 * (n_x + n_y + 1 - tie / ((n_x + n_y) * (n_x + n_y - 1)))) as z from w) select method, n_x, n_y, u, exact, round(z, 6) + 0.0 as z, round(case when exact then " + _PLACES + " when abs(u - n_x * n_y / 2) < 0.5 then 1 else " + _NORMAL.replace("{z}", "z.z") + " end, 6) + 0.0 as p from z")
def _(t):
    return _rounded(S.mann_whitney(_sides(t), ["method"]), ["method", "u", "exact"])


_RANK = SEED + ", rk as (select *, rank() over (partition by sampling_seed order by value) + (count(*) over (partition by sampling_seed, value) - 1) / 2.0::DOUBLE as rank from sm), rs as (select method, sum(rank) as s, sum(rank * rank) as a, count(*) as n from rk group by all), tt as (select count(*) as k, max(n) as n, sum(s * s) as q, sum(a) as a from rs)"


@query("friedman", _RANK + " select k, n, round(12.0::DOUBLE / (n * k * (k + 1)) * q - 3 * n * (k + 1), 6) + 0.0 as chi2, k - 1 as df, round(exp(-(12.0::DOUBLE / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / 2) * (1 + (12.0::DOUBLE / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / 2), 6) + 0.0 as p from tt")
def _(t):
    return S.friedman(seed_means(t), "sampling_seed", "method", "value").select("k", "n", r6(F.col("chi2")).alias("chi2"), "df", r6(F.col("p")).alias("p"))


#: Upper tail of chi-square for any degrees of freedom: one less the power series of the lower incomplete gamma function.
_CHI2 = "case when {h} <= 0 then 1 else 1 - list_sum(list_transform(range(0, 400), lambda i: exp(({df} / 2.0::DOUBLE + i) * ln({h} / 2) - {h} / 2 - lgamma({df} / 2.0::DOUBLE + i + 1)))) end"


@query("kruskal", SEED + ", r as (select method, rank() over (order by round(value, 9)) + (count(*) over (partition by round(value, 9)) - 1) / 2.0::DOUBLE as r, count(*) over (partition by round(value, 9)) as c from sm), s as (select method, sum(r) as s, count(*) as n, sum(c * c - 1) as tie from r group by all), q as (select count(*) as k, sum(n)::BIGINT as n, (12.0::DOUBLE / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / nullif(1 - sum(tie)::DOUBLE / (sum(n) * sum(n) * sum(n) - sum(n)), 0) as h from s) select k, n, round(h, 6) + 0.0 as h, k - 1 as df, round(" + _CHI2.replace("{h}", "h").replace("{df}", "(k - 1)") + ", 6) + 0.0 as p from q")
def _(t):
    # means that agree to nine decimals are ties: their last bits depend on the order of the sum
    means = seed_means(t).select("method", F.round("value", 9).alias("value"))
    return S.kruskal(means, "method", "value").select("k", "n", r6(F.col("h")).alias("h"), "df", r6(F.col("p")).alias("p"))


_P = RUN + ", p as (select variant_id, case when count(*) % 7 <> 0 then sum(run_no % 97)::BIGINT % 1000 / 5000.0::DOUBLE end as p from m group by all)"


def _ps(t):
    g = runs(t).groupBy("variant_id").agg(F.count("*").alias("_n"), F.sum(F.col("run_no") % 97).alias("_s"))
    return g.select("variant_id", F.when(F.col("_n") % 7 != 0, F.col("_s") % 1000 / 5000.0).alias("p"))


@query("holm_adjust", _P + ", h as (select *, row_number() over (order by p, variant_id) as r, count(*) over () as m from p where p is not null), a as (select variant_id, least(max((m - r + 1) * p) over (order by r rows unbounded preceding), 1) as ph from h) select variant_id, round(p, 6) + 0.0 as p, round(ph, 6) + 0.0 as p_holm from p left join a using (variant_id)")
def _(t):
    out = S.holm(_ps(t).withColumn("g", F.lit(1)), ["g"])
    return out.select("variant_id", r6(F.col("p")).alias("p"), r6(F.col("p_holm")).alias("p_holm"))


@query("p_stars", _P + " select variant_id, case when p is null then 'NA' when p <= 1e-4 then '****' when p <= 1e-3 then '***' when p <= 1e-2 then '**' when p <= 0.05 then '*' else 'ns' end as stars from p")
def _(t):
    return _ps(t).select("variant_id", S.stars(F.col("p")).alias("stars"))


#: Letters by all subsets of the methods: those without a significant pair that lie in no other such subset.
_LETTERS = (
    _RANK + ", cv as (select x.method as a, y.method as b, (tt.n - 1) * (k - 1) as df, abs(x.s - y.s) / sqrt(2 * (tt.n * tt.a - tt.q) / ((tt.n - 1) * (k - 1))) as t from rs x join rs y on x.method < y.method, tt), cp as (select *, " + _t_even("t", 16) + " as p from cv), ch as (select *, row_number() over (order by p, a || '|' || b) as r, count(*) over () as m from cp), cq as (select a, b, least(max((m - r + 1) * p) over (order by r rows unbounded preceding), 1) as p_holm from ch)"
    ", od as (select method, row_number() over (order by avg(value), method) - 1 as i from sm group by method), bad as (select x.i as i, y.i as j from cq join od x on x.method = cq.a join od y on y.method = cq.b where p_holm <= {level})"
    ", ok as (select mask from (select unnest(range(1, (1 << (select count(*) from od))::BIGINT)) as mask) where not exists (select 1 from bad where (mask >> i) & 1 = 1 and (mask >> j) & 1 = 1)), top as (select mask from ok where not exists (select 1 from ok o where o.mask <> ok.mask and o.mask & ok.mask = ok.mask))"
    ", named as (select mask, row_number() over (order by list_transform(list_filter(range(0, 20), lambda i: (mask >> i) & 1 = 1), lambda i: i)) - 1 as n from top) select method, string_agg(chr((97 + n)::INT), '' order by n) as letters from od join named on (mask >> i) & 1 = 1 group by method"
)


@query("compact_letters", _LETTERS.replace("{level}", "0.6"))
def _(t):
    ranks = S.conover(seed_means(t), "sampling_seed", "method", "value")
    order = seed_means(t).groupBy("method").agg(F.avg("value").alias("value"))
    return S.compact_letters(ranks.withColumn("different", F.col("p_holm") <= 0.6), order)


_MET = RUN + ", lg as (select variant_id, s2 as family, sampling_seed, 'x' as metric, input_only_mse_xt as value from m union all select variant_id, s2, sampling_seed, 'y', model_mse_xt from m), mv as (select variant_id, family, metric, avg(value) as value from lg group by all)"


def _metric_means(t):
    r = runs(t).withColumn("family", F.substring("strategy_canonical", 1, 2))
    long = r.select("variant_id", "family", "sampling_seed", F.col("input_only_mse_xt").alias("x"), F.col("model_mse_xt").alias("y")).unpivot(["variant_id", "family", "sampling_seed"], ["x", "y"], "metric", "value")
    return long.groupBy("variant_id", "family", "metric").agg(F.avg("value").alias("value"))


#: Critical values of the studentised range at 0.05 for k methods, divided by the root of 2.
#: Upper 0.05 points of the range of k standard normals over sqrt(2).
_Q = "(case k when 2 then 1.959963985 when 3 then 2.343700586 when 4 then 2.569031773 when 5 then 2.727774371 when 6 then 2.849705420 end)::DOUBLE"


@query("best_of_family", _MET + ", r as (select *, rank() over (partition by metric order by value) + (count(*) over (partition by metric, value) - 1) / 2.0::DOUBLE as r from mv where family = 'S5'), b as (select variant_id from r group by all order by avg(r), variant_id limit 1) select variant_id, metric, round(value, 6) + 0.0 as value from mv where family <> 'S5' or variant_id in (from b)")
def _(t):
    out = S.best_of_family(_metric_means(t).withColumn("scope", F.lit(1)), ["scope"], "S5", "variant_id", "value", False)
    return out.select("variant_id", "metric", r6(F.col("value")).alias("value"))


@query("replicate_reference", SEED + f" select method, sampling_seed, round(value, 6) + 0.0 as value from sm where method <> '{_REF}' union all select '{_REF}', s.sampling_seed, round(r.v, 6) + 0.0 from (select distinct sampling_seed from sm where method <> '{_REF}') s, (select avg(value) as v from sm where method = '{_REF}') r")
def _(t):
    return S.replicate_reference(seed_means(t), _REF).withColumn("value", r6(F.col("value")))


@query("collapse_methods", SEED + " select case when method like 'S4%' then 'metacell' when method like 'S5%' then 'metacell' else method end as method, count(*) as n from sm group by 1")
def _(t):
    names = {"S4_SEACell_balanced_random_sample": "metacell", "S5_SEACell_OT_sampled_average": "metacell"}
    return S.rewrite_methods(seed_means(t), names, []).groupBy("method").agg(F.count("*").alias("n"))


@query("exclude_methods", SEED + " select method, count(*) as n from sm where method not like 'S2%' group by all")
def _(t):
    return S.rewrite_methods(seed_means(t), {}, ["S2_random_average_controls"]).groupBy("method").agg(F.count("*").alias("n"))


@query("metric_mean_table", _MET + " select variant_id, metric, round(value, 6) + 0.0 as value from mv")
def _(t):
    return _metric_means(t).select("variant_id", "metric", r6(F.col("value")).alias("value"))


@query("complete_design", SEED + f", s as (select * from sm where not (method like 'S2%' and sampling_seed > 0)), o as (select method, row_number() over (order by count(distinct sampling_seed), method desc) as drop_no from s where method <> '{_REF}' group by method), kept as (select j, s.*, drop_no from (select unnest(range(0, 1 + count(*))) as j from o) left join s on true left join o using (method)), now as (select * from kept where coalesce(drop_no > j, true)), need as (select j, count(distinct method) as m from now group by j), good as (select j, sampling_seed from now join need using (j) group by j, sampling_seed, m having count(distinct method) = m), pick as (select min(j) as j from (select j from good group by j having count(*) >= 2)) select method, sampling_seed, round(value, 6) + 0.0 as value from now join good using (j, sampling_seed) join pick using (j)")
def _(t):
    # S2 is left only one block, so it is the first to drop
    s = seed_means(t).where("not (method like 'S2%' and sampling_seed > 0)")
    return S.complete_design(s, "sampling_seed", "method", [_REF])[0].select("method", "sampling_seed", r6(F.col("value")).alias("value"))


@query("rank_matrix", _RANK + " select method, round(avg(rank), 6) + 0.0 as mean_rank, count(*) as n_blocks from rk group by all")
def _(t):
    ranks = S.rank_matrix(seed_means(t), ["sampling_seed"], "method", "value", False)
    return _rounded(S.mean_ranks(ranks, [], "method"), ["method"])


@query("critical_distance", _RANK + f" select k, n, round({_Q} * sqrt(k * (k + 1) / (6.0::DOUBLE * n)), 6) + 0.0 as cd from tt")
def _(t):
    s = seed_means(t).agg(F.count_distinct("method").alias("k"), F.count_distinct("sampling_seed").alias("n"))
    return s.withColumn("cd", r6(S.critical_distance(F.col("k"), F.col("n"))))


@query("cd_groups", _RANK + ", mr as (select method, avg(rank) as mean_rank from rk group by all), o as (select *, row_number() over (order by mean_rank, method) as i from mr), g as (select a.i as low, max(b.i) as high from o a join o b on b.i >= a.i and b.mean_rank - a.mean_rank <= 1.0 group by all), f as (select *, coalesce(max(high) over (order by low rows between unbounded preceding and 1 preceding), 0) as before from g) select low, high from f where high > before and high > low")
def _(t):
    ranks = S.mean_ranks(S.rank_matrix(seed_means(t), ["sampling_seed"], "method", "value", False), [], "method")
    return S.cd_groups(ranks, "method", 1.0)


@query("conover_posthoc", _RANK + ", cv as (select x.method as a, y.method as b, (tt.n - 1) * (k - 1) as df, abs(x.s - y.s) / sqrt(2 * (tt.n * tt.a - tt.q) / ((tt.n - 1) * (k - 1))) as t from rs x join rs y on x.method < y.method, tt), cp as (select *, " + _t_even("t", 16) + " as p from cv), ch as (select *, row_number() over (order by p, a || '|' || b) as r, count(*) over () as m from cp) select a, b, df, round(t, 5) + 0.0 as t, round(p, 6) + 0.0 as p, round(least(max((m - r + 1) * p) over (order by r rows unbounded preceding), 1), 6) + 0.0 as p_holm from ch")
def _(t):
    return S.conover(seed_means(t), "sampling_seed", "method", "value").select("a", "b", "df", (F.round("t", 5) + F.lit(0.0)).alias("t"), r6(F.col("p")).alias("p"), r6(F.col("p_holm")).alias("p_holm"))


@query("cd_report", _MET + ", g as (select s2 as method, sampling_seed % 2 as dataset, input_only_mse_xt as x, model_mse_xt as y from m), gl as (unpivot g on x, y into name metric value v), sv as (select family as method, sampling_seed::VARCHAR as b, avg(value) as value, 'seed' as level from lg where metric = 'y' group by all union all select family, metric, avg(value), 'metric' from lg group by family, metric union all select method, dataset || '||' || metric, avg(v), 'dataset_metric' from gl group by all), r as (select *, rank() over (partition by level, b order by value) + (count(*) over (partition by level, b, value) - 1) / 2.0::DOUBLE as rank from sv), q as (select level, method, avg(rank) as mean_rank, count(*) as n_blocks from r group by all) select level, method, round(mean_rank, 6) + 0.0 as mean_rank, n_blocks, round(" + _Q.replace("case k", "case count(*) over (partition by level)") + " * sqrt(count(*) over (partition by level) * (count(*) over (partition by level) + 1) / (6.0::DOUBLE * n_blocks)), 6) + 0.0 as cd from q")
def _(t):
    r = runs(t).select(F.substring("strategy_canonical", 1, 2).alias("method"), "sampling_seed", (F.col("sampling_seed") % 2).alias("dataset"), F.col("input_only_mse_xt").alias("x"), F.col("model_mse_xt").alias("y"))
    long = r.unpivot(["method", "sampling_seed", "dataset"], ["x", "y"], "metric", "value")
    levels = {"seed": ["sampling_seed"], "metric": ["metric"], "dataset_metric": ["dataset", "metric"]}
    return _rounded(S.cd_report({k: (long.where("metric = 'y'") if k == "seed" else long, by) for k, by in levels.items()}, "method", "value", False), ["level", "method"])
