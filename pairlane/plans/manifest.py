"""Manifest queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.exprs import null_token
from pairlane.operators import manifest as M
from pairlane.plans.registry import query
from pairlane.sources.fixtures import cte

_NAME = "case strategy when 'S1' then 'S1_random_single_control' when 'S2' then 'S2_random_average_controls' when 'S3_random_metacell_average' then 'S3_SEACell_metacell_average' when 'strategy1_seacell_balanced_random_repeated' then 'S4_SEACell_balanced_random_sample' when 'S5' then 'S5_SEACell_OT_sampled_average' else strategy end"
_NUM = lambda c: f"coalesce({c}::BIGINT::VARCHAR, 'NA')"
RUN = cte("run") + (
    f", m0 as (select *, {_NAME} as strategy_canonical, coalesce(n_metacells_requested, regexp_extract(parameter_label, 'nmc_(\\d+)', 1)::DOUBLE) as n_metacells, regexp_extract(parameter_label, '__k_(\\d+)', 1)::DOUBLE as k, regexp_extract(parameter_label, 'topk_(\\d+)', 1)::DOUBLE as top_k from run)"
    f", m as (select *, left(strategy_canonical, 2) as s2, strategy_canonical || '__' || case left(strategy_canonical, 2) when 'S3' then 'nmc_' || {_NUM('n_metacells')} || '__sampledMC_' || {_NUM('k')} when 'S4' then 'nmc_' || {_NUM('n_metacells')} when 'S5' then 'nmc_' || {_NUM('n_metacells')} || '__topk_' || {_NUM('top_k')} else 'default' end as variant_id, case left(strategy_canonical, 2) when 'S0' then 0 when 'S1' then 1 when 'S2' then 2 when 'S3' then 3 when 'S4' then 4 when 'S5' then 5 else 99 end as strategy_order from m0)"
)


def runs(t):
    """Run table with canonical strategy, parameters and variant id."""
    out = M.extract_params(M.rename_strategies(t.view("run")), ["parameter_label"])
    return out.withColumn("variant_id", M.variant_id(F.col("strategy_canonical")))


@query("strategy_rename", RUN + " select strategy, strategy_canonical, strategy_order, count(*) as n from m group by all")
def _(t):
    return M.rename_strategies(t.view("run")).groupBy("strategy", "strategy_canonical", "strategy_order").agg(F.count("*").alias("n"))


@query("extract_params_regex", RUN + " select run_no, n_metacells, k, top_k from m")
def _(t):
    return runs(t).select("run_no", "n_metacells", "k", "top_k")


@query("coalesce_numeric_aliases", cte("run") + " select run_no, coalesce(n_metacells_requested, sampling_seed)::DOUBLE as value from run")
def _(t):
    from pairlane.operators.prepare import coalesce_numeric

    text = t.view("run").withColumn("a", F.when(F.col("run_no") % 3 == 0, F.lit("nan"))).withColumn("b", F.col("n_metacells_requested").cast("string")).withColumn("c", F.col("sampling_seed").cast("string"))
    return text.select("run_no", coalesce_numeric("a", "b", "c").alias("value"))


@query("variant_key_analysis", RUN + " select run_no, variant_id from m")
def _(t):
    return runs(t).select("run_no", "variant_id")


@query("variant_key_program", RUN + f" select run_no, strategy_canonical || case s2 when 'S2' then '__k_' || {_NUM('k')} when 'S3' then '__nmc_' || {_NUM('n_metacells')} || '__k_' || {_NUM('k')} when 'S4' then '__nmc_' || {_NUM('n_metacells')} when 'S5' then '__nmc_' || {_NUM('n_metacells')} || '__topk_' || {_NUM('top_k')} || '__spm_' || {_NUM('k')} else '' end as variant_id from m")
def _(t):
    return runs(t).select("run_no", M.variant_id_program(F.col("strategy_canonical")).alias("variant_id"))


_KEY = "s2 || '|' || case when s2 in ('S3', 'S4', 'S5') then n_metacells::BIGINT::VARCHAR else '' end || '|' || case s2 when 'S3' then k::BIGINT::VARCHAR when 'S5' then top_k::BIGINT::VARCHAR else '' end"


@query("variant_match_key", RUN + f" select run_no, {_KEY} as match_key from m")
def _(t):
    return runs(t).select("run_no", M.match_key(F.col("strategy_canonical")).alias("match_key"))


_PATHS = ", pa as (select run_no, strategy_canonical as s, variant_id as v, case run_no % 6 when 0 then '/out/K562/' || strategy_canonical || '/nmc_50__topk_05__seed_' || sampling_seed || '/pairs.csv' when 1 then 'C:\\data\\' || variant_id || '\\matrix.parquet' when 2 then '/x/embeddings/' || variant_id || '/X.npy' when 3 then strategy_canonical || '/' || parameter_label when 4 then 'other/name__seed_' || sampling_seed end as path, parameter_label, sampling_seed from m)"
_SLUG = _PATHS + ", sl as (select *, case run_no % 6 when 0 then s || '__nmc_50__topk_05__seed_' || sampling_seed when 1 then v when 2 then v when 3 then s || '__' || parameter_label when 4 then 'other__name__seed_' || sampling_seed else '' end as slug from pa)"


@query(
    "variant_slug",
    RUN + _SLUG + ", b as (select run_no, slug, case when run_no % 6 = 4 then 'other__name' when run_no % 6 = 5 then '' else s end as base, case when s not like 'S5%' or run_no % 6 > 3 then '' when run_no % 6 = 0 then '50&5' else coalesce(regexp_extract(slug, 'nmc_(\\d+)', 1) || '&' || ltrim(regexp_extract(slug, 'topk_(\\d+)', 1), '0'), '') end as s5 from sl) select * from b",
)
def _(t):
    r = runs(t)
    seed, text = F.col("sampling_seed").cast("string"), lambda *x: F.concat(*[F.lit(y) if i % 2 == 0 else y for i, y in enumerate(x)])
    s, v = F.col("strategy_canonical"), F.col("variant_id")
    forms = [text("/out/K562/", s, "/nmc_50__topk_05__seed_", seed, "/pairs.csv"), text("C:\\data\\", v, "\\matrix.parquet"), text("/x/embeddings/", v, "/X.npy"), text("", s, "/", F.col("parameter_label")), text("other/name__seed_", seed)]
    path = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        path = F.when(F.col("run_no") % 6 == i, form).otherwise(path)
    slugs = r.select("run_no", M.variant_slug(path, ["K562"], ["pairs.csv", "matrix.parquet"]).alias("slug"))
    return slugs.select("run_no", "slug", M.strategy_base(F.col("slug")).alias("base"), M.s5_key(F.col("slug")).alias("s5"))


@query("setting_id_infer", RUN + " select run_no, case when s2 in ('S3', 'S4', 'S5') then 'nmc_' || n_metacells::BIGINT end as setting_id from m")
def _(t):
    return runs(t).select("run_no", M.setting_id(F.col("strategy_canonical"), F.lit(None).cast("string"), F.col("n_metacells")).alias("setting_id"))


@query("strategy_from_text", RUN + " select variant_id, strategy_canonical as strategy from m group by all")
def _(t):
    return runs(t).select("variant_id", M.strategy_from_text(F.col("variant_id")).alias("strategy")).distinct()


@query("manifest_standardize", RUN + " select run_no, strategy_canonical, strategy_order, sampling_seed::VARCHAR as seed, strategy || '_' || sampling_seed || '_' || run_no as run_id from m")
def _(t):
    out = M.standardize(t.view("run"), {"seed": ["random_seed", "sampling_seed"]}, ["strategy", "sampling_seed", "run_no"], ["strategy_order", "seed", "run_no"])
    return out.select("run_no", "strategy_canonical", "strategy_order", "seed", "run_id")


@query("manifest_filter", RUN + " select run_no, strategy_canonical from m where s2 in ('S3', 'S5') and sampling_seed in (1, 2) order by run_no limit 500")
def _(t):
    return M.filter_manifest(runs(t), [M.STRATEGY_ORDER[3], M.STRATEGY_ORDER[5]], [1, 2], "sampling_seed", 500, "run_no").select("run_no", "strategy_canonical")


@query("manifest_upsert_latest", RUN + " select variant_id, sampling_seed, max(run_no) as run_no from m group by all")
def _(t):
    r = runs(t).select("variant_id", "sampling_seed", "run_no")
    return M.upsert_latest(r.where("run_no % 2 = 0"), r.where("run_no % 2 = 1"), ["variant_id", "sampling_seed"], "run_no")


@query("pending_runs", RUN + " select variant_id, sampling_seed from m group by all having not bool_or(run_no % 3 = 0 and run_no % 5 <> 0 and sampling_seed > 1)")
def _(t):
    r = runs(t)
    plan = r.select("variant_id", "sampling_seed").distinct()
    done = r.where("run_no % 3 = 0 and sampling_seed > 1").select("variant_id", "sampling_seed", (F.col("run_no") % 5).alias("matrix_bytes"), F.lit(10).alias("pairs_bytes"))
    return M.pending(plan, done, ["variant_id", "sampling_seed"])




@query("select_variant_rows", RUN + " select run_no, variant_id, true as found from m where variant_id like '%nmc_50%' union all select null, 'S9__none', false")
def _(t):
    r = runs(t).select("run_no", "variant_id")
    wanted = r.where("variant_id like '%nmc_50%'").select("variant_id").distinct().unionByName(t.spark.createDataFrame([("S9__none",)], "variant_id string"))
    return M.select_variants(r, wanted)


@query("seed_resolve", RUN + ", q as (select *, row_number() over (partition by variant_id order by run_no) - 1 as nth from m) select run_no, case when run_no % 4 = 0 then sampling_seed when run_no % 4 = 1 then run_no else nth end::INT as seed from q")
def _(t):
    given = F.when(F.col("run_no") % 4 == 0, F.col("sampling_seed"))
    text = F.when(F.col("run_no") % 4 == 1, F.concat(F.lit("x__Seed_"), F.col("run_no").cast("string")))
    return runs(t).select("run_no", M.resolve_seed([given], text, F.col("strategy_canonical"), "variant_id", "run_no").alias("seed"))


@query("variant_index", RUN + ", v as (select distinct variant_id, strategy_order, case when s2 in ('S3', 'S4', 'S5') then n_metacells end as a, case when s2 = 'S3' then k end as b, case when s2 = 'S5' then top_k end as c from m) select variant_id, row_number() over (order by strategy_order, a nulls last, b nulls last, c nulls last, variant_id) as variant_no from v")
def _(t):
    s2 = F.substring("strategy_canonical", 1, 2)
    r = runs(t).withColumns({"n_metacells": F.when(s2.isin("S3", "S4", "S5"), F.col("n_metacells")), "k": F.when(s2 == "S3", F.col("k")), "top_k": F.when(s2 == "S5", F.col("top_k"))})
    return M.variant_index(r).select("variant_id", "variant_no")


@query("attach_run_metadata", RUN + " select a.run_no, b.variant_id, b.sampling_seed from run a join m b using (run_no)")
def _(t):
    return M.attach_metadata(t.view("run").select("run_no"), runs(t), ["variant_id", "sampling_seed"], "run_no")


@query("block_key", RUN + " select s2 || '||' || sampling_seed as block, count(*) as n from m group by all")
def _(t):
    return runs(t).groupBy(M.block_key(F.substring("strategy_canonical", 1, 2), F.col("sampling_seed")).alias("block")).agg(F.count("*").alias("n"))


@query("unique_labels", RUN + ", v as (select distinct variant_id, strategy_canonical from m), n as (select *, row_number() over (partition by strategy_canonical order by variant_id) as n from v) select variant_id, case when n = 1 then strategy_canonical else strategy_canonical || ' [' || n || ']' end as unique_label from n")
def _(t):
    return M.unique_labels(runs(t).select("variant_id", "strategy_canonical").distinct(), "strategy_canonical", "variant_id").select("variant_id", "unique_label")


@query("null_tokens_in_runs", RUN + " select run_no, case when run_no % 2 = 0 then variant_id end as variant_id from m")
def _(t):
    return runs(t).select("run_no", null_token(F.when(F.col("run_no") % 2 == 0, F.col("variant_id")).otherwise(" None ")).alias("variant_id"))
