"""Sources, sinks and preparation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.exprs import as_bool, draw, draw_sql, int_like, null_token, numbered, safe_id
from pairlane.functions.storage import new_folder
from pairlane.operators import prepare as P
from pairlane.plans.registry import query
from pairlane.sources import tables as S
from pairlane.sources.fixtures import cte


@query("read_table_any", "select c_custkey, c_name, c_nationkey from customer")
def _(t):
    path = S.write_table(t.read("customer").select("c_custkey", "c_name", "c_nationkey"), new_folder(t.spark, "customer") + ".csv")
    return S.read_table(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int")


@query("write_table_parquet_csv", "select kind, o_orderstatus, count(*) as n from orders, (values ('csv'), ('parquet')) as v(kind) group by all")
def _(t):
    slim = t.read("orders").select("o_orderkey", "o_orderstatus")
    out = [S.read_table(t.spark, S.write_table(slim, new_folder(t.spark, "orders") + f".{kind}"), "o_orderkey bigint, o_orderstatus string").withColumn("kind", F.lit(kind)) for kind in ("csv", "parquet")]
    return out[0].unionByName(out[1]).groupBy("kind", "o_orderstatus").agg(F.count("*").alias("n"))


@query("read_matrix_long", cte("expr") + " select cell_id, gene, round(value, 6) + 0.0 as value from expr where value <> 0")
def _(t):
    return S.read_layer(t.expr()).select("cell_id", "gene", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("read_metadata_only", cte("obs") + " select batch, target, count(*) as n from obs group by all")
def _(t):
    return t.view("obs").groupBy("batch", "target").agg(F.count("*").alias("n"))


@query("file_checksum_audit")
def _(t):
    found = S.file_checksums(t.spark, t.sf_dir, "*.parquet")
    expected = found.select("name", F.when(F.col("name") < "n", F.col("sha256")).otherwise(F.sha2("name", 256)).alias("sha256"))
    return S.audit_files(found, expected)


@query("variant_file_index", cte("run") + " select strategy, sampling_seed, count(distinct sampling_seed) as n_files, true as filled from run group by all")
def _(t):
    runs = t.view("run").select("run_no", "strategy", "sampling_seed").withColumn("kept_seed", F.col("sampling_seed"))
    path = S.write_table(runs.repartition("strategy", "sampling_seed"), new_folder(t.spark, "variants"), ["strategy", "sampling_seed"])
    return S.index_files(t.spark, path, "*.parquet", ["strategy", "sampling_seed"]).groupBy("strategy", F.col("sampling_seed").cast("int").alias("sampling_seed")).agg(F.count("*").alias("n_files"), (F.min("length") > 0).alias("filled"))


@query("write_pair_result", cte("run") + " select strategy, sampling_seed, count(*) as n, sum(run_no)::BIGINT as checksum from run group by all")
def _(t):
    runs = t.view("run").select("run_no", "strategy", "sampling_seed")
    path = S.write_table(runs.repartition("strategy", "sampling_seed"), new_folder(t.spark, "pairs"), ["strategy", "sampling_seed"])
    back = t.spark.read.schema("run_no bigint, strategy string, sampling_seed int").parquet(path)
    return back.groupBy("strategy", "sampling_seed").agg(F.count("*").alias("n"), F.sum("run_no").alias("checksum"))


@query("assemble_shards", cte("cell") + " select perturbation, count(*) as n, count(*) filter (cell_id % 4 <> 3) as covered from cell group by all")
def _(t):
    cells = t.cell().select("cell_id", "perturbation")
    shards = [cells.where(F.col("cell_id") % 4 == i).select("cell_id", F.lit(i).alias("shard")) for i in range(3)]
    return S.assemble_shards(shards, cells).groupBy("perturbation").agg(F.count("*").alias("n"), F.count_if("covered").alias("covered"))


@query("assemble_embedding_chunks", cte("cell") + " select row_number() over (order by cell_id) - 1 as prepared_order, cell_id, len(vec)::INT as dim, round(vec[1]::DOUBLE, 6) + 0.0 as first from cell")
def _(t):
    cells = numbered(t.cell().select("cell_id", "vec"), ["cell_id"], "prepared_order")
    whole = S.assemble_chunks(cells)
    return whole.select("prepared_order", "cell_id", F.size("vec").alias("dim"), (F.round(F.get("vec", F.lit(0)).cast("double"), 6) + F.lit(0.0)).alias("first"))


@query("attach_embedding", cte("cell") + " select cell_id, perturbation, round(vec[2]::DOUBLE, 6) + 0.0 as second from cell")
def _(t):
    out = S.attach_embedding(t.cell().select("cell_id", "perturbation"), t.cell().select("cell_id", "vec"))
    return out.select("cell_id", "perturbation", (F.round(F.get("embedding", F.lit(1)).cast("double"), 6) + F.lit(0.0)).alias("second"))


@query("make_names_unique", "select p_partkey, case when n = 1 then p_name else p_name || '-' || (n - 1) end as unique_name from (select *, row_number() over (partition by p_name order by p_partkey) as n from part)")
def _(t):
    return P.unique_names(t.read("part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("annotate_multiplicity", cte("obs") + " select cell_id, case nperts when 0 then 'control' when 1 then 'single' when 2 then 'dual' else 'multi' end as multiplicity, case when nperts = 0 then 'control' else 'perturbation' end as condition from obs")
def _(t):
    return P.annotate_multiplicity(t.view("obs")).select("cell_id", "multiplicity", "condition")


@query("map_group_labels", cte("obs") + " select cell_id, case target when '1-URGENT' then 'fast' when '5-LOW' then 'slow' else target end as analysis_group from obs")
def _(t):
    return P.map_labels(t.view("obs"), "target", {"1-URGENT": "fast", "5-LOW": "slow"}).select("cell_id", "analysis_group")


@query("standardize_perturbation_key", cte("obs") + " select cell_id, case when nperts = 0 then 'control' else target end as perturbation_key from obs")
def _(t):
    obs = P.annotate_multiplicity(t.view("obs"))
    return P.standardize_key(obs, "target", "multiplicity").select("cell_id", "perturbation_key")


@query("resolve_perturbation_key", cte("obs") + f", o as (select cell_id, nperts, target as target_gene, batch from obs), k as (select json_keys(to_json(o)) as names from o limit 1), f as (select list_filter({P.PERTURBATION_KEYS}, lambda x: list_contains(names, x))[1] as resolved from k) select resolved, to_json(o)->>resolved as label, count(*) as n from o, f group by all")
def _(t):
    obs = t.view("obs").withColumnRenamed("target", "target_gene")
    name = P.resolve_key(obs)
    return obs.groupBy(F.lit(name).alias("resolved"), F.col(name).alias("label")).agg(F.count("*").alias("n"))


@query("split_groups_min_cells", cte("cell") + " select perturbation, count(*) as n_cells, case when count(*) < 50 then 'skipped_too_few_cells' else 'written' end as status from cell group by all")
def _(t):
    return P.split_groups(t.cell(), "perturbation", 50)


@query("cap_pairs_per_group", cte("cell") + f" select cell_id, perturbation from cell qualify row_number() over (partition by perturbation order by {draw_sql('5', 'cell_id')}, cell_id) <= 20")
def _(t):
    return P.cap_per_group(t.cell().select("cell_id", "perturbation"), "perturbation", "cell_id", 20, 5)


@query("align_genes", cte("counts", "var") + " select gene, gene_pos from var where gene in (select gene from counts where value > 100)")
def _(t):
    return P.align_genes(t.view("var"), t.view("counts").where("value > 100")).select("gene", "gene_pos")


@query("select_eval_genes", cte("counts", "var") + " select gene, gene_pos from var where gene in (select gene from counts) order by (gene_pos % 3 <> 0)::INT, case when gene_pos % 3 = 0 then -gene_pos end, gene_pos limit 12")
def _(t):
    var = t.view("var").withColumn("highly_variable", F.col("gene_pos") % 3 == 0).withColumn("hv_rank", -F.col("gene_pos"))
    return P.select_eval_genes(var, t.view("counts"), 12).select("gene", "gene_pos")


@query("clean_gene_ids", cte("var") + r" select gene, regexp_replace(trim(ensembl_id), '\.\d+$', '') as gene_id from var")
def _(t):
    return t.view("var").select("gene", P.clean_gene_ids(F.col("ensembl_id")).alias("gene_id"))


_DETECT = cte("var") + r""", c AS (select unnest([{'ord': 0, 'column': 'gene', 'id': gene}, {'ord': 1, 'column': 'ensembl_id', 'id': regexp_replace(trim(ensembl_id), '\.\d+$', '')}]) as x from var)
select x.ord as ord, x.column as "column", count(*) filter (ok) as hits, count(distinct x.id) filter (ok) as distinct_hits
from (select x, x.id in (select regexp_replace(trim(ensembl_id), '\.\d+$', '') from var where gene_pos < 20) as ok from c) group by all"""


@query("detect_gene_column", _DETECT)
def _(t):
    var = t.view("var")
    vocab = var.where("gene_pos < 20").select(P.clean_gene_ids(F.col("ensembl_id")).alias("gene"))
    return P.detect_gene_column(var, ["gene", "ensembl_id"], vocab)


@query("filter_vocab_cells", cte("counts", "var") + ", v as (select gene from var where gene_pos < 10), b as (select cell_id, count(*) as genes_before from counts group by all), a as (select cell_id, count(*) as genes_after, sum(value) as total from counts where gene in (select gene from v) group by all) select cell_id, genes_before, genes_after, total, row_number() over (order by cell_id) - 1 as prepared_order from b join a using (cell_id) where total > 0")
def _(t):
    return numbered(P.filter_vocabulary(t.view("counts"), t.view("var").where("gene_pos < 10")), ["cell_id"], "prepared_order")


@query("project_to_gene_order", cte("counts", "var") + ", v as (select gene, gene_pos % 7 as model_pos from var where gene_pos < 21), c as (select distinct cell_id from counts), w as (select c.cell_id, v.gene, v.model_pos from c, v) select w.cell_id, w.model_pos, coalesce(sum(k.value), 0)::DOUBLE as value from w left join counts k on k.cell_id = w.cell_id and k.gene = w.gene group by w.cell_id, w.model_pos")
def _(t):
    model = t.view("var").where("gene_pos < 21").select("gene", (F.col("gene_pos") % 7).alias("model_pos"))
    return P.project_to_order(t.view("counts"), model)


@query("pick_batch_key", cte("obs") + """ select 'batch' as "column", count(distinct coalesce(batch, '∅')) as levels, count(distinct coalesce(batch, '∅')) >= 2 as usable from obs union all select 'target', count(distinct target), count(distinct target) >= 2 from obs""")
def _(t):
    return P.pick_batch_key(t.view("obs"), ["batch", "missing_column", "target"])


@query("align_labels_to_embedding", cte("cell") + " select cell_id, perturbation as aligned, 'id' as mode from cell where cell_id % 5 <> 0")
def _(t):
    cells = numbered(t.cell().select("cell_id", "perturbation"), ["cell_id"], "pos")
    labels = cells.where(F.col("cell_id") % 5 != 0).select("cell_id", "pos", F.col("perturbation").alias("label"))
    return P.align_labels(cells.select("cell_id", "pos"), labels).select("cell_id", "aligned", "mode")


@query("align_embedding_rows", cte("cell") + " select cell_id, round(vec[1]::DOUBLE, 6) + 0.0 as first from cell where cell_id % 3 = 0")
def _(t):
    out = P.align_rows(t.cell().select("cell_id", "vec"), t.cell().where(F.col("cell_id") % 3 == 0).select("cell_id"))
    return out.select("cell_id", (F.round(F.get("vec", F.lit(0)).cast("double"), 6) + F.lit(0.0)).alias("first"))


@query("subsample_rows", cte("cell") + f" select cell_id, perturbation from cell order by {draw_sql('3', 'cell_id')}, cell_id limit 100")
def _(t):
    return P.subsample(t.cell().select("cell_id", "perturbation"), "cell_id", 100, 3)


@query("membership_validate", cte("membership", "cell") + ", c as (select cell_id, row_number() over (order by cell_id) - 1 as cell_pos from membership) select m.cell_id, m.metacell_id, c.cell_pos, 'id' as mode, false as absent from membership m join c using (cell_id)")
def _(t):
    member = t.view("membership")
    controls = numbered(member.select("cell_id"), ["cell_id"], "cell_pos")
    return P.validate_membership(member.withColumn("cell_pos", F.col("cell_id")), controls)


@query("usage_list_explode", cte("run") + " select used_id, count(*) as n from (select unnest(string_split(replace(parameter_label, '__', '|') || '|' || strategy, '|')) as used_id from run) where used_id <> '' group by all")
def _(t):
    listed = t.view("run").select(F.regexp_replace("parameter_label", "__", ";").alias("a"), F.concat(F.lit(","), "strategy").alias("b"))
    return P.explode_usage(listed, ["a", "b"]).groupBy("used_id").agg(F.count("*").alias("n"))


@query("array_to_text", cte("cell", "membership") + " select metacell_id, string_agg(cell_id::VARCHAR, '|' order by cell_id) as ids, string_agg(printf('%.6g', vec[1]::DOUBLE * pow(10.0, cell_id % 13 - 6)), '|' order by cell_id) as weights from membership join cell using (cell_id) group by all")
def _(t):
    both = t.view("membership").join(t.cell().select("cell_id", (F.get("vec", F.lit(0)).cast("double") * F.pow(F.lit(10.0), F.col("cell_id") % 13 - 6)).alias("w")), "cell_id")
    rows = both.groupBy("metacell_id").agg(F.array_sort(F.collect_list(F.struct("cell_id", "w"))).alias("r"))
    return rows.select("metacell_id", P.array_text(F.transform("r", lambda x: x["cell_id"])).alias("ids"), P.array_text(F.transform("r", lambda x: x["w"]), fractions=True).alias("weights"))


@query("parse_bool_text", "select o_orderkey, o_orderstatus = 'O' or o_orderkey % 3 = 0 as flag from orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, " YES ").when(F.col("o_orderstatus") == "O", "True").otherwise("no")
    return t.read("orders").select("o_orderkey", as_bool(text).alias("flag"))


@query("null_token_normalize", "select o_orderkey, case when o_orderkey % 4 in (0, 1) then null else o_orderkey::DOUBLE end as value from orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, " NaN ").when(F.col("o_orderkey") % 4 == 1, "").otherwise(F.col("o_orderkey").cast("string"))
    return t.read("orders").select("o_orderkey", null_token(text).try_cast("double").alias("value"))


@query("safe_id", "select p_partkey, substr(regexp_replace(regexp_replace(regexp_replace(concat('(', p_name, ') #', p_brand, '/x'), '[^A-Za-z0-9_.=+-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 180) as id from part")
def _(t):
    return t.read("part").select("p_partkey", safe_id(F.concat(F.lit("("), "p_name", F.lit(") #"), "p_brand", F.lit("/x"))).alias("id"))


@query("membership_from_labels", cte("cell") + ", f as (select perturbation, row_number() over (order by min(cell_id)) - 1 as metacell_index from cell group by all) select cell_id, perturbation as metacell_id, metacell_index from cell join f using (perturbation)")
def _(t):
    return P.membership_from_labels(t.cell(), "perturbation", "cell_id")


@query("membership_size_stats", cte("membership") + " select 1 as setting, count(*) as n_metacells, min(n) as min_size, median(n)::DOUBLE as median_size, max(n) as max_size from (select metacell_id, count(*) as n from membership group by all)")
def _(t):
    return P.membership_sizes(t.view("membership").withColumn("setting", F.lit(1)), ["setting"])


@query("cell_total_counts", cte("counts") + " select cell_id, sum(value) as n_counts from counts group by all")
def _(t):
    return t.view("counts").groupBy("cell_id").agg(F.sum("value").alias("n_counts"))


@query("chunk_plan", cte("counts") + ', r as (select cell_id, row_number() over (order by cell_id) - 1 as pos, count(*) as n_genes from counts group by cell_id) select pos // 100 as chunk_id, min(pos) as start, max(pos) + 1 as "end", count(*) as n, round(avg(n_genes), 6) + 0.0 as mean_length, max(n_genes) as max_length from r group by all')
def _(t):
    rows = numbered(t.view("counts").groupBy("cell_id").agg(F.count("*").alias("n_genes")), ["cell_id"], "pos")
    return P.chunk_plan(rows, "pos", "n_genes", 100).withColumn("mean_length", F.round("mean_length", 6) + F.lit(0.0))


_TOKENS = cte("counts", "var") + ", s as (select cell_id, gene_pos, value, row_number() over (partition by cell_id order by value desc, gene_pos) as n from counts join var using (gene) where value > 0), k as (select cell_id, list(gene_pos + 1 order by n) as tokens from s where n <= 2048 group by all)"


@query("pad_tokens", _TOKENS + ", m as (select cell_id % 50 as batch, max(len(tokens)) as longest from k group by all) select cell_id, array_to_string(list_concat(tokens, list_transform(range(longest - len(tokens)), lambda x: 0)), ' ') as tokens, longest - len(tokens) as padded from k join m on m.batch = k.cell_id % 50")
def _(t):
    from pairlane.operators.normalise import rank_tokens

    ranked = rank_tokens(t.view("counts").join(t.view("var").select("gene", "gene_pos", (F.col("gene_pos") + 1).alias("token_id")), "gene"), 2048)
    out = P.pad_tokens(ranked.withColumn("batch", F.col("cell_id") % 50), "batch")
    return out.select("cell_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"), F.size(F.filter("mask", lambda x: x == 0)).cast("long").alias("padded"))


@query("detect_label_column", cte("cell") + ", c as (select cell_id, perturbation as leiden_res1, label as cluster_id from cell), k as (select unnest(json_keys(to_json(c))) as name from c limit 3), f as (select name as found from k where lower(name) similar to '.*(leiden|cluster).*' order by name <> 'leiden', lower(name) not like '%leiden%', name limit 1) select found, to_json(c)->>found as label, count(*) as n from c, f group by all")
def _(t):
    cells = t.cell().select("cell_id", F.col("perturbation").alias("leiden_res1"), F.col("label").alias("cluster_id"))
    name = P.detect_label_column(cells.columns)
    return cells.groupBy(F.lit(name).alias("found"), F.col(name).alias("label")).agg(F.count("*").alias("n"))


@query("int_like_format", cte("run") + ", x as (select run_no, n_metacells_requested as a, input_only_mse_xt * pow(10.0, run_no % 15 - 7) as b from run) select run_no, a::BIGINT::VARCHAR as text, case when abs(b - round(b)) < 1e-8 then round(b)::BIGINT::VARCHAR else printf('%g', b) end as number from x")
def _(t):
    return t.view("run").select("run_no", int_like(F.col("n_metacells_requested")).alias("text"), int_like(F.col("input_only_mse_xt") * F.pow(F.lit(10.0), F.col("run_no") % 15 - 7)).alias("number"))


@query("seeded_draw", cte("cell") + f" select cell_id, {draw_sql('11', 'cell_id')} % 97 as slot from cell")
def _(t):
    return t.cell().select("cell_id", (draw(11, F.col("cell_id")) % 97).alias("slot"))
