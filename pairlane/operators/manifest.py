"""Run manifests: canonical names, keys, filters, upserts and pending runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import int_like, null_token, safe_id

#: Canonical strategies in order, and how many variants each is expected to have.
STRATEGY_ORDER = [
    "S0_naive_mean_control_reference",
    "S1_random_single_control",
    "S2_random_average_controls",
    "S3_SEACell_metacell_average",
    "S4_SEACell_balanced_random_sample",
    "S5_SEACell_OT_sampled_average",
]
EXPECTED_VARIANTS = dict(zip(STRATEGY_ORDER, (1, 1, 1, 15, 5, 15), strict=True))
#: Every name that run tables use, and the canonical strategy it means.
STRATEGY_NAMES = {
    "S0_naive_mean_control_reference": "S0_naive_mean_control_reference",
    "S0": "S0_naive_mean_control_reference",
    "S1_random_single_control": "S1_random_single_control",
    "S1": "S1_random_single_control",
    "S4_random_single_control_oracle": "S1_random_single_control",
    "S4_random_single_control": "S1_random_single_control",
    "strategy4_random_single_control": "S1_random_single_control",
    "strategy4_random_single_control_cell": "S1_random_single_control",
    "S2_random_average_controls": "S2_random_average_controls",
    "S2": "S2_random_average_controls",
    "S3_random_average_controls": "S2_random_average_controls",
    "strategy3_random_average_controls": "S2_random_average_controls",
    "strategy3_random_average_control_cells": "S2_random_average_controls",
    "S3_SEACell_metacell_average": "S3_SEACell_metacell_average",
    "S3": "S3_SEACell_metacell_average",
    "S5_random_metacell_average": "S3_SEACell_metacell_average",
    "S3_random_metacell_average": "S3_SEACell_metacell_average",
    "strategy5_random_metacell_average": "S3_SEACell_metacell_average",
    "S4_SEACell_balanced_random_sample": "S4_SEACell_balanced_random_sample",
    "S4": "S4_SEACell_balanced_random_sample",
    "S1_SEACell_balanced_random": "S4_SEACell_balanced_random_sample",
    "S4_SEACell_balanced_random": "S4_SEACell_balanced_random_sample",
    "strategy1_seacell_balanced_random_repeated": "S4_SEACell_balanced_random_sample",
    "S5_SEACell_OT_sampled_average": "S5_SEACell_OT_sampled_average",
    "S5": "S5_SEACell_OT_sampled_average",
    "S2_SEACell_OT_topk_sampled_average": "S5_SEACell_OT_sampled_average",
    "S2_SEACell_OT_topk_sampled_average_repeated": "S5_SEACell_OT_sampled_average",
    "strategy2_seacells_ot_topk_sampled_average": "S5_SEACell_OT_sampled_average",
    "strategy2_seacell_ot_topk_sampled_average_repeated": "S5_SEACell_OT_sampled_average",
}
UNKNOWN_ORDER = 99


def _lookup(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a fixed table


def rename_strategies(df: DataFrame, column: str = "strategy", names: dict[str, str] = STRATEGY_NAMES) -> DataFrame:
    """Canonical name (unknown ones stay) and its order."""
    order = {s: i for i, s in enumerate(STRATEGY_ORDER)}
    table = _lookup(df, [(a, b, order.get(b, UNKNOWN_ORDER)) for a, b in names.items()], "_old string, _new string, _order int")
    out = df.join(table, F.trim(df[column]) == F.col("_old"), "left")
    return out.withColumn("strategy_canonical", F.coalesce("_new", F.trim(column))).withColumn("strategy_order", F.coalesce("_order", F.lit(UNKNOWN_ORDER))).drop("_old", "_new", "_order")


def extract_number(columns: list[str], patterns: list[str]) -> Column:
    """First match of the patterns over the text columns, as a double."""
    found = [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?i){p}", 1), F.lit("")).try_cast("double") for p in patterns for c in columns]
    return F.coalesce(*found)


def extract_params(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_metacells, k and top_k from columns if they are there, else from text."""
    have = lambda c: [null_token(F.col(c).cast("string")).try_cast("double")] if c in df.columns else []
    out = df.withColumn("n_metacells", F.coalesce(*have("n_metacells_requested"), extract_number(columns, [r"nmc_(\d+)", r"n_metacells_(\d+)"])))
    out = out.withColumn("k", F.coalesce(*have("n_controls"), extract_number(columns, [r"(?:^|__)k_(\d+)", r"sampledMC_(\d+)"])))
    return out.withColumn("top_k", F.coalesce(*have("top_k_metacells"), extract_number(columns, [r"topk_(\d+)", r"top_k_(\d+)"])))


def setting_id(strategy: Column, given: Column, n: Column) -> Column:
    """Given id, or ``nmc_<n>`` for the metacell strategies."""
    return F.coalesce(given, F.when(F.substring(strategy, 1, 2).isin("S3", "S4", "S5"), F.concat(F.lit("nmc_"), int_like(n))))


def variant_label(strategy: Column) -> Column:
    """Analysis scheme: ``default``; S3 ``nmc_x__sampledMC_y``; S4 ``nmc_x``; S5 ``nmc_x__topk_y``."""
    s = F.substring(strategy, 1, 2)
    part = lambda name, c: F.concat(F.lit(name), F.coalesce(int_like(F.col(c)), F.lit("NA")))
    return F.when(s == "S3", F.concat_ws("__", part("nmc_", "n_metacells"), part("sampledMC_", "k"))).when(s == "S4", part("nmc_", "n_metacells")).when(s == "S5", F.concat_ws("__", part("nmc_", "n_metacells"), part("topk_", "top_k"))).otherwise("default")


def variant_id(strategy: Column) -> Column:
    return F.concat_ws("__", strategy, variant_label(strategy))


def variant_id_program(strategy: Column) -> Column:
    """Program scheme: S2 adds k; S3 metacells and k; S4 metacells; S5 metacells, top-k and samples per metacell."""
    s = F.substring(strategy, 1, 2)
    part = lambda name, c: F.concat(F.lit(name), F.coalesce(int_like(F.col(c)), F.lit("NA")))
    tail = (
        F.when(s == "S2", part("k_", "k")).when(s == "S3", F.concat_ws("__", part("nmc_", "n_metacells"), part("k_", "k"))).when(s == "S4", part("nmc_", "n_metacells")).when(s == "S5", F.concat_ws("__", part("nmc_", "n_metacells"), part("topk_", "top_k"), part("spm_", "k")))
    )
    return F.concat_ws("__", strategy, tail)


def match_key(strategy: Column) -> Column:
    """Key under which both schemes name a variant alike."""
    s = F.substring(strategy, 1, 2)
    num = lambda c: F.coalesce(int_like(F.col(c)), F.lit(""))
    mc = F.when(s.isin("S3", "S4", "S5"), num("n_metacells")).otherwise("")
    return F.concat_ws("|", s, mc, F.when(s == "S3", num("k")).when(s == "S5", num("top_k")).otherwise(""))


def variant_slug(text: Column, groups: list[str], files: list[str]) -> Column:
    """The variant of a path or name as ``a__b__c``; empty for NULL.

    A strategy's own name or path stays whole. Of a path to one of ``files`` counts what lies below
    the folder of one of the ``groups``, else the last folder; of an embedding path the folder
    after ``/embeddings/``.
    """
    path = F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("\\"), F.lit("/"))
    own = F.regexp_like(path, F.lit("^(" + "|".join(STRATEGY_ORDER) + ")(__|/|$)"))
    ending = "/(" + "|".join(re.escape(f) for f in files) + ")$"
    parent = F.regexp_replace(path, ending, "")
    marker = "^.*?/(" + "|".join(re.escape(g) for g in groups) + ")/"
    below = F.when(F.regexp_like(parent, F.lit(marker)), F.regexp_replace(parent, marker, "")).otherwise(F.element_at(F.split(parent, "/"), -1))
    embedded = F.regexp_extract(path, "/embeddings/([^/]*)", 1)
    part = F.when(own, path).when(F.regexp_like(path, F.lit(ending)), below).when(F.contains(path, F.lit("/embeddings/")), embedded).otherwise(path)
    return F.regexp_replace(F.regexp_replace(part, "^/+|/+$", ""), "/+", "__")


def strategy_base(slug: Column) -> Column:
    """The strategy that a slug begins with, else the slug before its seed."""
    found = F.regexp_extract(slug, "^(" + "|".join(STRATEGY_ORDER) + ")(?:__|$)", 1)
    return F.when(found != "", found).otherwise(F.element_at(F.split(slug, "__seed_"), 1))


def s5_key(slug: Column) -> Column:
    """``<metacells>&<top k>`` of an S5 slug that has both, else empty."""
    n, k = F.regexp_extract(slug, "(?:^|__)nmc_([^_]+)", 1), F.regexp_extract(slug, "(?:^|__)topk_0*([^_]+)", 1)
    return F.when(F.startswith(slug, F.lit(STRATEGY_ORDER[5])) & (n != "") & (k != ""), F.concat(n, F.lit("&"), k)).otherwise("")


def standardize(manifest: DataFrame, aliases: dict[str, list[str]], run_parts: list[str], order: list[str]) -> DataFrame:
    """Each target column from its first alias that is there and not missing; run_id from parts if absent; sorted by ``order``."""
    out = manifest
    for target, names in aliases.items():
        there = [null_token(F.col(n).cast("string")) for n in [target, *names] if n in manifest.columns]
        out = out.withColumn(target, F.coalesce(*there) if there else F.lit(None).cast("string"))
    out = rename_strategies(out)
    made = safe_id(F.concat_ws("__", *[F.col(p).cast("string") for p in run_parts]))
    out = out.withColumn("run_id", F.coalesce(null_token(F.col("run_id").cast("string")), made) if "run_id" in out.columns else made)
    return out.orderBy(*[F.col(c).asc_nulls_first() for c in order])


def filter_manifest(manifest: DataFrame, strategies: list[str] | None = None, groups: list[str] | None = None, group: str = "perturbed_group", first: int | None = None, order: str = "run_id") -> DataFrame:
    out = manifest
    if strategies is not None:
        out = out.where(F.col("strategy_canonical").isin(strategies))
    if groups is not None:
        out = out.where(F.col(group).isin(groups))
    return out.orderBy(order).limit(first) if first is not None else out


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows of both, of each key the one with the highest version; of equal versions a new row, then the one whose values come last as JSON."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    values = F.to_json(F.struct(*[c for c in both.columns if c != "_new"]))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"), values.desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def pending(plan: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Planned runs without complete outputs (both files there, not empty)."""
    return plan if overwrite else plan.join(done.where("matrix_bytes > 0 and pairs_bytes > 0").select(*keys), keys, "left_anti")


def select_variants(rows: DataFrame, wanted: DataFrame, key: str = "variant_id", strict: bool = False) -> DataFrame:
    """Rows of the wanted variants with ``found``; a wanted variant without rows has one row of NULLs, or raises an error if ``strict``."""
    out = wanted.select(key).distinct().join(rows.withColumn("_there", F.lit(True)), key, "left").withColumn("found", F.col("_there").isNotNull()).drop("_there")
    if strict:
        out = out.withColumn("found", F.when(F.col("found"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("no rows of "), F.col(key))).cast("boolean")))
    return out


def seed_rows(seeds: DataFrame, selection: DataFrame, key: str = "match_key", variant: str = "variant_id") -> DataFrame:
    """Seed rows of each selected variant by match key, with both ids; a selection without rows stays with NULLs (``matched`` false)."""
    own = seeds.withColumnRenamed(variant, "metric_variant_id").withColumn("_there", F.lit(True))
    joined = selection.select(key, F.col(variant).alias("selected_variant_id")).join(own, key, "left")
    return joined.withColumn("matched", F.col("_there").isNotNull()).drop("_there")


def resolve_seed(candidates: list[Column], text: Column, strategy: Column, variant: str, order: str) -> Column:
    """First usable seed; else a number in the text; -1 for S0; else a running number within the variant."""
    nth = F.row_number().over(Window.partitionBy(variant).orderBy(order)) - 1
    parsed = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)seed[_=]?(\d+)", 1), F.lit("")).try_cast("double")
    return F.coalesce(*[null_token(c.cast("string")).try_cast("double") for c in candidates], parsed, F.when(F.substring(strategy, 1, 2) == "S0", -1.0), nth.cast("double")).cast("int")


def variant_index(manifest: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """One row per variant in order; only selected ones (and S0) if a selection is given."""
    base = manifest.select("variant_id", "strategy_canonical", "strategy_order", "n_metacells", "k", "top_k").distinct()
    if selected is not None:
        base = base.join(selected.select("variant_id", F.lit(True).alias("_s")).distinct(), "variant_id", "left").where(F.col("_s") | F.col("strategy_canonical").startswith("S0")).drop("_s")
    order = Window.orderBy("strategy_order", F.col("n_metacells").asc_nulls_last(), F.col("k").asc_nulls_last(), F.col("top_k").asc_nulls_last(), "variant_id")
    return base.withColumn("variant_no", F.row_number().over(order))


def strategy_from_text(text: Column) -> Column:
    """Canonical strategy whose short name starts the text or stands in it; the first by order."""
    out = F.lit(None).cast("string")
    for s in reversed(STRATEGY_ORDER):
        out = F.when(F.startswith(text, F.lit(s[:2])) | F.contains(F.lower(text), F.lit(s[3:].lower())), F.lit(s)).otherwise(out)
    return out


def attach_metadata(rows: DataFrame, manifest: DataFrame, columns: list[str], key: str = "run_id") -> DataFrame:
    """Manifest columns on every result row."""
    return rows.join(manifest.select(key, *columns), key, "left")


def block_key(*parts: Column) -> Column:
    return F.concat_ws("||", *[p.cast("string") for p in parts])


def unique_labels(df: DataFrame, label: str, order: str) -> DataFrame:
    """Repeats of a label get `` [2]``, `` [3]``."""
    nth = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("unique_label", F.when(nth == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" ["), nth.cast("string"), F.lit("]"))))
