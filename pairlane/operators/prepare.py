"""Row and column preparation: keys, groups, genes, subsets, text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import draw, general, null_token, place

#: Names under which a perturbation column is looked for, in order.
PERTURBATION_KEYS = ["perturbation_key", "perturbation_label", "condition", "gene", "target_gene", "guide_identity", "perturbation", "gene_symbol"]


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeats of a name get -1, -2, ... in order; a name made so that exists already gets the next number."""
    nth = df.withColumn("_n", place([name], order) - 1)
    made = nth.withColumn("_name", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat_ws("-", name, "_n")))
    # a made name can only clash with a name that stands there as it is: count the clashes before it
    taken = df.select(F.col(name).alias("_taken")).distinct().withColumn("_base", F.regexp_extract("_taken", r"^(.*)-(\d+)$", 1)).withColumn("_k", F.try_to_number(F.regexp_extract("_taken", r"^(.*)-(\d+)$", 2), F.lit("999999999")).cast("long")).where("_k > 0")
    taken = taken.groupBy("_base").agg(F.array_sort(F.collect_set("_k")).alias("_used"))
    out = made.join(taken, made[name] == taken["_base"], "left")
    shift = F.aggregate(F.coalesce("_used", F.array().cast("array<bigint>")), F.col("_n").cast("long"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    return out.withColumn("unique_name", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat_ws("-", name, shift))).drop("_n", "_name", "_base", "_used")


def annotate_multiplicity(obs: DataFrame, count: str = "nperts") -> DataFrame:
    """``multiplicity`` (control, single, dual, multi) and ``condition``; a count that is no number raises an error."""
    n = F.col(count).cast("double")
    checked = F.when(n.isNull(), F.raise_error(F.lit("multiplicity is not numeric"))).otherwise(n)
    kind = F.when(checked == 0, "control").when(n == 1, "single").when(n == 2, "dual").otherwise("multi")
    return obs.withColumn("multiplicity", kind).withColumn("condition", F.when(n == 0, "control").otherwise("perturbation"))


def map_labels(obs: DataFrame, source: str, mapping: dict[str, str], to: str = "analysis_group") -> DataFrame:
    """Mapped label, or the label itself."""
    label = F.col(source)
    out = label
    for a, b in mapping.items():
        out = F.when(label == a, F.lit(b)).otherwise(out)
    return obs.withColumn(to, out)


def standardize_key(obs: DataFrame, source: str, group: str, control_group: str = "control", control_label: str = "control") -> DataFrame:
    return obs.withColumn("perturbation_key", F.when(F.col(group) == control_group, F.lit(control_label)).otherwise(F.col(source).cast("string")))


def resolve_key(df: DataFrame, requested: str | None = None, candidates: list[str] = PERTURBATION_KEYS) -> str:
    """The requested column, or the first candidate that the table has."""
    if requested is not None:
        if requested not in df.columns:
            raise ValueError(f"no column {requested}")
        return requested
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError("no perturbation column")


def split_groups(obs: DataFrame, group: str, least: int) -> DataFrame:
    """One row per group: cells, and whether it is written or skipped as too small."""
    status = F.when(F.col("n_cells") < least, "skipped_too_few_cells").otherwise("written")
    return obs.groupBy(group).agg(F.count("*").alias("n_cells")).withColumn("status", status)


def cap_per_group(obs: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each group, drawn without replacement."""
    return obs.withColumn("_h", draw(seed, F.col(key))).withColumn("_n", place([group], "_h", key)).where(F.col("_n") <= most).drop("_h", "_n")


def align_genes(left: DataFrame, right: DataFrame, gene: str = "gene", require_all: bool = False) -> DataFrame:
    """Left's genes that right has, in left's order."""
    shared = left.join(right.select(gene).distinct(), gene, "left_semi")
    if require_all and left.join(right.select(gene), gene, "left_anti").limit(1).count():
        raise ValueError("genes are missing")
    return shared


def select_eval_genes(var: DataFrame, shared: DataFrame, most: int, rank: str = "hv_rank", flag: str = "highly_variable") -> DataFrame:
    """Shared genes: highly variable ones by rank first, then by position; the first ``most``."""
    own = var.join(shared.select("gene").distinct(), "gene", "left_semi")
    return own.orderBy(F.when(F.col(flag), 0).otherwise(1), F.when(F.col(flag), F.col(rank)).asc_nulls_last(), "gene_pos").limit(most)


def clean_gene_ids(x):
    """Trimmed, without a version suffix."""
    return F.regexp_replace(F.trim(x), r"\.\d+$", "")


def detect_gene_column(var: DataFrame, candidates: list[str], vocabulary: DataFrame, gene: str = "gene") -> DataFrame:
    """Candidate columns by how many of their cleaned ids the vocabulary has; the first row is the choice."""
    stacked = var.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), clean_gene_ids(F.col(c).cast("string")).alias("id")) for i, c in enumerate(candidates)])).alias("x")).select("x.*")
    vocab = vocabulary.select(F.col(gene).alias("id"), F.lit(1).alias("hit")).distinct()
    scored = stacked.join(vocab, "id", "left").groupBy("ord", "column").agg(F.count("hit").alias("hits"), F.count_distinct(F.when(F.col("hit") == 1, F.col("id"))).alias("distinct_hits"))
    return scored.orderBy(F.desc("hits"), "ord")


def filter_vocabulary(expr: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Cells that keep a positive total over vocabulary genes, with genes before and after and a new order."""
    before = expr.groupBy("cell_id").agg(F.count("*").alias("genes_before"))
    after = expr.join(vocabulary.select("gene").distinct(), "gene", "left_semi").groupBy("cell_id").agg(F.count("*").alias("genes_after"), F.sum("value").alias("total"))
    return before.join(after.where("total > 0"), "cell_id")


def project_to_order(expr: DataFrame, model_genes: DataFrame) -> DataFrame:
    """Values of every cell on all of the model's genes: duplicates added up, missing ones 0.

    The model's gene list is fixed and bounded; each cell takes it in as an array, so nothing is shuffled twice.
    """
    hit = expr.join(model_genes.select("gene", "model_pos"), "gene", "left").groupBy("cell_id", "model_pos").agg(F.sum("value").alias("value"))
    cells = hit.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("model_pos").isNotNull(), F.struct("model_pos", "value")))).alias("_have"))
    order = model_genes.agg(F.array_sort(F.collect_set("model_pos")).alias("_all"))
    full = cells.crossJoin(F.broadcast(order)).select("cell_id", "_have", F.explode("_all").alias("model_pos"))  # one row
    return full.select("cell_id", "model_pos", F.coalesce(F.try_element_at("_have", F.col("model_pos")), F.lit(0.0)).alias("value"))


def pick_batch_key(obs: DataFrame, candidates: list[str]) -> DataFrame:
    """Levels of each candidate (NULL is a level) and whether it can serve as a batch key."""
    there = [c for c in candidates if c in obs.columns]
    counted = obs.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("∅"))).alias(c) for c in there])
    return counted.unpivot([], there, "column", "levels").withColumn("usable", F.col("levels") >= 2)


def align_labels(embedding: DataFrame, labels: DataFrame, key: str = "cell_id", pos: str = "pos", label: str = "label") -> DataFrame:
    """Labels by id if more than half of the ids are known (others drop out), else by position."""
    by_id = embedding.join(labels.select(key, F.col(label).alias("by_id")), key, "left")
    rate = by_id.agg((F.avg(F.when(F.col("by_id").isNotNull(), 1.0).otherwise(0.0)) > 0.5).alias("use_id"))
    both = by_id.join(labels.select(F.col(pos).alias(pos), F.col(label).alias("by_pos")), pos, "left").crossJoin(F.broadcast(rate))  # one row
    chosen = F.when(F.col("use_id"), F.col("by_id")).otherwise(F.col("by_pos"))
    return both.withColumn("aligned", chosen).where("aligned is not null").withColumn("mode", F.when(F.col("use_id"), "id").otherwise("position")).drop("by_id", "by_pos", "use_id")


def align_rows(embedding: DataFrame, targets: DataFrame, key: str = "cell_id") -> DataFrame:
    """Embedding rows of the targets; a missing one raises an error."""
    joined = targets.join(embedding.withColumn("_there", F.lit(True)), key, "left")
    return joined.where(F.when(F.col("_there").isNull(), F.raise_error(F.lit("embedding rows are missing")).isNull()).otherwise(F.lit(True))).drop("_there")


def subsample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement."""
    return df.withColumn("_h", draw(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def validate_membership(membership: DataFrame, controls: DataFrame, agree: float = 0.99) -> DataFrame:
    """Membership on the controls' positions: taken as given if at least ``agree`` of the ids stand there, else by id."""
    at = membership.join(controls.select(F.col("cell_pos"), F.col("cell_id").alias("at_pos")), "cell_pos", "left")
    by = at.join(controls.select("cell_id", F.col("cell_pos").alias("by_id")), "cell_id", "left")
    rate = by.agg((F.avg(F.when(F.col("at_pos") == F.col("cell_id"), 1.0).otherwise(0.0)) >= agree).alias("_good"))
    both = by.crossJoin(F.broadcast(rate))  # one row
    pos = F.when(F.col("_good"), F.col("cell_pos")).otherwise(F.col("by_id"))
    return both.select("cell_id", "metacell_id", pos.alias("cell_pos"), F.when(F.col("_good"), "position").otherwise("id").alias("mode"), F.col("by_id").isNull().alias("absent"))


def explode_usage(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per id listed in the columns, split at ``|``, ``,`` and ``;``."""
    parts = F.flatten(F.array(*[F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "[;,]", "|"), r"\|") for c in columns]))
    return df.select("*", F.explode(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")).alias("used_id"))


def array_text(x, fractions: bool = False):
    """Numbers joined by ``|``; ``fractions``: with six significant digits."""
    return F.array_join(F.transform(x, lambda v: general(v) if fractions else v.cast("string")), "|")


def membership_from_labels(obs: DataFrame, label: str, order: str) -> DataFrame:
    """(cell_id, metacell_id, metacell_index): labels in first-seen order."""
    first = obs.groupBy(label).agg(F.min(order).alias("_first"))
    indexed = first.withColumn("metacell_index", F.row_number().over(Window.orderBy("_first")) - 1).drop("_first")
    return obs.join(indexed, label).select("cell_id", F.col(label).alias("metacell_id"), "metacell_index")


def membership_sizes(membership: DataFrame, by: list[str]) -> DataFrame:
    sizes = membership.groupBy(*by, "metacell_id").count()
    return sizes.groupBy(*by).agg(F.count("*").alias("n_metacells"), F.min("count").alias("min_size"), F.percentile("count", F.lit(0.5)).alias("median_size"), F.max("count").alias("max_size"))


def detect_label_column(columns: list[str]) -> str | None:
    """``leiden``, else the first name with leiden in it, else with cluster."""
    names = sorted(columns)
    for test in (lambda c: c == "leiden", lambda c: "leiden" in c.lower(), lambda c: "cluster" in c.lower()):
        for c in names:
            if test(c):
                return c
    return None


def chunk_plan(rows: DataFrame, order: str, length: str, size: int) -> DataFrame:
    """Fixed-size chunks of the prepared order."""
    chunk = F.floor(F.col(order) / size)
    return rows.groupBy(chunk.alias("chunk_id")).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count("*").alias("n"), F.avg(length).alias("mean_length"), F.max(length).alias("max_length"))


def pad_tokens(rows: DataFrame, batch: str, tokens: str = "tokens", pad: int = 0) -> DataFrame:
    """Token lists padded to the longest of their batch, and the mask."""
    longest = rows.groupBy(batch).agg(F.max(F.size(tokens)).alias("_longest"))
    joined = rows.join(longest, batch)
    gap = F.col("_longest") - F.size(tokens)
    mask = F.concat(F.transform(tokens, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap))
    return joined.withColumn("mask", mask).withColumn(tokens, F.concat(tokens, F.array_repeat(F.lit(pad), gap))).drop("_longest")


def coalesce_numeric(*columns: str):
    """First alias that holds a number; texts for missing values are skipped."""
    return F.coalesce(*[null_token(F.col(c).cast("string")).try_cast("double") for c in columns])
