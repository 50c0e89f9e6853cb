"""Correlated gene programs: graph, components, refinement, weights, scores, effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import cosine, pearson, place, rmse, tie_rank
from pairlane.functions.storage import checkpointed
from pairlane.functions.tiles import gram, means


def gene_correlation(cells: DataFrame, names: DataFrame, vec: str = "vec") -> DataFrame:
    """(g1, g2, r) of all gene pairs with g1 < g2 over dense rows; not finite counts as 0.

    ``names`` (pos, gene): the selected genes, whose number G is a parameter of the experiment. Tasks multiply
    blocks of centred cells and emit tiles of the upper half of the product, which are summed by
    (row block, column block); the means are G numbers.
    """
    plain = cells.select(F.col(vec).alias("v"))
    _, centre = means(plain, "v")
    whole = checkpointed(gram(plain, "v", centre))
    own = whole.where("p = q").select("p", F.col("s").alias("_var"))
    a, b = (names.join(own, names["pos"] == own["p"]).select(F.col("pos").alias(k), F.col("gene").alias(f"g_{k}"), F.col("_var").alias(f"v_{k}")) for k in ("p", "q"))
    named = whole.where("p < q").join(a, "p").join(b, "q")
    spread = F.sqrt(F.col("v_p") * F.col("v_q"))
    return named.select(F.least("g_p", "g_q").alias("g1"), F.greatest("g_p", "g_q").alias("g2"), F.when(spread > 0, F.col("s") / spread).otherwise(0.0).alias("r"))


def gene_edges(corr: DataFrame, least_r: float = 0.35, least_degree: int = 5) -> DataFrame:
    """Edges with enough correlation between genes with enough of them; all edges if no gene has."""
    edges = corr.where(F.col("r") >= least_r)
    both = edges.select(F.col("g1").alias("gene")).union(edges.select(F.col("g2").alias("gene")))
    degree = both.groupBy("gene").agg(F.count("*").alias("degree"))
    flagged = degree.crossJoin(F.broadcast(degree.agg((F.max("degree") < least_degree).alias("_none"))))  # one row
    keep = flagged.where(F.col("_none") | (F.col("degree") >= least_degree)).select("gene")
    return edges.join(keep.withColumnRenamed("gene", "g1"), "g1", "left_semi").join(keep.withColumnRenamed("gene", "g2"), "g2", "left_semi")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: every gene hangs on one gene, which hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def gene_components(edges: DataFrame) -> DataFrame:
    """(gene, component): smallest gene reachable, by alternating star contractions until all edges are stars."""
    now = checkpointed(edges.select(F.greatest("g1", "g2").alias("a"), F.least("g1", "g2").alias("b")).where("a <> b").distinct())
    while True:
        if _settled(now):
            roots = now.select(F.col("b").alias("gene"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("gene"), F.col("b").alias("component")).union(roots)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(moved.union(small.select("a", F.col("m").alias("b"))).distinct())


def refine_programs(clusters: DataFrame, corr: DataFrame, least_size: int = 5, least_r: float = 0.2, most: int = 50) -> DataFrame:
    """Members of each large enough cluster, ranked by their mean correlation with the other members.

    Members below ``least_r`` drop out unless fewer than ``least_size`` would stay; programs
    are numbered by size, then name.
    """
    size = clusters.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_size)
    c = clusters.join(size, "component")
    sym = corr.select("g1", "g2", "r").union(corr.select(F.col("g2"), F.col("g1"), "r"))
    inside = sym.join(c.select(F.col("gene").alias("g1"), F.col("component").alias("_c")), "g1").join(c.select(F.col("gene").alias("g2"), F.col("component").alias("_d")), "g2").where("_c = _d")
    mean = inside.groupBy(F.col("g1").alias("gene")).agg(F.sum("r").alias("_r"))
    scored = c.join(mean, "gene", "left").withColumn("centroid_corr", F.coalesce("_r", F.lit(0.0)) / (F.col("_n") - 1))
    good = F.count_if(F.col("centroid_corr") >= least_r).over(Window.partitionBy("component"))
    kept = scored.withColumn("_good", good).where((F.col("_good") < least_size) | (F.col("centroid_corr") >= least_r))
    ranked = kept.withColumn("gene_rank_in_program", place(["component"], F.desc("centroid_corr"), "gene")).where(F.col("gene_rank_in_program") <= most)
    sizes = ranked.groupBy("component").agg(F.count("*").alias("program_size"))
    ids = sizes.withColumn("program_id", F.format_string("GP%04d", F.row_number().over(Window.orderBy(F.desc("program_size"), "component"))))
    return ranked.join(ids, "component").select("program_id", "gene", "gene_rank_in_program", F.col("component").alias("raw_cluster"), "centroid_corr", "program_size")


def program_weights(members: DataFrame, stats: DataFrame) -> DataFrame:
    """Weight 1 / (std * sqrt(usable genes)) and the program's intercept: sum of weight * mean.

    Genes without statistics are not usable; the number counts before the std is checked.
    """
    known = members.join(stats.select("gene", "mean", "std"), "gene").withColumn("n_usable", F.count("*").over(Window.partitionBy("program_id")))
    good = known.where("std > 0").withColumn("weight", 1 / (F.col("std") * F.sqrt("n_usable")))
    return good.withColumn("intercept", F.sum(F.col("weight") * F.col("mean")).over(Window.partitionBy("program_id"))).select("program_id", "gene", "weight", "intercept", "n_usable")


def program_scores(expr: DataFrame, weights: DataFrame, cells: DataFrame) -> DataFrame:
    """Sum of weight * value - intercept for every cell and program (a cell without hits gets -intercept).

    Adaptive execution broadcasts the weights where their measured size allows it.
    """
    hit = expr.join(weights.select("program_id", "gene", "weight"), "gene").groupBy("cell_id", "program_id").agg(F.sum(F.col("weight") * F.col("value")).alias("_s"))
    base = cells.select("cell_id").crossJoin(F.broadcast(weights.select("program_id", "intercept").distinct()))
    return base.join(hit, ["cell_id", "program_id"], "left").select("cell_id", "program_id", (F.coalesce("_s", F.lit(0.0)) - F.col("intercept")).alias("score"))


def group_scores(scores: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    return scores.join(labels, "cell_id").groupBy(*by, "program_id").agg(F.avg("score").alias("mean_score"))


def effects(treated: DataFrame, control: DataFrame, on: list[str]) -> DataFrame:
    """Difference of mean scores on common keys."""
    return treated.join(control.withColumnRenamed("mean_score", "_c"), on).withColumn("effect", F.col("mean_score") - F.col("_c")).drop("mean_score", "_c")


def matrix_metrics(pairs: DataFrame, by: list[str], x: str = "pseudo", y: str = "true") -> DataFrame:
    """RMSE, MAE, Pearson, Spearman, magnitude ratio and cosine over all entries."""
    a, b = F.col(x), F.col(y)
    r = pairs.withColumn("_rx", tie_rank(by, a)).withColumn("_ry", tie_rank(by, b))
    return r.groupBy(*by).agg(
        rmse(a, b).alias("rmse"), F.avg(F.abs(a - b)).alias("mae"), pearson(a, b, 2).alias("pearson"), pearson(F.col("_rx"), F.col("_ry"), 2).alias("spearman"),
        F.try_divide(F.sqrt(F.sum(a * a)), F.sqrt(F.sum(b * b))).alias("magnitude_ratio"), cosine(a, b, 2).alias("cosine"), F.count("*").alias("n"),
    )
