"""Statistical comparison of variants over seeds and blocks."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import cache, reduce

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.cdf import chi2_sf, normal_two_sided, rank_sum_two_sided, signed_rank_two_sided, t_two_sided
from pairlane.functions.exprs import tie_rank, value_ranks
from pairlane.functions.storage import checkpointed
from pairlane.operators.manifest import block_key

#: Numbers of methods that a critical distance is computed for.
METHODS = range(2, 101)


def paired_design(df: DataFrame, by: list[str], variant: str, seed: str) -> DataFrame:
    """Whether all variants of a group have the same seeds, at least two."""
    sets = df.groupBy(*by, variant).agg(F.array_sort(F.collect_set(seed)).alias("_s"))
    return sets.groupBy(*by).agg(((F.count_distinct("_s") == 1) & (F.min(F.size("_s")) >= 2)).alias("paired"), F.max(F.size("_s")).alias("n_seeds"))


def _degenerate(mean: Column) -> tuple[Column, Column]:
    """Statistic and p if there is no variance: (0, 1) without a difference, else (+-inf, 0)."""
    return F.when(mean == 0, 0.0).otherwise(F.signum(mean) * float("inf")), F.when(mean == 0, 1.0).otherwise(0.0)


def paired_t(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Paired t of x - y: mean difference, t, df, p; NULL below two pairs."""
    d = F.col(x) - F.col(y)
    s = pairs.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_s"))
    t0, p0 = _degenerate(F.col("mean_difference"))
    flat = F.col("_s") < 1e-15
    s = s.withColumn("df", F.col("n") - 1).withColumn("t", F.when(F.col("n") >= 2, F.when(flat, t0).otherwise(F.col("mean_difference") / (F.col("_s") / F.sqrt("n")))))
    return s.withColumn("p", F.when(F.col("n") >= 2, F.when(flat, p0).otherwise(t_two_sided(F.col("t"), F.col("df"))))).drop("_s")


def welch_t(values: DataFrame, by: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """Welch t of side 'x' against 'y': means, t, df, p; NULL if a side has fewer than two values."""
    s = values.groupBy(*by).agg(*[f(F.when(F.col(side) == k, F.col(value))).alias(f"{n}_{k}") for k in ("x", "y") for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    a, b = F.col("var_x") / F.col("n_x"), F.col("var_y") / F.col("n_y")
    diff = F.col("mean_x") - F.col("mean_y")
    t0, p0 = _degenerate(diff)
    enough, flat = (F.col("n_x") >= 2) & (F.col("n_y") >= 2), (a + b) < 1e-30
    df = F.try_divide((a + b) * (a + b), a * a / (F.col("n_x") - 1) + b * b / (F.col("n_y") - 1))
    s = s.withColumn("df", F.when(enough, F.when(flat, F.col("n_x") + F.col("n_y") - 2).otherwise(df))).withColumn("t", F.when(enough, F.when(flat, t0).otherwise(F.try_divide(diff, F.sqrt(a + b)))))
    return s.withColumn("p", F.when(enough, F.when(flat, p0).otherwise(t_two_sided(F.col("t"), F.col("df"))))).drop("var_x", "var_y")


def holm(df: DataFrame, by: list[str], p: str = "p", tie: str = "variant_id") -> DataFrame:
    """Step-down adjusted p with a running maximum, at most 1; missing p stay missing and do not count."""
    known = F.col(p).isNotNull()
    m = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by, known).orderBy(p, tie))
    out = df.withColumn("_raw", F.when(known, (m - rank + 1) * F.col(p)))
    run = F.max("_raw").over(Window.partitionBy(*by, known).orderBy(p, tie).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("p_holm", F.when(known, F.least(run, F.lit(1.0)))).drop("_raw")


def stars(p: Column) -> Column:
    return F.when(p.isNull(), "NA").when(p <= 1e-4, "****").when(p <= 1e-3, "***").when(p <= 1e-2, "**").when(p <= 0.05, "*").otherwise("ns")


def reference_tests(df: DataFrame, reference: str, by: list[str], variant: str = "variant_id", seed: str = "sampling_seed", value: str = "value") -> DataFrame:
    """Every variant against the reference: paired where at least two seeds match for all its rows, else Welch; Holm and stars."""
    ref = df.where(F.col(variant) == reference).select(*by, F.col(seed).alias("_seed"), F.col(value).alias("_ref"))
    rest = df.where(F.col(variant) != reference)
    on = [rest[b] == ref[b] for b in by] + [rest[seed] == ref["_seed"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    matched = rest.join(ref, cond, "left").select(*[rest[b] for b in by], rest[variant], rest[value].alias("x"), F.col("_ref").alias("y"))
    mode = matched.groupBy(*by, variant).agg(((F.count("y") >= 2) & (F.count("y") == F.count("*"))).alias("paired"))
    paired = paired_t(matched, [*by, variant]).select(*by, variant, F.col("mean_difference").alias("pd"), F.col("t").alias("pt"), F.col("p").alias("pp"))
    names = rest.select(*by, variant).distinct()
    both = rest.select(*by, variant, F.lit("x").alias("side"), F.col(value).alias("value")).unionByName(
        (names.join(ref, by) if by else names.crossJoin(F.broadcast(ref))).select(*by, variant, F.lit("y").alias("side"), F.col("_ref").alias("value"))
    )
    welch = welch_t(both, [*by, variant])
    out = welch.join(mode, [*by, variant]).join(paired, [*by, variant], "left")
    out = out.select(*by, variant, "mean_x", "mean_y", F.when(F.col("paired"), "paired").otherwise("welch").alias("test"), F.when(F.col("paired"), F.col("pt")).otherwise(F.col("t")).alias("t"), F.when(F.col("paired"), F.col("pp")).otherwise(F.col("p")).alias("p"))
    return holm(out, by, tie=variant).withColumn("stars", stars(F.col("p_holm")))


#: Exact p values are taken for untied samples up to these sizes (differences; the smaller of two samples).
EXACT_PAIRS, EXACT_SAMPLE = 50, 8


def wilcoxon(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y", close: float = 1e-8) -> DataFrame:
    """Signed-rank test with mean ranks, zeros dropped.

    p is exact for up to ``EXACT_PAIRS`` differences without zeros and ties, else from the normal approximation
    with tie correction. A group whose pairs all agree within ``close`` has statistic 0 and p 1; pairs
    with a missing value do not count, and a group without any pair has no p.
    """
    d = pairs.select(*by, (F.col(x) - F.col(y)).alias("_d"))
    groups = d.groupBy(*by).agg(F.count("_d").alias("_all"), F.coalesce(F.max(F.abs("_d")) <= close, F.lit(False)).alias("_same"))
    d = d.where("_d <> 0").withColumn("_a", F.abs("_d"))
    r = d.withColumn("_r", tie_rank(by, F.col("_a"))).withColumn("_t", F.count("*").over(Window.partitionBy(*by, "_a")))
    s = r.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.when(F.col("_d") > 0, F.col("_r"))).alias("_up"), F.sum(F.when(F.col("_d") < 0, F.col("_r"))).alias("_down"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_tie"))
    s = groups.join(s, by, "left")
    part = lambda c: F.when(F.col("_all") > 0, F.coalesce(c, F.lit(0.0)))
    s = s.select(*by, "_all", "_same", "_tie", F.coalesce("_n", F.lit(0)).alias("n"), part("_up").alias("w_plus"), part("_down").alias("w_minus"))
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("_tie") / 48.0
    exact = (F.col("n") == F.col("_all")) & (F.col("_tie") == 0) & F.col("n").between(1, EXACT_PAIRS)
    s = s.withColumn("statistic", F.when(F.col("_same"), 0.0).otherwise(F.least("w_plus", "w_minus"))).withColumn("exact", F.coalesce(exact & ~F.col("_same"), F.lit(False)))
    s = s.withColumn("z", F.when(~F.col("_same"), F.try_divide(F.col("statistic") - F.col("n") * (F.col("n") + 1) / 4.0, F.sqrt(var))))
    p = F.when(F.col("_same"), 1.0).when(F.col("exact"), signed_rank_two_sided(F.col("statistic"), F.col("n"))).otherwise(normal_two_sided(F.col("z")))
    return s.withColumn("p", p).drop("_all", "_same", "_tie")


def mann_whitney(values: DataFrame, by: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """U of side 'x' with mean ranks.

    p is exact where the smaller sample has up to ``EXACT_SAMPLE`` values and none are tied, else from the normal
    approximation with tie correction and a continuity correction of a half. A group with an empty side, or with
    one value only, has no z, and an empty side no p.
    """
    values = values.where(F.col(value).isNotNull())
    r = values.withColumn("_r", tie_rank(by, F.col(value))).withColumn("_t", F.count("*").over(Window.partitionBy(*by, value)))
    s = r.groupBy(*by).agg(F.count_if(F.col(side) == "x").alias("n_x"), F.count_if(F.col(side) == "y").alias("n_y"), F.sum(F.when(F.col(side) == "x", F.col("_r"))).alias("_rx"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_tie"))
    n, most = F.col("n_x") + F.col("n_y"), F.col("n_x") * F.col("n_y")
    s = s.withColumn("u", F.col("_rx") - F.col("n_x") * (F.col("n_x") + 1) / 2.0)
    var = most / 12.0 * ((n + 1) - F.try_divide(F.col("_tie"), n * (n - 1)))
    away = F.abs(F.col("u") - most / 2.0)
    s = s.withColumn("exact", (F.col("_tie") == 0) & F.least("n_x", "n_y").between(1, EXACT_SAMPLE))
    s = s.withColumn("z", F.try_divide(F.signum(F.col("u") - most / 2.0) * (away - 0.5), F.sqrt(var)))
    corrected = F.least(F.lit(1.0), F.when(away < 0.5, 1.0).otherwise(normal_two_sided(F.col("z"))))
    p = F.when(F.col("exact"), rank_sum_two_sided(F.least(F.col("u"), most - F.col("u")), F.col("n_x"), F.col("n_y"))).when(F.col("z").isNotNull(), corrected)
    return s.withColumn("p", p).drop("_rx", "_tie")


def rank_matrix(df: DataFrame, block: list[str], method: str, value: str, higher: bool) -> DataFrame:
    """Rank of each method in its block, 1 best, ties shared."""
    return df.withColumn("rank", tie_rank(block, F.col(value), descending=higher))


def mean_ranks(ranks: DataFrame, by: list[str], method: str) -> DataFrame:
    return ranks.groupBy(*by, method).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n_blocks"))


def complete_blocks(df: DataFrame, block: str, method: str) -> DataFrame:
    """Rows of blocks that have every method."""
    k = df.agg(F.count_distinct(method).alias("_k"))
    full = df.groupBy(block).agg(F.count_distinct(method).alias("_m")).crossJoin(F.broadcast(k)).where("_m = _k").select(block)  # one row
    return df.join(full, block, "left_semi")


def friedman(df: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """Chi-square over complete blocks with tie correction."""
    own = complete_blocks(df, block, method)
    r = own.withColumn("_r", tie_rank([block], F.col(value))).withColumn("_t", F.count("*").over(Window.partitionBy(block, value)))
    sums = r.groupBy(method).agg(F.sum("_r").alias("_s"), F.count("*").alias("_n"))
    tie = r.agg(F.sum(F.col("_t") * F.col("_t") - 1).alias("_tie"))
    s = sums.agg(F.count("*").alias("k"), F.max("_n").alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("_q")).crossJoin(F.broadcast(tie))  # one row
    k, n = F.col("k"), F.col("n")
    raw = 12.0 / (n * k * (k + 1)) * F.col("_q") - 3 * n * (k + 1)
    fix = 1 - F.col("_tie") / (n * k * (k * k - 1))
    return s.withColumn("chi2", F.try_divide(raw, fix)).withColumn("df", k - 1).withColumn("p", chi2_sf(F.col("chi2"), F.col("df"))).drop("_q", "_tie")


def kruskal(df: DataFrame, method: str, value: str) -> DataFrame:
    """H over independent groups with tie correction."""
    r = value_ranks(df, [], value, "_r").withColumnRenamed("_r_ties", "_t")
    sums = r.groupBy(method).agg(F.sum("_r").alias("_s"), F.count("*").alias("_n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_tie"))
    s = sums.agg(F.count("*").alias("k"), F.sum("_n").alias("n"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_q"), F.sum("_tie").alias("_tie"))
    n = F.col("n")
    h = F.try_divide(12.0 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1), 1 - F.col("_tie") / (n * n * n - n))
    return s.withColumn("h", h).withColumn("df", F.col("k") - 1).withColumn("p", chi2_sf(F.col("h"), F.col("df"))).drop("_q", "_tie")


@cache
def range_quantile(k: int, alpha: float) -> float:
    """Upper ``alpha`` point of the range of ``k`` independent standard normals: bisection over Simpson's rule."""
    z = np.linspace(-9.0, 9.0, 801)
    weight = np.where(np.arange(801) % 2, 4.0, 2.0)
    weight[[0, -1]] = 1.0
    weight *= np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (z[1] - z[0]) / 3
    below = np.array([math.erfc(-x / math.sqrt(2)) / 2 for x in z])
    low, high = 0.0, 20.0
    while high - low > 1e-11:
        middle = (low + high) / 2
        shifted = np.array([math.erfc(-(x - middle) / math.sqrt(2)) / 2 for x in z])
        if k * (weight * (below - shifted) ** (k - 1)).sum() < 1 - alpha:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def critical_distance(k: Column, n: Column, alpha: float = 0.05, methods: Iterable[int] = METHODS) -> Column:
    """Nemenyi critical distance of ``k`` methods over ``n`` blocks; NULL for a number of methods outside ``methods``."""
    q = F.create_map(*[F.lit(x) for m in methods for x in (m, range_quantile(m, alpha) / math.sqrt(2))])
    return F.try_element_at(q, k.cast("int")) * F.sqrt(k * (k + 1) / (6.0 * n))


def cd_groups(mean_rank: DataFrame, method: str, cd: float) -> DataFrame:
    """Maximal runs of methods whose mean ranks span at most ``cd``, with more than one method."""
    # the methods of one comparison: at most the 20 of the table of critical values
    m = mean_rank.withColumn("_i", F.row_number().over(Window.orderBy("mean_rank", method)))
    a = m.select(F.col("_i").alias("low"), F.col("mean_rank").alias("_a"))
    b = m.select(F.col("_i").alias("high"), F.col("mean_rank").alias("_b"))
    reach = a.join(F.broadcast(b), (F.col("high") >= F.col("low")) & (F.col("_b") - F.col("_a") <= cd)).groupBy("low").agg(F.max("high").alias("high"))
    before = F.coalesce(F.max("high").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return reach.withColumn("_before", before).where("high > _before and high > low").select("low", "high")


def conover(df: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """Pairwise t after Friedman on rank sums over complete blocks; p and Holm."""
    own = complete_blocks(df, block, method)
    r = own.withColumn("_r", tie_rank([block], F.col(value)))
    sums = r.groupBy(method).agg(F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_a"), F.count("*").alias("_n"))
    total = sums.agg(F.count("*").alias("k"), F.max("_n").alias("n"), F.sum("_a").alias("_squares"), F.sum(F.col("_s") * F.col("_s")).alias("_sums"))
    a = sums.select(F.col(method).alias("a"), F.col("_s").alias("_x"))
    b = sums.select(F.col(method).alias("b"), F.col("_s").alias("_y"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).crossJoin(F.broadcast(total))  # methods of one comparison, one row
    k, n = F.col("k"), F.col("n")
    df_ = (n - 1) * (k - 1)
    error = F.sqrt(2 * (n * F.col("_squares") - F.col("_sums")) / df_)
    out = pairs.withColumn("df", df_).withColumn("t", F.try_divide(F.abs(F.col("_x") - F.col("_y")), error)).withColumn("p", t_two_sided(F.col("t"), F.col("df")))
    out = out.withColumn("_all", F.lit(1)).withColumn("pair", F.concat_ws("|", "a", "b"))
    return holm(out, ["_all"], tie="pair").select("a", "b", "t", "df", "p", "p_holm")


def compact_letters(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Letters shared by methods that do not differ: maximal sets without a significant pair.

    ``order`` (method, value): the methods of one comparison, at most 20, lettered by value; ``pairs``
    (a, b, different). Starting from one set of all methods, each significant pair splits the sets
    that hold both, and sets within others are dropped, all as array expressions over one row.
    """
    place = order.select("method", (F.row_number().over(Window.orderBy("value", "method")) - 1).alias("_i"))
    bad = pairs.where("different").join(place.select(F.col("method").alias("a"), F.col("_i").alias("i")), "a").join(place.select(F.col("method").alias("b"), F.col("_i").alias("j")), "b")
    state = place.agg(F.array_sort(F.collect_list("_i")).alias("_all")).crossJoin(bad.agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("_bad")))  # one row each
    state = state.withColumn("_bad", F.when(F.size("_all") <= 20, F.col("_bad")).otherwise(F.raise_error(F.lit("at most 20 methods have letters")).cast("array<struct<i:int,j:int>>")))
    without = lambda s, x: F.filter(s, lambda v: v != x)

    def split(sets: Column, pair: Column) -> Column:
        parts = F.flatten(F.transform(sets, lambda s: F.when(F.array_contains(s, pair["i"]) & F.array_contains(s, pair["j"]), F.array(without(s, pair["i"]), without(s, pair["j"]))).otherwise(F.array(s))))
        return F.get(F.transform(F.array(F.array_distinct(parts)), lambda all_: F.filter(all_, lambda s: ~F.exists(all_, lambda o: (o != s) & (F.size(F.array_except(s, o)) == 0)))), F.lit(0))

    sets = state.select(F.array_sort(F.aggregate("_bad", F.array("_all"), split)).alias("_sets"))
    letters = F.array_join(F.transform(F.col("_sets"), lambda s, n: F.when(F.array_contains(s, F.col("_i")), F.char(97 + n)).otherwise("")), "")
    return place.crossJoin(F.broadcast(sets)).select("method", letters.alias("letters"))  # one row


def best_of_family(df: DataFrame, scope: list[str], family: str, variant: str, value: str, higher: bool) -> DataFrame:
    """Of a family's variants keep the best by mean rank over the metrics of the scope; other rows stay."""
    own = df.where(F.col("family") == family)
    ranked = own.withColumn("_r", tie_rank([*scope, "metric"], F.col(value), descending=higher))
    best = ranked.groupBy(*scope, variant).agg(F.avg("_r").alias("_m")).withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy("_m", variant))).where("_n = 1").select(*scope, variant)
    return df.where(F.col("family") != family).unionByName(own.join(best, [*scope, variant], "left_semi"))


def replicate_reference(df: DataFrame, reference: str, seed: str = "sampling_seed", method: str = "method", value: str = "value") -> DataFrame:
    """The deterministic reference's mean in every seed that the others have."""
    seeds = df.where(F.col(method) != reference).select(seed).distinct()
    mean = df.where(F.col(method) == reference).groupBy(method).agg(F.avg(value).alias(value))
    return df.where(F.col(method) != reference).select(method, seed, value).unionByName(seeds.crossJoin(F.broadcast(mean)).select(method, seed, value))  # one row


def rewrite_methods(df: DataFrame, names: dict[str, str], exclude: list[str], method: str = "method") -> DataFrame:
    """Collapse method names by a map and drop excluded ones."""
    new = F.col(method)
    for a, b in names.items():
        new = F.when(F.col(method) == a, F.lit(b)).otherwise(new)
    return df.withColumn(method, new).where(~F.col(method).isin(exclude)) if exclude else df.withColumn(method, new)


def complete_design(df: DataFrame, block: str, method: str, forced: list[str], least: int = 2) -> tuple[DataFrame, list[str]]:
    """Drop the least covered method (ties: the largest name; forced ones stay) until ``least`` blocks are complete.

    What a method covers does not depend on the others, so the order of dropping is known at once: each
    block needs all methods dropped up to the last one that it lacks, and the ``least``-th smallest of these numbers
    is the number of methods to drop. Two small jobs, however many methods go.
    """
    cover = df.groupBy(method).agg(F.count_distinct(block).alias("_n"))
    order = checkpointed(cover.withColumn("_free", ~F.col(method).isin(forced)).withColumn("_drop", F.when(F.col("_free"), F.row_number().over(Window.partitionBy("_free").orderBy("_n", F.desc(method))))))  # one row a method
    sizes = order.agg(F.count("_drop").alias("_all"), F.count_if(F.col("_drop").isNull()).alias("_kept"))
    have = df.select(block, method).distinct().join(order.select(method, "_drop"), method)
    have = have.groupBy(block).agg(F.collect_set("_drop").alias("_have"), F.count_if(F.col("_drop").isNull()).alias("_here")).crossJoin(F.broadcast(sizes))  # one row
    lacks = F.array_max(F.array_except(F.filter(F.sequence(F.lit(0), F.col("_all").cast("int")), lambda x: x > 0), "_have"))
    need = have.where("_here = _kept").select(F.coalesce(lacks, F.lit(0)).alias("_need"), "_all", "_kept").where("_kept > 0 or _need < _all")
    steps = [r["_need"] for r in need.orderBy("_need").limit(least).collect()]
    if len(steps) < least:
        raise ValueError("no complete blocks")
    dropped = [r[method] for r in order.where(F.col("_drop") <= steps[-1]).orderBy("_drop").collect()]
    now = df.where(~F.col(method).isin(dropped)) if dropped else df
    return complete_blocks(now, block, method), dropped


def cd_report(levels: dict[str, tuple[DataFrame, list[str]]], method: str, value: str, higher: bool) -> DataFrame:
    """Mean ranks, blocks and critical distance of each level: (rows, block columns); a block's value is the mean of its rows."""
    means = [df.groupBy(method, block_key(*[F.col(c) for c in by]).alias("block")).agg(F.avg(value).alias(value)).withColumn("level", F.lit(level)) for level, (df, by) in levels.items()]
    ranks = mean_ranks(rank_matrix(reduce(lambda a, b: a.unionByName(b), means), ["level", "block"], method, value, higher), ["level"], method)
    k = F.count("*").over(Window.partitionBy("level"))
    return ranks.withColumn("cd", critical_distance(k, F.col("n_blocks")))
