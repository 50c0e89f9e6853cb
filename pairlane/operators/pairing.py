"""Matching strategies: a synthetic control for every treated row.

All draws are seeded hashes of (seed, row, draw number), so any partitioning gives the
same pairs, and all seeds of a grid run in one job: ``grid`` columns are just more keys.
Vectors are arrays; a pair table holds ids and weights, and the profile is made by joins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import distance2, draw, numbered_by, percentiles, place
from pairlane.functions.storage import checkpointed, saved


def mean_profile(controls: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: the mean of each dimension over all controls."""
    means = controls.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("profile"))


def mean_control(treated: DataFrame, controls: DataFrame) -> DataFrame:
    """S0: the mean control profile for every row."""
    return treated.crossJoin(F.broadcast(mean_profile(controls)))  # one row


def random_single(treated: DataFrame, controls: DataFrame, n: int, seeds: list[int]) -> DataFrame:
    """S1: one control for each row and seed, with replacement; ``controls`` have ``control_pos`` 0 to n - 1."""
    seeded = treated.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("sampling_seed"))
    drawn = seeded.withColumn("control_pos", draw("s1", F.col("sampling_seed"), F.col("cell_id")) % n)
    return drawn.join(controls.select("control_pos", F.col("cell_id").alias("control_id"), F.col("vec").alias("profile")), "control_pos")


def random_draws(treated: DataFrame, n: int, k: int, seeds: list[int], strategy: str, name: str) -> DataFrame:
    """k draws below n for each row and seed, with replacement: rows with draw_no and ``name``."""
    seeded = treated.select("cell_id", "perturbation", F.explode(F.array(*map(F.lit, seeds))).alias("sampling_seed"))
    drawn = seeded.withColumn("draw_no", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return drawn.withColumn(name, draw(strategy, F.col("sampling_seed"), F.col("cell_id"), F.col("draw_no")) % n)


def distinct_draws(treated: DataFrame, controls: DataFrame, n: int, k: int, seeds: list[int]) -> DataFrame:
    """k different controls for each row and seed: sequential sampling, so work is k draws a row, not n.

    Draw j picks one of the n - j that are left (Floyd's method): a number below j's bound,
    or the bound itself if that number has been taken.
    """
    if k > n:
        raise ValueError("k exceeds the number of controls; sample with replacement")
    seeded = treated.select("cell_id", "perturbation", F.explode(F.array(*map(F.lit, seeds))).alias("sampling_seed"))

    def add(chosen: Column, j: Column) -> Column:
        pick = draw("s2d", F.col("sampling_seed"), F.col("cell_id"), j) % (j + 1)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, pick), j.cast("bigint")).otherwise(pick)))

    picks = F.aggregate(F.sequence(F.lit(n - k), F.lit(n - 1)), F.array().cast("array<bigint>"), add)
    drawn = seeded.select("*", F.posexplode(picks).alias("draw_no", "control_pos"))
    return drawn.join(controls.select("control_pos", F.col("cell_id").alias("control_id")), "control_pos")


def blend(weighted: DataFrame, vectors: DataFrame, key: str, by: list[str], vec: str = "vec") -> DataFrame:
    """Weighted sum of the vectors that each group draws: (by, profile). Only the drawn vectors of a group meet, as arrays."""
    joined = weighted.join(vectors.select(key, F.transform(vec, lambda x: x.cast("double")).alias("_v")), key)
    drawn = joined.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(key, "weight", "_v"))).alias("_all"))
    start = F.transform(F.get("_all", F.lit(0))["_v"], lambda x: F.lit(0.0))
    total = F.aggregate("_all", start, lambda s, d: F.zip_with(s, d["_v"], lambda a, b: a + d["weight"] * b))
    return drawn.select(*by, total.alias("profile"))


def average_profiles(draws: DataFrame, vectors: DataFrame, key: str, k: int, vec: str = "vec") -> DataFrame:
    """Mean profile of the k drawn ``vectors`` (key) of each row and seed."""
    by = ["cell_id", "perturbation", "sampling_seed"]
    return blend(draws.groupBy(*by, key).agg((F.count("*") / k).alias("weight")), vectors, key, by, vec)


def balanced_metacells(treated: DataFrame, m: int, seed: int) -> DataFrame:
    """S4: inside each perturbation every metacell is used equally often (counts differ by one at most)."""
    placed = numbered_by(treated, ["perturbation"], {"draw": draw("s4", seed, F.col("cell_id")), "key": F.col("cell_id")}, "_nth")
    return placed.withColumn("mc_index", F.col("_nth") % m).withColumn("use_no", F.floor(F.col("_nth") / m)).drop("_nth")


def members(membership: DataFrame, seed: int) -> DataFrame:
    """Members of each metacell in a seeded order, numbered from 0, with the metacell's index and size."""
    index = membership.select("metacell_id").distinct().withColumn("mc_index", F.row_number().over(Window.orderBy("metacell_id")) - 1)
    size = membership.groupBy("metacell_id").agg(F.count("*").alias("mc_size"))
    order = place(["metacell_id"], draw("member", seed, F.col("cell_id")), "cell_id") - 1
    return membership.withColumn("member_no", order).join(index, "metacell_id").join(size, "metacell_id").withColumnRenamed("cell_id", "control_id")


def sample_members(assigned: DataFrame, member: DataFrame, seed: int) -> DataFrame:
    """One member of the assigned metacell: without replacement while the perturbation's rows do not exceed its members, else with."""
    sizes = member.select("mc_index", "mc_size").distinct()
    rows = assigned.groupBy("perturbation", "mc_index").agg(F.count("*").alias("rows"))
    sized = assigned.join(rows, ["perturbation", "mc_index"]).join(sizes, "mc_index")
    again = draw("s4m", seed, F.col("cell_id")) % F.col("mc_size")
    picked = sized.withColumn("member_no", F.when(F.col("rows") <= F.col("mc_size"), F.col("use_no")).otherwise(again))
    return picked.join(member.select("mc_index", "member_no", "metacell_id", "control_id"), ["mc_index", "member_no"])


def control_mass(sizes: DataFrame, mode: str = "size") -> DataFrame:
    """Source mass of each metacell: by size or uniform."""
    total = sizes.agg(F.sum("n_cells").alias("_n"), F.count("*").alias("_m"))
    mass = F.col("n_cells") / F.col("_n") if mode == "size" else F.lit(1.0) / F.col("_m")
    return sizes.crossJoin(F.broadcast(total)).withColumn("mass", mass).drop("_n", "_m")  # one row


def transport_cost(treated: DataFrame, metacell: DataFrame) -> DataFrame:
    """Distance of each treated row to each metacell, over the perturbation's median positive distance.

    ``metacell`` is a bounded side: its number is a parameter of the experiment.
    """
    pairs = treated.select("cell_id", "perturbation", F.col("vec").alias("_x")).join(F.broadcast(metacell.select("mc_index", F.col("profile").alias("_p"))))
    raw = pairs.select("cell_id", "perturbation", "mc_index", F.sqrt(distance2(F.col("_x"), F.col("_p"))).alias("distance"))
    raw = saved(raw)
    middle = percentiles(raw.where("distance > 0"), ["perturbation"], "distance", "_scale")
    return raw.join(middle, "perturbation", "left").withColumn("cost", F.col("distance") / F.coalesce("_scale", F.lit(1.0))).drop("_scale")


#: Kernel entries (cells x metacells) of a perturbation up to which its scaling runs in one task: 64 MB.
IN_TASK = 8_000_000


def sinkhorn(cost: DataFrame, mass: DataFrame, reg: float = 0.05, iterations: int = 2000, tolerance: float = 1e-7, in_task: int = IN_TASK) -> DataFrame:
    """Entropic transport plan of each perturbation: (perturbation, cell_id, mc_index, flow).

    All cells of a perturbation take part. Each has a row of the kernel, one number for each
    metacell. A perturbation of at most ``in_task`` kernel entries is scaled in one task; of a larger one
    only the sums by metacell leave the tasks, round after round, and the plan is the same.
    A perturbation stops when, at a tenth iteration, the cells' marginals are off by less than
    ``tolerance`` (Euclidean norm). Each cell's smallest cost is subtracted before the exponential,
    which leaves the plan as it is and keeps the kernel from vanishing; a metacell whose
    whole row still vanishes gets a floor. Results that are not finite raise an error.
    """
    per = cost.groupBy("perturbation", "cell_id").agg(F.min("cost").alias("_low"), F.array_sort(F.collect_list(F.struct("mc_index", "cost"))).alias("_c"))
    rows = per.select("perturbation", "cell_id", F.transform("_c", lambda c: F.greatest(F.exp(-(c["cost"] - F.col("_low")) / reg), F.lit(1e-250))).alias("_row"))
    masses = mass.agg(F.transform(F.array_sort(F.collect_list(F.struct("mc_index", "mass"))), lambda s: s["mass"]).alias("_a"))
    rows = checkpointed(rows.crossJoin(F.broadcast(masses)))  # one row
    large = checkpointed(rows.groupBy("perturbation").agg(F.count("*").alias("_n"), F.max(F.size("_row")).alias("_m")).where(F.col("_n") * F.col("_m") > in_task).select("perturbation", "_n"))
    key = rows.schema["cell_id"].dataType.simpleString()
    if large.isEmpty():
        small, rounds = rows, None
    else:
        small, rounds = rows.join(large, "perturbation", "left_anti"), _scaled_in_rounds(rows.join(F.broadcast(large), "perturbation"), iterations, tolerance)  # few: each has over in_task entries

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("cell_id")
        k, a = _kernel(group), np.array(group.column("_a")[0].as_py())
        n = len(k)
        v = 1 / n / k.mean(axis=1)
        for i in range(iterations - 1):
            after = 1 / n / (k @ (a / (k.T @ v)))
            if i % 10 == 0 and np.sqrt(((v / after - 1) ** 2).sum()) / n < tolerance:
                break
            v = after
        flow = k * (a / (k.T @ v)) * v[:, None]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flow.ravel()), flow.shape[1]).cast(pa.list_(pa.float64()))
        return pa.table([group.column("perturbation"), group.column("cell_id"), lists], names=["perturbation", "cell_id", "flows"])

    out = small.groupBy("perturbation").applyInArrow(solve, f"perturbation string, cell_id {key}, flows array<double>")
    out = out if rounds is None else out.unionByName(rounds)
    out = out.select("perturbation", "cell_id", F.posexplode("flows").alias("mc_index", "flow"))
    bad = F.isnan("flow") | (F.abs("flow") == F.lit(float("inf")))
    return out.withColumn("flow", F.when(bad, F.raise_error(F.lit("transport did not stay finite"))).otherwise(F.col("flow")))


def _kernel(group: pa.Table) -> np.ndarray:
    return group.column("_row").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)


def _scaled_in_rounds(rows: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    """``sinkhorn`` for large groups (perturbation, cell_id, _row, _a, _n): a round shuffles one sum for each group and metacell.

    Scaling vectors of metacells are broadcast: a row for each group of this size.
    """
    inner = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, z: t + z)

    def scales(state: DataFrame) -> DataFrame:
        sums = state.select("perturbation", "_a", F.posexplode(F.transform("_row", lambda k: k * F.col("_v"))).alias("i", "x")).groupBy("perturbation", "i").agg(F.sum("x").alias("d"), F.first("_a").alias("_a"))
        return sums.groupBy("perturbation").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.get("_a", F.col("i")) / F.col("d")).alias("u")))), lambda x: x["u"]).alias("_u"))

    even = F.aggregate("_row", F.lit(0.0), lambda t, x: t + x) / F.size("_row")
    state = checkpointed(rows.withColumn("_v", 1.0 / F.col("_n") / even).withColumn("_done", F.lit(False)))
    for i in range(iterations - 1):
        after = state.join(F.broadcast(scales(state)), "perturbation").withColumn("_w", F.when(F.col("_done"), F.col("_v")).otherwise(1.0 / F.col("_n") / inner("_row", "_u"))).drop("_u")
        if i % 10 == 0:
            after = checkpointed(after)
            off = after.groupBy("perturbation").agg((F.sqrt(F.sum((F.col("_v") / F.col("_w") - 1) ** 2)) / F.max("_n") < tolerance).alias("_close"))
            after = checkpointed(after.join(F.broadcast(off), "perturbation").withColumn("_done", F.col("_done") | F.col("_close")).drop("_close"))
        state = after.withColumn("_v", F.when(F.col("_done"), F.col("_v")).otherwise(F.col("_w"))).drop("_w")
        if i % 10 == 0 and state.where("not _done").isEmpty():
            break
        if i % 5 == 4:
            state = checkpointed(state)
    state = checkpointed(state)
    last = state.join(F.broadcast(scales(state)), "perturbation")
    return last.select("perturbation", "cell_id", F.zip_with("_row", "_u", lambda k, u: k * u * F.col("_v")).alias("flows"))


def top_transport(plan: DataFrame, k: int, n_metacells: int) -> DataFrame:
    """Per cell the k largest shares of its column, renormalised, and the column's normalised entropy (0 for one metacell)."""
    per = plan.groupBy("perturbation", "cell_id").agg(F.sum("flow").alias("_sum"), F.array_sort(F.collect_list(F.struct((-F.col("flow")).alias("neg"), "mc_index"))).alias("_all"))
    share = F.transform("_all", lambda s: F.struct((-s["neg"] / F.col("_sum")).alias("w"), s["mc_index"].alias("mc_index")))
    per = per.select("perturbation", "cell_id", share.alias("_all"))
    entropy = -F.aggregate("_all", F.lit(0.0), lambda s, x: s + x["w"] * F.ln(x["w"] + 1e-12))
    top = F.slice("_all", 1, min(k, n_metacells))
    total = F.aggregate(top, F.lit(0.0), lambda s, x: s + x["w"])
    norm = F.log(F.lit(float(n_metacells))) if n_metacells > 1 else F.lit(1.0)
    weights = F.transform(top, lambda x, i: F.struct((i + 1).alias("rank"), x["mc_index"].alias("mc_index"), (x["w"] / total).alias("weight")))
    return per.select("perturbation", "cell_id", weights.alias("top"), (entropy / norm if n_metacells > 1 else F.lit(0.0)).alias("entropy"))


def transport_profiles(assigned: DataFrame, member: DataFrame, controls: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """S5: sum over the top metacells of weight x mean of ``n_draws`` sampled members; ``controls`` have cell_id and vec."""
    exploded = assigned.select("perturbation", "cell_id", F.explode("top").alias("t")).select("perturbation", "cell_id", "t.mc_index", "t.weight", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw_no"))
    sized = exploded.join(member.select("mc_index", "mc_size").distinct(), "mc_index")
    picked = sized.withColumn("member_no", draw("s5", seed, F.col("cell_id"), F.col("mc_index"), F.col("draw_no")) % F.col("mc_size"))
    ids = picked.join(member.select("mc_index", "member_no", "control_id"), ["mc_index", "member_no"])
    weight = ids.groupBy("perturbation", "cell_id", "control_id").agg((F.sum("weight") / n_draws).alias("weight"))
    return blend(weight, controls.select(F.col("cell_id").alias("control_id"), "vec"), "control_id", ["perturbation", "cell_id"])


def pair_ids(pairs: DataFrame, order: str) -> DataFrame:
    """``pair_000000000000`` ids by an existing gapless position."""
    return pairs.withColumn("pair_id", F.concat(F.lit("pair_"), F.lpad(F.col(order).cast("string"), 12, "0")))


def usage(pairs: DataFrame, by: list[str], used: str = "control_id") -> DataFrame:
    return pairs.groupBy(*by, used).agg(F.count("*").alias("times"))


def usage_qc(pairs: DataFrame, by: list[str], used: str = "control_id") -> DataFrame:
    """Distinct ids used, and mean, median and largest number of uses."""
    return usage(pairs, by, used).groupBy(*by).agg(F.count("*").alias("n_used"), F.avg("times").alias("mean_use"), F.percentile("times", F.lit(0.5)).alias("median_use"), F.max("times").alias("max_use"), F.sum("times").alias("n_rows"))


def usage_entropy(counts: DataFrame, by: list[str], times: str = "times") -> DataFrame:
    """Entropy of the uses over the log of their number; 0 if one id or none is used."""
    used = counts.where(F.col(times) > 0)
    total = used.groupBy(*by).agg(F.sum(times).alias("_n"), F.count("*").alias("n_used"))
    p = F.col(times) / F.col("_n")
    return used.join(total, by).groupBy(*by).agg((-F.sum(p * F.ln(p))).alias("_h"), F.max("n_used").alias("n_used")).select(*by, "n_used", F.when(F.col("n_used") <= 1, 0.0).otherwise(F.col("_h") / F.ln("n_used")).alias("entropy"))


def strategy_grid(groups: DataFrame, seeds: list[int], ks: list[int], settings: list[int], top_ks: list[int]) -> DataFrame:
    """Every (group, strategy, parameters, seed) that is to run; groups x a bounded parameter table."""
    spark = groups.sparkSession
    rows = [("S0", None, None, None, -1)]
    for s in seeds:
        rows += [("S1", None, None, None, s), *[("S2", None, k, None, s) for k in ks], *[("S4", m, None, None, s) for m in settings]]
        rows += [("S3", m, k, None, s) for m in settings for k in ks] + [("S5", m, None, j, s) for m in settings for j in top_ks]
    grid = spark.createDataFrame(rows, "strategy string, n_metacells int, k int, top_k int, sampling_seed int")
    label = F.concat_ws("__", F.concat(F.lit("nmc_"), "n_metacells"), F.concat(F.lit("k_"), "k"), F.concat(F.lit("topk_"), "top_k"))
    return groups.crossJoin(F.broadcast(grid)).withColumn("parameter_label", F.when(label == "", "default").otherwise(label))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
