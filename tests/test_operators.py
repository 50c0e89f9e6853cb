"""Hand-made frames: edge cases, properties and textbook values that SQL comparison does not reach."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlane.functions import cdf
from pairlane.functions.exprs import numbered
from pairlane.operators import evaluate as E
from pairlane.operators import manifest as M
from pairlane.operators import normalise as N
from pairlane.operators import predict as P2
from pairlane.operators import pairing as P
from pairlane.operators import predict, prepare, programs
from pairlane.operators import stats as S
from pairlane.operators import summarize as A
from pairlane.sources import tables


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


def test_numbers_are_gapless_for_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = {r.x: r.n for r in numbered(df.repartition(13), ["x"], "n").collect()}
    assert got == {x: i for i, x in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))}


@pytest.mark.parametrize(
    "name,args,want",
    [
        ("t_two_sided", (2.228, 10), 0.05), ("t_two_sided", (12.706, 1), 0.05), ("t_two_sided", (0.0, 5), 1.0), ("chi2_sf", (3.841, 1), 0.05),
        ("chi2_sf", (18.307, 10), 0.05), ("normal_two_sided", (1.959964,), 0.05), ("f_sf", (4.965, 1, 10), 0.05), ("chi2_sf", (0.0, 3), 1.0),
    ],
)
def test_textbook_quantiles(spark, name, args, want):
    value = getattr(cdf, name)(*[F.lit(x) for x in args])
    assert abs(spark.range(1).select(value.alias("p")).first().p - want) < 3e-5


def test_exact_distribution_values(spark):
    row = spark.range(1).select(cdf.t_two_sided(F.lit(1.0), F.lit(1)).alias("a"), cdf.t_two_sided(F.lit(1.0), F.lit(2)).alias("b"), cdf.chi2_sf(F.lit(3.0), F.lit(2)).alias("c"), cdf.normal_two_sided(F.lit(1.5)).alias("d")).first()
    want = (0.5, 1 - 1 / math.sqrt(3), math.exp(-1.5), math.erfc(1.5 / math.sqrt(2)))
    assert all(abs(x - y) < 1e-9 for x, y in zip(row, want))


def test_names_stay_unique_when_a_made_name_is_taken(spark):
    rows = [(i, x) for i, x in enumerate(["a", "a", "a-1", "a", "b"])]
    got = [r.unique_name for r in prepare.unique_names(table(spark, rows, "i int, x string"), "x", "i").orderBy("i").collect()]
    assert got == ["a", "a-2", "a-1", "a-3", "b"]


def test_multiplicity_must_be_a_number(spark):
    with pytest.raises(Exception, match="numeric"):
        prepare.annotate_multiplicity(table(spark, [(None,)], "nperts int")).collect()


def test_missing_keys_and_genes(spark):
    df = table(spark, [(1,)], "x int")
    with pytest.raises(ValueError):
        prepare.resolve_key(df)
    with pytest.raises(ValueError):
        prepare.resolve_key(df, "y")
    a, b = table(spark, [("g1",), ("g2",)], "gene string"), table(spark, [("g2",)], "gene string")
    assert [r.gene for r in prepare.align_genes(a, b).collect()] == ["g2"]
    with pytest.raises(ValueError):
        prepare.align_genes(a, b, require_all=True)


def test_labels_by_position_when_ids_are_unknown(spark):
    emb = table(spark, [(i, i) for i in range(4)], "cell_id long, pos long")
    lab = table(spark, [(100 + i, i, f"l{i}") for i in range(3)], "cell_id long, pos long, label string")
    got = prepare.align_labels(emb, lab).orderBy("pos").collect()
    assert [(r.aligned, r["mode"]) for r in got] == [(f"l{i}", "position") for i in range(3)]


def test_membership_by_position_and_absent_ids(spark):
    controls = table(spark, [(10, 0), (11, 1)], "cell_id long, cell_pos long")
    good = prepare.validate_membership(table(spark, [(10, 0, "m"), (11, 1, "m")], "cell_id long, cell_pos long, metacell_id string"), controls).collect()
    assert {(r.cell_id, r.cell_pos, r["mode"]) for r in good} == {(10, 0, "position"), (11, 1, "position")}
    bad = prepare.validate_membership(table(spark, [(10, 5, "m"), (99, 1, "m")], "cell_id long, cell_pos long, metacell_id string"), controls).collect()
    assert {(r.cell_id, r.cell_pos, r.absent) for r in bad} == {(10, 0, False), (99, None, True)}


def test_label_column_choice():
    assert prepare.detect_label_column(["x", "leiden", "a_leiden"]) == "leiden"
    assert prepare.detect_label_column(["cluster", "my_Leiden"]) == "my_Leiden"
    assert prepare.detect_label_column(["x", "k_cluster"]) == "k_cluster" and prepare.detect_label_column(["x"]) is None


def test_zero_cells_survive_normalisation(spark):
    expr = table(spark, [("a", "g1", 0.0), ("a", "g2", 0.0), ("b", "g1", 3.0), ("b", "g2", 1.0)], "cell_id string, gene string, value double")
    got = {(r.cell_id, r.gene): r.value for r in N.normalize_total(expr, 100).collect()}
    assert got == {("a", "g1"): 0, ("a", "g2"): 0, ("b", "g1"): 75, ("b", "g2"): 25}


def test_variance_counts_the_zeros(spark):
    expr = table(spark, [("a", "g", 4.0)], "cell_id string, gene string, value double")
    r = one(N.gene_stats(expr, n_cells=4))
    assert (r["mean"], r["variance"], r["nonzero_frac"]) == (1.0, 3.0, 0.25)


def test_genes_with_equal_scores_rank_by_name(spark):
    """In a bin of two genes the scores are +-sqrt(1/2), whose last bits differ from bin to bin."""
    level = lambda j, k: 1.7**j * (3 + 0.01 * k)
    rows = [(c, f"g{7 - j}{k}", math.log1p(level(j, k) * (1 + (0.1 + 0.07 * k) * c))) for j in range(8) for k in range(2) for c in range(10)]
    got = N.hvg_seurat(table(spark, rows, "cell_id int, gene string, value double"), 10, 4, bins=8).orderBy("hv_rank").collect()
    assert [r.gene for r in got] == ["g61", "g71", *[f"g{i}1" for i in range(6)], "g60", *[f"g{i}0" for i in range(6)], "g70"]
    assert [r.gene for r in got if r.highly_variable] == ["g61", "g71", "g01", "g11"]


def test_pca_keeps_distances(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 3)) @ rng.standard_normal((3, 6)) + 5
    cells = table(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id int, vec array<double>")
    out = {r.cell_id: np.array(r.pca) for r in N.pca(cells, cells, 3).collect()}
    for i in range(5):
        for j in range(i):
            assert abs(np.linalg.norm(out[i] - out[j]) - np.linalg.norm(x[i] - x[j])) < 1e-8
    assert abs(np.mean(list(out.values()), axis=0)).max() < 1e-8


def test_zero_vector_has_no_norm(spark):
    assert one(table(spark, [([0.0, 0.0],)], "v array<double>").select(N.l2_normalize(F.col("v")).alias("v")))["v"] == [0.0, 0.0]


def cells(spark, n, label):
    return table(spark, [(i, f"{label}{i % 3}", [float(i), 1.0]) for i in range(n)], "cell_id long, perturbation string, vec array<double>")


def test_draws_without_replacement_differ(spark):
    treated, controls = cells(spark, 40, "p"), numbered(cells(spark, 12, "c"), ["cell_id"], "control_pos")
    got = P.distinct_draws(treated, controls, 12, 5, [0, 1]).groupBy("cell_id", "sampling_seed").agg(F.count_distinct("control_id").alias("n"), F.count("*").alias("m"))
    assert got.where("n <> 5 or m <> 5").count() == 0 and got.count() == 80
    all_ = P.distinct_draws(treated, controls, 12, 12, [0]).groupBy("cell_id").agg(F.count_distinct("control_id").alias("n"))
    assert all_.where("n <> 12").count() == 0
    with pytest.raises(ValueError):
        P.distinct_draws(treated, controls, 12, 13, [0])


def test_draws_do_not_depend_on_partitions(spark):
    treated, controls = cells(spark, 40, "p"), numbered(cells(spark, 12, "c"), ["cell_id"], "control_pos")
    a = P.random_single(treated.repartition(1), controls, 12, [3]).select("cell_id", "control_id").collect()
    b = P.random_single(treated.repartition(9), controls, 12, [3]).select("cell_id", "control_id").collect()
    assert sorted(a) == sorted(b)


def test_balanced_use_differs_by_one(spark):
    out = P.balanced_metacells(cells(spark, 50, "p"), 4, 1).groupBy("perturbation", "mc_index").count()
    spread = out.groupBy("perturbation").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.where("d > 1").count() == 0


def test_sampled_members_belong_and_do_not_repeat(spark):
    member = P.members(table(spark, [(i, f"m{i % 4}") for i in range(40)], "cell_id long, metacell_id string"), 2)
    out = P.sample_members(P.balanced_metacells(cells(spark, 60, "p"), 4, 1), member, 2)
    assert out.where(F.concat(F.lit("m"), (F.col("control_id") % 4).cast("string")) != F.col("metacell_id")).count() == 0
    assert out.count() == 60 and out.groupBy("perturbation", "control_id").count().where("count > 1").count() == 0


def test_transport_has_its_marginals(spark):
    rng = np.random.default_rng(1)
    treated = table(spark, [(i, "p", [float(v) for v in rng.standard_normal(3)]) for i in range(12)], "cell_id long, perturbation string, vec array<double>")
    mc = table(spark, [(j, 1 + j, [float(v) for v in rng.standard_normal(3)]) for j in range(4)], "mc_index int, n_cells long, profile array<double>")
    plan = P.sinkhorn(P.transport_cost(treated, mc), P.control_mass(mc), iterations=800).cache()
    by_cell = [r.s for r in plan.groupBy("cell_id").agg(F.sum("flow").alias("s")).collect()]
    by_mc = {r.mc_index: r.s for r in plan.groupBy("mc_index").agg(F.sum("flow").alias("s")).collect()}
    assert max(abs(s - 1 / 12) for s in by_cell) < 1e-6 and max(abs(by_mc[j] - (1 + j) / 10) for j in range(4)) < 1e-6
    top = P.top_transport(plan, 9, 4).collect()  # k above the number of metacells
    assert all(len(r.top) == 4 and abs(sum(x.weight for x in r.top) - 1) < 1e-9 and 0 <= r.entropy <= 1 + 1e-9 for r in top)


def test_transport_stops_by_the_tolerance(spark):
    rng = np.random.default_rng(2)
    x, p, size = rng.standard_normal((15, 3)), rng.standard_normal((4, 3)), np.array([1.0, 2, 3, 4])
    treated = table(spark, [(i, "p", v.tolist()) for i, v in enumerate(x)], "cell_id long, perturbation string, vec array<double>")
    mc = table(spark, [(j, 1 + j, v.tolist()) for j, v in enumerate(p)], "mc_index int, n_cells long, profile array<double>")
    cost = np.sqrt(((p[:, None] - x[None]) ** 2).sum(axis=2))
    k, a, b = np.exp(-cost / np.median(cost) / 0.05), size / size.sum(), np.full(15, 1 / 15)
    for most, tolerance in ((1, 1e-7), (25, 0.0), (2000, 1e-2), (2000, 1e-7)):
        u = np.full(4, 1 / 4)
        for i in range(most):
            v = b / (k.T @ u)
            u = a / (k @ v)
            if i % 10 == 0 and np.linalg.norm(v * (k.T @ u) - b) < tolerance:
                break
        plan = P.sinkhorn(P.transport_cost(treated, mc), P.control_mass(mc), iterations=most, tolerance=tolerance).collect()
        assert len(plan) == 60 and all(abs(r.flow - u[r.mc_index] * k[r.mc_index, r.cell_id] * v[r.cell_id]) < 1e-9 for r in plan)


def test_transport_in_rounds_is_the_same(spark):
    rng = np.random.default_rng(3)
    treated = table(spark, [(i, "pq"[i % 3 == 0], rng.standard_normal(3).tolist()) for i in range(30)], "cell_id long, perturbation string, vec array<double>")
    mc = table(spark, [(j, 1 + j, rng.standard_normal(3).tolist()) for j in range(4)], "mc_index int, n_cells long, profile array<double>")
    for most, tolerance in ((14, 1e-7), (30, 1e-2)):
        a, b = ({(r.cell_id, r.mc_index): r.flow for r in P.sinkhorn(P.transport_cost(treated, mc), P.control_mass(mc), iterations=most, tolerance=tolerance, in_task=n).collect()} for n in (100_000, 15))
        assert len(a) == 120 and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_transport_takes_every_cell(spark):
    from pairlane import plans

    sf = "/root/testdata/sf0.1"
    size = {r.label: r["count"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("label <> 0").groupBy("label").count().collect()}
    out = plans.queries()["ot_sinkhorn"](spark, sf).groupBy("perturbation").agg(F.count_distinct("cell_id").alias("n"), F.sum("flow").alias("mass")).collect()
    assert {r.perturbation for r in out} == {f"p{x}" for x in size} and all(r.n == size[int(r.perturbation[1:])] > 100 and abs(r.mass - 1) < 1e-4 for r in out)


def test_entropy_of_one_use_is_zero(spark):
    r = one(P.usage_entropy(table(spark, [("r", "c1", 5)], "run string, control_id string, times long"), ["run"]))
    assert r["entropy"] == 0.0 and r["n_used"] == 1


def test_metrics_guard_constant_and_short_vectors(spark):
    rows = [("constant", 1.0, float(i)) for i in range(5)] + [("short", 1.0, 2.0), ("short", 2.0, 1.0)] + [("good", float(i), -2.0 * i) for i in range(5)] + [("nan", float("nan"), 1.0)]
    got = {r.k: r for r in E.pair_metrics(table(spark, rows, "k string, x double, y double"), ["k"]).collect()}
    assert got["constant"].pearson is None and got["short"].pearson is None and abs(got["good"].pearson + 1) < 1e-12 and "nan" not in got


def test_ties_share_their_rank(spark):
    r = one(E.pair_metrics(table(spark, [("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 3.0, 3.0)], "k string, x double, y double"), ["k"]))
    x, y = np.array([1.5, 1.5, 3, 4]), np.array([1, 2, 3.5, 3.5])
    assert abs(r["spearman"] - np.corrcoef(x, y)[0, 1]) < 1e-12


def test_split_has_every_part(spark):
    rows = [(i, "abc"[i % 3]) for i in range(30)] + [(99, "d"), (98, "d")]
    out = predict.stratified_split(table(spark, rows, "cell_id long, label string"), "label", "cell_id", 1)
    n = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert n == {(x, s): k for x in "abc" for s, k in (("train", 7), ("valid", 1), ("test", 2))}


def test_class_absent_from_the_predictions(spark):
    pred = table(spark, [(0, 0), (0, 0), (1, 0), (1, 2)], "y_true int, y_pred int")
    m = one(predict.classification_metrics(pred.withColumn("run", F.lit(1)), ["run"]))
    assert abs(m["accuracy"] - 0.5) < 1e-12 and abs(m["balanced_accuracy"] - 0.5) < 1e-12 and abs(m["macro_f1"] - 0.8 / 3) < 1e-12


def test_auc_of_a_missing_class_is_null(spark):
    prob = table(spark, [(i, i % 2, c, 0.9 if c == i % 2 else 0.05) for i in range(6) for c in range(3)], "cell_id int, y_true int, class int, p double")
    got = {r["class"]: r.auc for r in predict.auc_per_class(prob.withColumn("run", F.lit(1)), ["run"]).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: None}


def test_derived_metrics_guard_zero_and_absence(spark):
    df = table(spark, [(0.0, 1.0), (2.0, 1.0)], "a double, b double")
    out, report = A.derive_metrics(df, {"r": ("relative_reduction", ["a", "b"]), "x": ("direct", ["none"])}, strict=False)
    assert [r.r for r in out.orderBy("a").collect()] == [None, 0.5] and {r.metric: r.available for r in report.collect()} == {"r": True, "x": False}
    with pytest.raises(ValueError):
        A.derive_metrics(df, {"x": ("direct", ["none"])})


def test_repeated_keys_raise(spark):
    df = table(spark, [("a",), ("a",)], "variant_id string")
    with pytest.raises(Exception, match="repeated"):
        A.assert_unique(df, ["variant_id"]).collect()
    assert one(A.duplicate_keys(df, ["variant_id"]))["n"] == 2


def test_unknown_strategies_stay_last(spark):
    got = {r.strategy: (r.strategy_canonical, r.strategy_order) for r in M.rename_strategies(table(spark, [("S0",), ("odd",)], "strategy string")).collect()}
    assert got == {"S0": ("S0_naive_mean_control_reference", 0), "odd": ("odd", 99)}


def test_components_of_two_chains(spark):
    edges = table(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("x", "y", 1.0)], "g1 string, g2 string, r double")
    got = {r.gene: r.component for r in programs.gene_components(edges).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("xy", "x")}


def test_edges_fall_back_when_no_gene_has_the_degree(spark):
    corr = table(spark, [("a", "b", 0.9), ("b", "c", 0.1)], "g1 string, g2 string, r double")
    assert programs.gene_edges(corr, 0.35, 5).count() == 1


def test_degenerate_t_tests(spark):
    rows = [("same", 1.0, 1.0)] * 3 + [("shift", 2.0, 1.0)] * 3 + [("one", 1.0, 2.0)]
    got = {r.k: (r.t, r.p) for r in S.paired_t(table(spark, rows, "k string, x double, y double"), ["k"]).collect()}
    assert got == {"same": (0.0, 1.0), "shift": (math.inf, 0.0), "one": (None, None)}


def test_paired_t_textbook(spark):
    x, y = [30.0, 28.0, 32.0, 26.0, 33.0, 25.0, 28.0, 30.0], [28.0, 29.0, 30.0, 22.0, 31.0, 24.0, 26.0, 29.0]
    r = one(S.paired_t(table(spark, [("k", a, b) for a, b in zip(x, y)], "k string, x double, y double"), ["k"]))
    d = np.array(x) - y
    assert abs(r["t"] - d.mean() / (d.std(ddof=1) / math.sqrt(8))) < 1e-12 and 0.013 < r["p"] < 0.015


def test_holm_skips_missing(spark):
    rows = [("g", "a", 0.01), ("g", "b", 0.04), ("g", "c", 0.03), ("g", "d", None)]
    got = {r.variant_id: r.p_holm for r in S.holm(table(spark, rows, "g string, variant_id string, p double"), ["g"]).collect()}
    assert got["d"] is None and all(abs(got[k] - v) < 1e-12 for k, v in {"a": 0.03, "c": 0.06, "b": 0.06}.items())


def test_friedman_with_ties(spark):
    rows = [(b, m, v) for b, vs in enumerate([(1.0, 2.0, 3.0), (1.0, 3.0, 2.0), (1.0, 1.0, 3.0)]) for m, v in zip("xyz", vs)] + [(9, "x", 1.0)]
    r = one(S.friedman(table(spark, rows, "b int, m string, v double"), "b", "m", "v"))
    assert r["n"] == 3 and r["k"] == 3 and abs(r["chi2"] - 42 / 11) < 1e-9


def test_rows_keep_their_rank_if_their_values_change_when_computed_again(spark):
    """As the last bits of a mean do, whose sum runs in another order: every row counts once."""
    again = F.udf(lambda i: (i % 10) + random.random() / 2, "double").asNondeterministic()
    df = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("m"), again("id").alias("x"), again("id").alias("y"))
    r = one(S.kruskal(df, "m", "x"))
    assert (r["k"], r["n"]) == (2, 40) and 0 < r["h"] and 0 < r["p"] < 1
    r = one(E.pair_metrics(df, [], large=True))
    assert r["n"] == 40 and r["spearman"] > 0.9


def test_letters(spark):
    pairs = table(spark, [("a", "c", True), ("a", "b", False), ("b", "c", False)], "a string, b string, different boolean")
    order = table(spark, [("a", 1.0), ("b", 2.0), ("c", 3.0)], "method string, value double")
    assert {r.method: r.letters for r in S.compact_letters(pairs, order).collect()} == {"a": "a", "b": "ab", "c": "b"}
    assert {r.letters for r in S.compact_letters(pairs.where("not different"), order).collect()} == {"a"}


def test_gain_is_taken_for_the_whole_column(spark):
    df = table(spark, [(1, 0.5, 2.0, 1.0), (2, None, 4.0, 1.0)], "i int, g double, a double, b double")
    out = A.derive_metrics(df, {"x": ("absolute_improvement", ["g", "a", "b"])})[0].orderBy("i").collect()
    assert [r.x for r in out] == [0.5, None]
    out = A.derive_metrics(df.withColumn("g", F.lit(None).cast("double")), {"x": ("absolute_improvement", ["g", "a", "b"])})[0].orderBy("i").collect()
    assert [r.x for r in out] == [1.0, 3.0]


def test_numbers_as_texts(spark):
    from pairlane.functions.exprs import general

    values = [0.0, 1.5, -2.0, 123456.7, 1234567.0, 1e-4, 1.25e-5, 1e300, 0.1 + 0.2, 99999.96, 999999.5, -1e-10]
    got = [r.t for r in table(spark, [(i, v) for i, v in enumerate(values)], "i int, v double").select("i", general(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [f"{v:.6g}" for v in values]


def test_design_drops_the_least_covered(spark):
    rows = [(b, m, 1.0) for b in range(3) for m in "xy"] + [(0, "z", 1.0)]
    out, dropped = S.complete_design(table(spark, rows, "b int, m string, v double"), "b", "m", [])
    assert dropped == ["z"] and out.count() == 6


def test_pca_is_that_of_the_covariance(spark):
    from pairlane.operators import normalise

    x = np.random.default_rng(5).standard_normal((60, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    got = np.array([r.pca for r in normalise.pca(df, df.select("vec"), 3).orderBy("cell_id").collect()])
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3]
    want = (x - x.mean(axis=0)) @ (axes * np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]).T
    assert np.allclose(got, want, atol=1e-8)


def test_metacells_take_the_nearest_centre(spark):
    from pairlane.operators import normalise

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((20, 3)) + 20 * c for c in np.eye(3)])
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    got = {r.cell_id: r[1] for r in normalise.assign_metacells(df, 3, 1).collect()}
    assert len({got[i] for i in range(60)}) == 3 and all(len({got[i] for i in range(20 * c, 20 * c + 20)}) == 1 for c in range(3))


def test_long_files_are_streamed(spark, tmp_path):
    texts = {"a.bin": b"", "b.bin": b"x" * 50, "c.bin": bytes(range(256)) * 40_000, "d e.bin": b"y" * 11}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    want = {(name, len(content), hashlib.sha256(content).hexdigest()) for name, content in texts.items()}
    for most_bytes in (0, 20, 1 << 26):
        got = tables.file_checksums(spark, str(tmp_path), "*.bin", most_bytes)
        assert {(r.name, r.bytes, r.sha256) for r in got.collect()} == want


def test_exact_rank_tests(spark):
    """Exact p values against all sign and place choices, equal pairs, ties and larger samples."""
    import itertools
    import math
    import random

    from pairlane.operators.stats import mann_whitney, wilcoxon

    r = random.Random(12)
    pairs, want = [], {}
    for n in (1, 2, 5, 9, 12):
        d = [r.choice([-1, 1]) * (i + 1 + r.random() / 2) for i in range(n)]
        pairs += [(f"n{n}", x, 0.0) for x in d]
        place = {x: i + 1 for i, x in enumerate(sorted(d, key=abs))}
        low = min(sum(place[x] for x in d if x > 0), sum(place[x] for x in d if x < 0))
        sums = [sum(i + 1 for i in range(n) if c >> i & 1) for c in range(1 << n)]
        want[f"n{n}"] = (low, min(1.0, 2 * sum(s <= low for s in sums) / len(sums)))
    pairs += [("equal", 1.0, 1.0)] * 4 + [("none", None, 1.0)] + [("tied", 1.0, 0.0), ("tied", 2.0, 1.0), ("tied", 4.0, 1.0)] + [("zero", float(i), 0.0) for i in range(4)]
    pairs += [("large", float(i + 1), 0.0) for i in range(51)]
    got = {x.g: x for x in wilcoxon(spark.createDataFrame(pairs, "g string, x double, y double"), ["g"]).collect()}
    for g, (low, p) in want.items():
        assert got[g].exact and got[g].statistic == low and got[g].p == pytest.approx(p, abs=1e-12)
    assert (got["equal"].statistic, got["equal"].p, got["equal"].n) == (0.0, 1.0, 0) and got["none"].p is None
    assert not got["tied"].exact and not got["zero"].exact and got["zero"].n == 3 and not got["large"].exact and got["large"].p < 1e-9
    five = [("five", float(i), 0.0) for i in range(1, 6)]
    assert wilcoxon(spark.createDataFrame(five, "g string, x double, y double"), ["g"]).first().p == pytest.approx(0.0625)

    values, expect = [], {}
    for a, b in ((1, 1), (2, 5), (5, 5), (8, 3), (3, 12)):
        v = [r.random() for _ in range(a + b)]
        g = f"{a}-{b}"
        values += [(g, "x", x) for x in v[:a]] + [(g, "y", x) for x in v[a:]]
        u = sum(x > y for x in v[:a] for y in v[a:])
        low = min(u, a * b - u)
        every = [sum(c) - a * (a + 1) // 2 for c in itertools.combinations(range(1, a + b + 1), a)]
        expect[g] = (u, min(1.0, 2 * sum(x <= low for x in every) / len(every)))
    values += [("apart", "x", float(i)) for i in range(5)] + [("apart", "y", float(10 + i)) for i in range(5)]
    values += [("tie", "x", 1.0), ("tie", "y", 1.0), ("tie", "y", 2.0), ("one", "x", 1.0)] + [("many", s, float(2 * i + (s == "y"))) for i in range(9) for s in "xy"]
    out = {x.g: x for x in mann_whitney(spark.createDataFrame(values, "g string, side string, value double"), ["g"]).collect()}
    for g, (u, p) in expect.items():
        assert out[g].exact and out[g].u == u and out[g].p == pytest.approx(p, abs=1e-12)
    assert out["apart"].p == pytest.approx(2 / math.comb(10, 5)) and not out["tie"].exact and out["one"].p is None
    # the textbook correction of a half beyond the exact sizes: u 36, mean 40.5, variance 128.25
    z = (4.5 - 0.5) / math.sqrt(128.25)
    assert not out["many"].exact and out["many"].p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-9)


def matrix(spark, x, parts=4):
    return table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>").repartition(parts)


def test_axes_of_wide_rows_agree_with_the_dense_ones(spark):
    from pairlane.functions import tiles

    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 300)) @ np.diag(0.97 ** np.arange(300)) + 3
    centre, axes, variances = tiles.principal_axes(matrix(spark, x), "vec", 3, extra=4)
    _, s, want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(centre, x.mean(axis=0)) and np.allclose(variances, s[:3] ** 2 / 399)
    assert np.linalg.norm(axes @ axes.T - want[:3].T @ want[:3]) < 1e-6
    # beyond the rank, axes are 0; one row has no variance; no row has no axes
    flat = np.outer(np.arange(5.0), [1.0, 2.0, 0.0])
    assert np.allclose(tiles.principal_axes(matrix(spark, flat), "vec", 3)[1], np.outer([1, 2, 0], [1, 0, 0]) / np.sqrt(5))
    assert not tiles.principal_axes(matrix(spark, flat[:1]), "vec", 2)[1].any()
    assert tiles.principal_axes(matrix(spark, flat).limit(0), "vec", 2)[1].shape == (0, 0)


def test_tiles_add_up_to_the_product(spark, monkeypatch):
    from pairlane.functions import tiles

    monkeypatch.setattr(tiles, "SIDE", 3)
    monkeypatch.setattr(tiles, "FAN", 2)
    monkeypatch.setattr(tiles, "ROWS_BYTES", 100)
    x = np.random.default_rng(2).standard_normal((50, 8))
    n, centre = tiles.means(matrix(spark, x), "vec")
    assert n == 50 and np.allclose(centre, x.mean(axis=0))
    want = (x - centre).T @ (x - centre)
    got = tiles.gram(matrix(spark, x), "vec", centre).collect()
    assert len(got) == 36 and all(r.s == pytest.approx(want[r.p, r.q]) for r in got)


def test_metrics_on_fitted_axes(spark):
    """Controls and constructed rows on the axes of the controls' own PCA."""
    from pairlane.operators import normalise

    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 12)) @ np.diag([6, 4, 2] + [0.1] * 9)
    rows = [(0, 0, i, v.tolist()) for i, v in enumerate(x)] + [(0, 1, i, (v + 1).tolist()) for i, v in enumerate(x[::2])]
    df = table(spark, rows, "sampling_seed int, source int, cell_id long, vec array<double>")
    on = normalise.pca(df, df.where("source = 0").select("vec"), 3).withColumn("vec", F.col("pca")).drop("pca")
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3].T
    a, b = (x - x.mean(axis=0)) @ axes, (x[::2] + 1 - x.mean(axis=0)) @ axes
    flat = on.select("sampling_seed", "source", F.posexplode("vec").alias("gene", "value"))
    r = one(E.centroid_metrics(flat.where("source = 1").drop("source"), flat.where("source = 0").drop("source"), ["sampling_seed"]))
    assert r["centroid_distance"] == pytest.approx(np.linalg.norm(a.mean(axis=0) - b.mean(axis=0)))
    assert r["total_variance_ratio"] == pytest.approx(b.var(axis=0).sum() / a.var(axis=0).sum())
    both = np.concatenate([a, b])
    d2 = ((both[:, None] - both[None]) ** 2).sum(axis=2)
    upper = d2[np.triu_indices(len(both), 1)]
    k = np.exp(-d2 / np.median(upper[upper > 0]))
    want = k[:60, :60].mean() + k[60:, 60:].mean() - 2 * k[:60, 60:].mean()
    assert one(E.mmd_rbf(on, ["sampling_seed"]))["mmd2"] == pytest.approx(want)
    source = np.repeat([0, 1], [60, 30])
    np.fill_diagonal(d2, np.inf)
    share = [(source[np.argsort(row, kind="stable")[:30]] != s).mean() for row, s in zip(d2, source, strict=True)]
    assert one(E.source_mixing(on, ["sampling_seed"]))["mixing"] == pytest.approx(np.mean(share))


def test_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    from pairlane.operators import neighbors

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 5)) * 30
    x = np.concatenate([c + rng.standard_normal((40, 5)) for c in centres] + [np.tile(centres[0], (60, 1))])  # a sixth are copies
    monkeypatch.setattr(neighbors, "HELD", 2000)
    points = matrix(spark, x)
    got, work = neighbors.knn_join(points.where("cell_id % 7 = 0"), points, 5, pivots=16, part=25)
    d2 = np.zeros((len(x), len(x)))
    for i in range(5):
        d2 += (x[:, i, None] - x[None, :, i]) ** 2
    np.fill_diagonal(d2, np.inf)
    want = {(q, r + 1): int(p) for q in range(0, len(x), 7) for r, p in enumerate(np.lexsort((np.arange(len(x)), d2[q]))[:5])}
    assert {(r.query_id, r["rank"]): r.neighbor_id for r in got.collect()} == want
    w = one(work)
    assert w["pairs"] == len(range(0, len(x), 7)) * len(x) and 0 < w["compared"] < 0.35 * w["pairs"]
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    few, _ = neighbors.knn_join(points.limit(3), points.limit(3), 5)
    assert few.groupBy("query_id").count().collect()[0][1] == 2
    assert neighbors.knn_join(points, points.limit(0), 5)[0].count() == 0 and neighbors.knn_join(points.limit(0), points, 5)[0].count() == 0
    names = points.withColumn("cell_id", F.format_string("c%04d", "cell_id"))
    texts, _ = neighbors.knn_join(names.where("cell_id < 'c0030'"), names, 5)
    assert {(int(r.query_id[1:]), r["rank"], int(r.neighbor_id[1:])) for r in texts.collect() if int(r.query_id[1:]) % 7 == 0} == {(q, n, p) for (q, n), p in want.items() if q < 30}


def test_percentiles_and_numbers_of_a_hot_group(spark):
    """One group holds most rows: the same medians and numbers, and its rows lie in several ranges."""
    from pairlane.functions.exprs import numbered_by, percentiles

    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(0, 400, 901)] + [("even", float(v)) for v in range(10)] + [("one", 2.5), (None, 1.0), (None, 4.0), ("none", None), ("same", 3.0), ("same", 3.0)]
    df = table(spark, rows, "g string, v double")
    for q in (0.5, 0.25, 0.9, 0.0, 1.0):
        got = {r.g: r.m for r in percentiles(df, ["g"], "v", "m", q).collect()}
        want = {g: np.quantile([v for h, v in rows if h == g and v is not None], q) for g in ("hot", "even", "one", None, "same")}
        assert got == {g: pytest.approx(v, abs=1e-12) for g, v in want.items()}
    assert one(percentiles(df, [], "v", "m"))["m"] == np.median([v for _, v in rows if v is not None])
    assert percentiles(df.limit(0), ["g"], "v", "m").count() == 0
    keyed = df.withColumn("k", F.monotonically_increasing_id())
    out = numbered_by(keyed, ["g"], {"v": F.col("v"), "k": F.col("k")}, "n").collect()
    for g in {r.g for r in out}:
        own = sorted((r for r in out if r.g == g), key=lambda r: (r.v is not None, r.v, r.k))
        assert [r.n for r in own] == list(range(len(own)))
    spread = keyed.repartitionByRange(4, "g", "v", "k").withColumn("p", F.spark_partition_id()).where("g = 'hot'").select("p").distinct().count()
    assert spread >= 3


def test_audit_by_path_below_the_root(spark, tmp_path):
    for name, content in {"a/x.bin": b"one", "b/x.bin": b"two", "b/empty y.bin": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = table(spark, [("a/x.bin", sha(b"one").upper()), ("b/x.bin", sha(b"one")), ("b/empty y.bin", sha(b"")), ("c/x.bin", sha(b"one")), ("a/none", None)], "name string, sha256 string")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r.name: r.status for r in tables.audit_files(tables.file_checksums(spark, root), expected).collect()}
        assert got == {"a/x.bin": "reused", "b/x.bin": "mismatch", "b/empty y.bin": "reused", "c/x.bin": "missing", "a/none": "missing"}


def test_metacells_without_cells_and_with_few(spark):
    x = np.array([[0.0, 0.0]] * 5 + [[9.0, 9.0]] * 5)
    got = {r.cell_id: r.metacell_id for r in N.assign_metacells(matrix(spark, x), 4, 1).collect()}
    assert len(set(got.values())) == 2 and len({got[i] for i in range(5)}) == 1  # copies of a centre stay empty
    assert N.assign_metacells(matrix(spark, x[:2]), 5, 1).count() == 2 and N.assign_metacells(matrix(spark, x).limit(0), 3, 1).count() == 0
    y = np.random.default_rng(2).standard_normal((80, 3))
    first = {r.cell_id: r.metacell_id for r in N.assign_metacells(matrix(spark, y, 2), 6, 3).collect()}
    assert first == {r.cell_id: r.metacell_id for r in N.assign_metacells(matrix(spark, y[::-1], 5).withColumn("cell_id", 79 - F.col("cell_id")), 6, 3).collect()}


def test_multinomial_reaches_the_minimum(spark):
    """The gradient of the stated loss vanishes, whatever the partitions."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 90)
    x = rng.standard_normal((90, 4)) + 2 * np.eye(3, 4)[y]
    df = table(spark, [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "cell_id long, label_id int, vec array<double>")
    a, b = ({(r.cell_id, r["class"]): r.p for r in P2.multinomial(df.repartition(n), df, "label_id", "vec").collect()} for n in (1, 5))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6 and len(a) == 270
    p = np.array([[a[i, c] for c in range(3)] for i in range(90)])
    scaled = x / np.sqrt((x**2).sum(axis=1).mean())
    miss = (p - np.eye(3)[y]) / 90
    assert abs(miss.sum(axis=0)).max() < 1e-6  # intercepts
    # weights follow from the minimum's own condition, and give the probabilities back up to the intercepts
    w = -scaled.T @ miss / 0.02
    z = scaled @ w
    shift = np.log(p) - z
    shift -= shift.mean(axis=1, keepdims=True)
    assert np.ptp(shift, axis=0).max() < 1e-4
    assert (p.argmax(axis=1) == y).mean() > 0.8


def test_designs_drop_as_one_by_one(spark):
    """Against dropping the least covered method again and again."""
    import random

    r = random.Random(5)
    for forced in ([], ["m3"], ["m0", "m5"]):
        for _ in range(6):
            rows = [(b, f"m{m}", 1.0) for b in range(7) for m in range(6) if r.random() < 0.75]
            have = {b: {m for c, m, _ in rows if c == b} for b in {x[0] for x in rows}}
            names, want = {m for _, m, _ in rows}, []
            while True:
                left = names - set(want)
                full = [b for b, s in have.items() if left and s & left == left]
                if len(full) >= 2:
                    break
                free = [m for m in left if m not in forced]
                if not free:
                    want = None
                    break
                want.append(min(free, key=lambda m: (sum(m in s for s in have.values()), [-ord(c) for c in m])))
            df = table(spark, rows, "b int, m string, v double")
            if want is None:
                with pytest.raises(ValueError):
                    S.complete_design(df, "b", "m", forced)
            else:
                out, dropped = S.complete_design(df, "b", "m", forced)
                assert dropped == want and out.count() == len(full) * len(names - set(want))


def test_upserts_of_equal_versions(spark):
    old = table(spark, [("a", 1, "old"), ("b", 2, "old")], "k string, v int, x string")
    new = table(spark, [("a", 1, "new"), ("a", 1, "newer"), ("b", 1, "new")], "k string, v int, x string")
    for n in (1, 3):
        assert sorted((r.k, r.x) for r in M.upsert_latest(old.repartition(n), new.repartition(n), ["k"], "v").collect()) == [("a", "newer"), ("b", "old")]


def test_critical_ranges_are_those_of_the_tables():
    q = {k: S.range_quantile(k, 0.05) / math.sqrt(2) for k in (2, 3, 5, 10, 20)}
    assert {k: round(v, 3) for k, v in q.items()} == {2: 1.960, 3: 2.344, 5: 2.728, 10: 3.164, 20: 3.544}
    assert S.range_quantile(5, 0.1) / math.sqrt(2) == pytest.approx(2.459, abs=1e-3) and round(S.range_quantile(3, 0.01), 2) == 4.12
