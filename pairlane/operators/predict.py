"""Splits, features and scoring of prediction tables; any model's predictions can be scored."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlane.functions.exprs import draw, numbered_by, percentiles, place, value_ranks
from pairlane.functions.storage import checkpointed, discard, saved
from pairlane.operators.evaluate import effect_similarity, effect_topk, row_cosine, row_pearson


def label_encode(rows: DataFrame, label: str, least: int) -> DataFrame:
    """Labels with at least ``least`` rows get ids by name from 0; all others -1."""
    good = rows.groupBy(label).count().where(F.col("count") >= least).select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("label_id"))
    return rows.join(good, label, "left").withColumn("label_id", F.coalesce("label_id", F.lit(-1)))


def stratified_split(rows: DataFrame, label: str, key: str, seed: int, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Seeded split of each label: floors of the shares, at least one row each; labels below three rows are left out."""
    size = rows.groupBy(label).agg(F.count("*").alias("_n")).where("_n >= 3")
    n_valid = F.greatest(F.floor(F.col("_n") * valid), F.lit(1))
    n_test = F.greatest(F.col("_n") - F.greatest(F.floor(F.col("_n") * train), F.lit(1)) - n_valid, F.lit(1))
    cut = F.col("_n") - n_valid - n_test
    part = F.when(F.col("_i") <= cut, "train").when(F.col("_i") <= cut + n_valid, "valid").otherwise("test")
    placed = numbered_by(rows, [label], {"draw": draw("split", seed, F.col(key)), "key": F.col(key)}, "_nth").withColumn("_i", F.col("_nth") + 1).drop("_nth")
    return placed.join(size, label).withColumn("split", part).drop("_i", "_n")


def multinomial(train: DataFrame, test: DataFrame, label: str, vec: str, key: str = "cell_id", ridge: float = 0.02) -> DataFrame:
    """(key, y_true, class, p) of the test rows under a multinomial logistic model of the training rows.

    The loss is the mean cross entropy plus half the ridge times the squared weights, intercepts left out, over
    vectors scaled so that their mean squared norm in training is 1. It has one minimum, which does not
    depend on partitions or seeds: gradients are summed over the rows in tasks and meet in a tree, round
    after round, until it is reached. Labels are 0, 1, ...; the classes are those up to the largest label of training.
    """
    norm = train.agg(F.avg(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)).alias("_norm"))
    scaled = lambda df: df.crossJoin(F.broadcast(norm)).select(key, F.col(label).cast("double").alias("_y"), array_to_vector(F.transform(vec, lambda x: x / F.sqrt(F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0)))).alias("_x"))  # noqa: E731  one row
    ready = saved(scaled(train))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", family="multinomial", regParam=ridge, standardization=False, maxIter=1000, tol=1e-10).fit(ready)
    discard(ready)
    return model.transform(scaled(test)).select(key, F.col("_y").cast("int").alias("y_true"), F.posexplode(vector_to_array("_p")).alias("class", "p"))


def delta_features(pairs: DataFrame, control_mean: DataFrame) -> DataFrame:
    """(keys, gene, x0, xt) with the strategy delta xt - x0 and the common delta xt - control mean."""
    return pairs.join(control_mean, "gene").withColumn("strategy_delta", F.col("xt") - F.col("x0")).withColumn("common_delta", F.col("xt") - F.col("control_mean"))


#: The row-wise agreements of a prediction: name, left side, right side, measure.
ROWWISE = [
    ("model_cell_pearson_xt", "pred", "xt", "pearson"), ("input_cell_pearson_xt", "x0", "xt", "pearson"), ("model_cell_cosine_xt", "pred", "xt", "cosine"), ("input_cell_cosine_xt", "x0", "xt", "cosine"),
    ("strategy_delta_cell_pearson", "pred - x0", "xt - x0", "pearson"), ("strategy_delta_cell_cosine", "pred - x0", "xt - x0", "cosine"),
    ("model_common_delta_cell_pearson", "pred - control_mean", "xt - control_mean", "pearson"), ("input_common_delta_cell_pearson", "x0 - control_mean", "xt - control_mean", "pearson"),
]


def forward_metrics(pred: DataFrame, by: list[str], key: str = "cell_id") -> DataFrame:
    """Errors of a prediction of xt, of the input alone and of the deltas, the gains, and five statistics of each row-wise agreement.

    Long rows (by, key, gene, x0, xt, pred, control_mean).
    """
    e, i = F.col("pred") - F.col("xt"), F.col("x0") - F.col("xt")
    d = (F.col("pred") - F.col("x0")) - (F.col("xt") - F.col("x0"))
    means = {"model_mse_xt": e * e, "model_mae_xt": F.abs(e), "input_only_mse_xt": i * i, "input_only_mae_xt": F.abs(i), "strategy_specific_delta_mse": d * d, "strategy_specific_delta_mae": F.abs(d)}
    out = pred.groupBy(*by).agg(*[F.avg(x).alias(n) for n, x in means.items()])
    out = out.withColumn("model_gain_mse_xt", F.col("input_only_mse_xt") - F.col("model_mse_xt")).withColumn("model_gain_mae_xt", F.col("input_only_mae_xt") - F.col("model_mae_xt"))
    out = out.withColumn("model_gain_mse_xt_fraction", F.col("model_gain_mse_xt") / (F.col("input_only_mse_xt") + 1e-12))
    measure = {"pearson": row_pearson, "cosine": row_cosine}
    rows = pred.groupBy(*by, key).agg(*[measure[m](F.expr(x), F.expr(y)).alias(n) for n, x, y, m in ROWWISE])
    rows = checkpointed(rows)
    stats = [f(F.col(n)).alias(f"{n}_{s}") for n, *_ in ROWWISE for s, f in SUMMARY.items()]
    names = [n for n, *_ in ROWWISE]
    middle = percentiles(rows.unpivot(by, names, "_metric", "_value"), [*by, "_metric"], "_value", "_median")
    wide = middle.groupBy(*by).agg(*[F.max(F.when(F.col("_metric") == n, F.col("_median"))).alias(f"{n}_median") for n in names])
    out = out.join(rows.groupBy(*by).agg(*stats), by).join(wide, by, "left")
    return out.select(*by, *[c for c in out.columns if c not in by and not c.endswith("_median") and not any(c.startswith(n) for n in names)], *[f"{n}_{s}" for n in names for s in ("mean", "median", "std", "sem", "n_valid")])


SUMMARY = {"mean": F.avg, "std": F.stddev_pop, "sem": lambda x: F.stddev_pop(x) / F.sqrt(F.count(x)), "n_valid": F.count}


def forward_per_perturbation(pred: DataFrame, by: list[str], ks: list[int], label: str = "perturbation", key: str = "cell_id") -> DataFrame:
    """Agreement of the predicted and true mean common deltas of each perturbation, over all genes and the k with the largest true ones."""
    keys = [*by, label]
    mean = pred.groupBy(*keys, "gene").agg(F.avg(F.col("pred") - F.col("control_mean")).alias("strategy_delta"), F.avg(F.col("xt") - F.col("control_mean")).alias("common_delta"))
    whole = effect_similarity(mean, keys).select(*keys, *[F.col(c).alias(f"common_delta_{n}") for c, n in (("pearson", "pearson"), ("spearman", "spearman"), ("cosine", "cosine"), ("rmse", "l2"))])
    out = pred.groupBy(*keys).agg(F.count_distinct(key).alias("n_test_cells")).join(whole, keys)
    for k in ks:
        top = effect_topk(mean, keys, k)
        out = out.join(top.select(*keys, F.col("pearson").alias(f"top{k}_common_delta_pearson"), F.col("cosine").alias(f"top{k}_common_delta_cosine"), F.col("overlap").alias(f"top{k}_common_delta_overlap")), keys)
    return out


def forward_report(pred: DataFrame, by: list[str], ks: list[int], label: str = "perturbation") -> DataFrame:
    """``forward_metrics`` with the mean and median over perturbations of ``forward_per_perturbation``."""
    per = forward_per_perturbation(pred, by, ks, label)
    names = [c for c in per.columns if c not in (*by, label, "n_test_cells")]
    # one row a perturbation here
    stats = [x for c in names for x in (F.avg(c).alias(f"per_perturbation_{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"per_perturbation_{c}_median"))]
    return forward_metrics(pred, by).join(per.groupBy(*by).agg(*stats, F.count("*").alias("n_perturbations_evaluated")), by)


def forward_baseline(train: DataFrame, test: DataFrame, by: list[str], label: str = "perturbation") -> DataFrame:
    """Prediction = input + mean training change of the label and gene. A plain stand-in for a trained network."""
    change = train.groupBy(*by, label, "gene").agg(F.avg(F.col("xt") - F.col("x0")).alias("_d"))
    return test.join(change, [*by, label, "gene"]).withColumn("pred", F.col("x0") + F.col("_d")).drop("_d")


def confusion(pred: DataFrame, by: list[str]) -> DataFrame:
    return pred.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def per_class(pred: DataFrame, by: list[str]) -> DataFrame:
    """Support, precision, recall and F1 of every label that is true or predicted somewhere; divisions by 0 give 0."""
    counts = confusion(pred, by)
    a = counts.groupBy(*by, F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    b = counts.groupBy(*by, F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = a.join(b, [*by, "label"], "full").fillna(0, ["support", "hit", "predicted"])
    p, r = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    both = both.withColumn("precision", p).withColumn("recall", r)
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def classification_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy over the classes present, macro and weighted precision, recall and F1."""
    c = per_class(pred, by)
    w = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    return c.groupBy(*by).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), w("precision").alias("weighted_precision"), w("recall").alias("weighted_recall"), w("f1").alias("weighted_f1"),
    )


def log_loss(prob: DataFrame, by: list[str], eps: float = 1e-15) -> DataFrame:
    """Cross entropy of long probabilities (y_true, class, p)."""
    own = prob.where(F.col("class") == F.col("y_true"))
    return own.groupBy(*by).agg(F.avg(-F.ln(F.least(F.greatest("p", F.lit(eps)), F.lit(1 - eps)))).alias("log_loss"))


def topk_accuracy(prob: DataFrame, by: list[str], ks: list[int], key: str = "cell_id") -> DataFrame:
    """Share of rows whose class is among the k most likely (ties by class); k above the number of classes is left out."""
    ranked = prob.withColumn("_r", place([*by, key], F.desc("p"), "class"))
    own = ranked.where(F.col("class") == F.col("y_true"))
    n = prob.groupBy(*by).agg(F.count_distinct("class").alias("_n"))
    joined = own.join(n, by) if by else own.crossJoin(F.broadcast(n))  # one row without groups
    hits = joined.select(*by, "_r", "_n", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("k <= _n")
    return hits.groupBy(*by, "k").agg(F.avg(F.when(F.col("_r") <= F.col("k"), 1.0).otherwise(0.0)).alias("topk_accuracy"))


def auc_per_class(prob: DataFrame, by: list[str]) -> DataFrame:
    """One-against-rest AUC of each class by rank sums with mean ranks of ties; NULL if a side is empty."""
    ranked = value_ranks(prob, [*by, "class"], "p", "_r").withColumn("_y", (F.col("class") == F.col("y_true")).cast("long"))
    s = ranked.groupBy(*by, "class").agg(F.sum(F.col("_r") * F.col("_y")).alias("_rs"), F.sum("_y").alias("support"), F.count("*").alias("_n"))
    neg = F.col("_n") - F.col("support")
    auc = F.try_divide(F.col("_rs") - F.col("support") * (F.col("support") + 1) / 2.0, F.col("support") * neg)
    return s.select(*by, "class", "support", auc.alias("auc"))


def auc_ovr(prob: DataFrame, by: list[str]) -> DataFrame:
    """Macro and support-weighted AUC over valid classes, and how many are valid."""
    c = auc_per_class(prob, by)
    weight = F.when(F.col("auc").isNotNull(), F.col("support"))
    return c.groupBy(*by).agg(F.avg("auc").alias("macro_auc"), (F.sum(F.col("auc") * weight) / F.sum(weight)).alias("weighted_auc"), F.count("auc").alias("n_valid"), F.count("*").alias("n_classes"))


def softmax_distance(rows: DataFrame, centres: DataFrame, by: list[str]) -> DataFrame:
    """Class probabilities: softmax over minus the distance to each class centre (a bounded table)."""
    from pairlane.functions.exprs import distance2

    pairs = rows.join(F.broadcast(centres.select(F.col("label").alias("class"), F.col("vec").alias("_c"))))
    d = pairs.withColumn("_d", -F.sqrt(distance2(F.col("vec"), F.col("_c")))).drop("_c", "vec")
    w = Window.partitionBy(*by, "cell_id")
    return d.withColumn("p", F.exp(F.col("_d") - F.max("_d").over(w))).withColumn("p", F.col("p") / F.sum("p").over(w)).drop("_d")


def chance_baseline(df: DataFrame, by: list[str], candidates: list[str]) -> DataFrame:
    """1 / C: C is the median of the positive values of the first candidate column that has any in the group."""
    positive = lambda c: F.percentile(F.when(F.col(c) > 0, F.col(c).cast("double")), F.lit(0.5))
    classes = F.coalesce(*[positive(c) for c in candidates if c in df.columns])
    return df.groupBy(*by).agg(classes.alias("n_classes")).where("n_classes is not null").withColumn("accuracy_baseline", 1.0 / F.col("n_classes"))


def representation_targets(pairs: DataFrame, control: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Mean common delta (row minus mean control vector) of each group in a representation; vectors of another dimension raise an error."""
    from pairlane.operators.pairing import mean_profile

    same = pairs.crossJoin(F.broadcast(mean_profile(control, vec).withColumnRenamed("profile", "_c")))  # one row
    checked = F.when(F.size(vec) == F.size("_c"), F.zip_with(vec, "_c", lambda x, c: x.cast("double") - c)).otherwise(F.raise_error(F.lit("representations differ in dimension")).cast("array<double>"))
    return same.select(*by, F.posexplode(checked).alias("dimension", "x")).groupBy(*by, "dimension").agg(F.count("*").alias("n"), F.avg("x").alias("target"))


def inverse_report(prob: DataFrame, ks: list[int]) -> DataFrame:
    """Every summary of a classifier's long probabilities (cell_id, y_true, class, p) in one row."""
    pred = prob.withColumn("_n", place(["cell_id"], F.desc("p"), "class")).where("_n = 1").select("cell_id", "y_true", F.col("class").alias("y_pred"))
    top = topk_accuracy(prob, [], ks).agg(*[F.max(F.when(F.col("k") == k, F.col("topk_accuracy"))).alias(f"top{k}_accuracy") for k in ks])
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [classification_metrics(pred, []), log_loss(prob, []), top, auc_ovr(prob, [])])  # one row each
