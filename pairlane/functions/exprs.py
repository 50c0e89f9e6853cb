"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: object) -> Column:
    """Seeded hash of the parts: 60 uniform bits, never negative, the same in every engine with md5."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw_sql(*parts: str) -> str:
    """DuckDB SQL of ``draw``."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def r6(x: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation as an aggregate; NULL below ``least`` pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(F.when(both, 1)) >= least) & (spread > 0), F.try_divide(F.covar_pop(a, b), spread))


def cosine(x: Column, y: Column, least: int = 3) -> Column:
    """Cosine as an aggregate, with the guards of ``pearson``."""
    both = x.isNotNull() & y.isNotNull()
    norm = F.sqrt(F.sum(F.when(both, x * x)) * F.sum(F.when(both, y * y)))
    return F.when((F.count(F.when(both, 1)) >= least) & (norm > 0), F.try_divide(F.sum(F.when(both, x * y)), norm))


def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(F.avg((x - y) * (x - y)))


def tie_rank(by: list[str], value: Column, descending: bool = False) -> Column:
    """Rank from 1 within ``by``; equal values share the mean of their places."""
    order = value.desc() if descending else value.asc()
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def value_ranks(df: DataFrame, by: list[str], value: str, name: str, stored: bool = False) -> DataFrame:
    """``tie_rank`` for groups of any size, as column ``name``: rows are counted by value, and the counts are range-partitioned and summed.

    Rows find their rank by their value, so they are stored before they are counted: a mean that is computed twice may add up in
    another order, and a row whose last bit differs then would find none. ``stored``: the rows come from stored tables already.
    """
    from pairlane.functions.storage import checkpointed, saved

    df = df if stored else saved(df)
    keys = [*by, value]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_c")).repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id())
    counts = checkpointed(counts)
    group = by or [F.lit(0)]
    sums = counts.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.join(sums, [*by, "_range"]).select(*keys, (F.col("_before") + upto - (F.col("_c") - 1) / 2.0).alias(name), F.col("_c").alias(f"{name}_ties"))
    return df.join(ranks, keys)


def place(by: list[str], *order: object) -> Column:
    """Row number from 1 within ``by``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add gapless numbers from 0 in the order of ``order`` (unique, not NULL) without one task seeing all rows.

    Rows are range-partitioned and sorted; the few partition counts give each partition its
    first number.
    """
    from pairlane.functions.storage import checkpointed

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    firsts = ranged.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = ranged.join(firsts, "_range").withColumn(name, F.col("_first") + within - 1)
    return out.drop("_range", "_first")


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be NULL, which count as equal then."""
    right = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(right, on).drop(*[f"_k_{k}" for k in keys])


def numbered_by(df: DataFrame, by: list[str], order: dict[str, Column], name: str) -> DataFrame:
    """Add gapless numbers from 0 within each group of ``by`` in the given (unique) order, for groups of any size.

    Rows are range-partitioned by group and order, so a group that holds half of all rows is spread over
    as many tasks; the counts by group and partition give each part of a group its first number.
    """
    from pairlane.functions.storage import saved

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({f"_o_{k}": c for k, c in order.items()})
    sort = [f"_o_{k}" for k in order]
    ranged = saved(keyed.repartitionByRange(parts, *by, *sort).withColumn("_range", F.spark_partition_id()))
    firsts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    firsts = firsts.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*sort))
    return _matched(ranged, firsts, [*by, "_range"]).withColumn(name, (F.col("_first") + within - 1).cast("long")).drop("_range", "_first", *sort)


def percentiles(df: DataFrame, by: list[str], value: str, name: str, q: float = 0.5) -> DataFrame:
    """(by, name): the exact ``q`` percentile of the values that are not NULL, between two values by linear interpolation.

    No task holds a group's values: rows are counted by value (combined before the shuffle), the counts are range-partitioned and
    summed, and only the one or two values at the wanted place are taken.
    """
    from pairlane.functions.storage import checkpointed

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    counts = checkpointed(counts.repartitionByRange(parts, *by, value).withColumn("_range", F.spark_partition_id()))
    sums = counts.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.sum("_s").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    at = (F.sum("_s").over(group) - 1) * F.lit(q)
    sums = sums.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"), at.alias("_at"), "_s")
    # only the ranges that hold the place
    sums = sums.where((F.col("_before") <= F.ceil("_at")) & (F.col("_before") + F.col("_s") > F.floor("_at"))).drop("_s")
    near = _matched(counts, sums, [*by, "_range"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_upto", upto)
    holds = lambda place: (F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto"))
    low, high = (F.max(F.when(holds(p), F.col(value))) for p in (F.floor("_at"), F.ceil("_at")))
    found = near.groupBy(*by).agg(low.alias("_low"), high.alias("_high"), F.first("_at").alias("_at"))
    share = F.col("_at") - F.floor("_at")
    return found.select(*by, F.when(share == 0, F.col("_low").cast("double")).otherwise((1 - share) * F.col("_low") + share * F.col("_high")).alias(name))


def is_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def nan_to_null(x: Column) -> Column:
    """NaN means missing in metric tables."""
    return F.when(~F.isnan(x), x)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two numeric arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def general(x: Column, digits: int = 6) -> Column:
    """A number with ``digits`` significant digits and no trailing zeros, as the format ``%g`` has it; a tie is that of the shortest decimal form."""
    text = F.format_string(f"%.{digits - 1}e", F.abs(x.cast("double")))
    power = F.element_at(F.split(text, "e"), -1).try_cast("int")
    ds = F.replace(F.element_at(F.split(text, "e"), 1), F.lit("."), F.lit(""))
    trim = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0*$", "")).otherwise(t)
    whole = F.concat(F.substr(ds, F.lit(1), power + 1), F.lit("."), F.substr(ds, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), ds)
    science = F.concat(trim(F.concat(F.substring(ds, 1, 1), F.lit("."), F.substr(ds, F.lit(2)))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    body = F.when((power < -4) | (power >= digits), science).when(power >= 0, trim(whole)).otherwise(trim(small))
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), body))


def int_like(x: Column) -> Column:
    """``50.0`` as ``50``; other numbers with six significant digits; NULL stays NULL."""
    return F.when(F.abs(x - F.round(x)) < 1e-8, F.round(x).cast("bigint").cast("string")).otherwise(general(x.cast("double")))


def safe_id(x: Column, most: int = 180) -> Column:
    """Characters outside ``[A-Za-z0-9_.=+-]`` become ``_``; runs of it are squeezed, ends stripped, the rest cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_.=+\-]", "_"), "_+", "_"), "^_+|_+$", ""), 1, most)


def as_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("true", "1", "yes", "y", "t"), F.lit(False))


def null_token(x: Column) -> Column:
    """Texts that stand for a missing value become NULL."""
    return F.when(~F.lower(F.trim(x)).isin("", "nan", "none", "null", "na"), x)
