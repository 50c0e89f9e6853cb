"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlane.functions.storage import checkpointed as cut
from pairlane.functions.storage import discard, saved

__all__ = ["WORD", "cut", "discard", "named", "others", "ranged", "read", "running", "saved", "seeded_digest", "word_count"]

#: The white space of every text contract here: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(column: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those called like ``names`` (in either case, unless Spark tells cases apart)."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    fold = (lambda x: x) if exact else str.lower
    taken = {fold(n) for n in names}
    return [c for c in df.columns if fold(c) not in taken]


def ranged(df: DataFrame, order: list[str], part: str = "_part") -> DataFrame:
    """``df`` range-partitioned by ``order`` and written once, with its partition number: a bucket for ``running``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))


def word_count(text: Column) -> Column:
    """Words of a text; NULL and white space only give 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_digest(seed: object, *parts: Column) -> Column:
    """Hex md5 of the seed and the parts (NULL counts as empty): an order that reruns repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def running(df: DataFrame, by: list[str], bucket: str, order: list[str], size: Column, total: str) -> DataFrame:
    """``total``: the sum of ``size`` over a row and all rows of its group before it.

    The order of a group is ``bucket`` and then ``order``. A group may hold any share
    of the table: its sum is first taken by bucket (with map-side combine), the few
    bucket sums are accumulated, and only rows of one bucket meet in one task.
    """
    sums = df.groupBy(*by, bucket).agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    keys = [*by, bucket]
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], "_before")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = match[0]  # never empty: the bucket is always among the keys
    for m in match[1:]:
        on = on & m
    joined = df.join(sums, on).drop(*[f"_{k}" for k in keys])
    return joined.withColumn(total, F.col("_before") + F.sum(size).over(within)).drop("_before")
