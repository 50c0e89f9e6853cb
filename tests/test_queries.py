"""Every registered query with SQL gives DuckDB's rows."""

import pytest

from pyspark.sql import functions as F

from pairlane import plans
from tests.helpers import connect, same

SF = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    same(plans.queries()[name], SQL[name], spark, SF, duck)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert plans.queries()[name](spark, SF).limit(5).count() > 0


@pytest.mark.parametrize("types", [["click", "view", "purchase", "signup", "error"], ["click", "view", "error"], ["click", "view"]])
def test_kruskal_of_tied_seed_means(spark, tmp_path, types):
    """Each event is in every seed once, so that the five means of a method differ in their last bits at most."""
    events = spark.read.parquet(f"{SF}/events.parquet").where(F.col("event_type").isin(types))
    copies = events.crossJoin(spark.range(5).select(F.col("id").alias("i"))).orderBy(F.col("event_id") * 7919 % 1009, "i")
    copies = copies.withColumns({"event_id": F.col("event_id") + F.col("i") * 7_000_000, "user_id": F.col("user_id") + F.col("i")}).drop("i")
    copies.coalesce(1).write.parquet(str(tmp_path / "copies"))
    [part] = (tmp_path / "copies").glob("*.parquet")
    part.rename(tmp_path / "events.parquet")
    same(plans.queries()["kruskal"], SQL["kruskal"], spark, str(tmp_path))
