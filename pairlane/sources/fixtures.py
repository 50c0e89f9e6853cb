"""Experiment tables derived from the driver's tables, in Spark and as DuckDB SQL.

``Tables`` gives each view as a lazy DataFrame; ``cte`` gives the same views as a WITH clause.
Views grow with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Views whose SQL runs unchanged in Spark and DuckDB; {name} stands for a table or view.
SHARED = {
    "cell": "select vec_id as cell_id, case when label = 0 then 'control' else concat('p', cast(label as varchar(8))) end as perturbation, "
    "case when label = 0 then 'control' else 'single' end as analysis_group, label, embedding as vec from {embeddings}",
    "counts": "select l.l_orderkey as cell_id, p.p_brand as gene, cast(sum(l.l_quantity) as double) as value from {lineitem} l join {part} p on l.l_partkey = p.p_partkey group by l.l_orderkey, p.p_brand",
    "obs": "select o_orderkey as cell_id, cast(o_orderkey % 4 as int) as nperts, o_orderpriority as target, o_orderstatus as batch from {orders}",
    "var": "select p_brand as gene, row_number() over (order by p_brand) - 1 as gene_pos, concat(' ENSG', substr(p_brand, 7), '.', cast(max(p_size) as varchar(8))) as ensembl_id from {part} group by p_brand",
    "membership": "select vec_id as cell_id, concat('mc_', cast(vec_id % 12 as varchar(8))) as metacell_id from {embeddings} where label = 0",
    "run": "select event_id as run_no, case event_type when 'signup' then 'S1' when 'error' then 'S2' when 'click' then 'S3_random_metacell_average' when 'view' then 'strategy1_seacell_balanced_random_repeated' else 'S5' end as strategy, "
    "cast(user_id % 5 as int) as sampling_seed, case when event_type in ('click', 'view', 'purchase') and event_id % 2 = 0 then cast(50 * (1 + user_id % 3) as double) end as n_metacells_requested, "
    "concat('nmc_', cast(50 * (1 + user_id % 3) as varchar(8)), '__k_', cast(3 + event_id % 2 as varchar(8)), '__topk_', cast(1 + 2 * (event_id % 3) as varchar(8))) as parameter_label, "
    "value as input_only_mse_xt, value * 0.8 + cast(event_id % 7 as double) / 10 as model_mse_xt from {events}",
}
#: Views that each engine writes in its own way.
DUCK = {
    "expr": "select cell_id, perturbation, analysis_group, concat('g', lpad(cast(gene_pos as varchar), 3, '0')) as gene, gene_pos, value from "
    "(select cell_id, perturbation, analysis_group, unnest(vec)::DOUBLE as value, generate_subscripts(vec, 1) - 1 as gene_pos from cell)",
    "control": "select cell_id, vec, row_number() over (order by cell_id) - 1 as control_pos from cell where analysis_group = 'control'",
    "treated": "select cell_id, perturbation, vec, row_number() over (order by cell_id) - 1 as pos from cell where analysis_group <> 'control'",
}
NEEDS = {"expr": ("cell",), "control": ("cell",), "treated": ("cell",)}


def cte(*names: str, recursive: bool = False) -> str:
    """WITH clause of the views ``names`` and what they need."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        sql = DUCK.get(name) or SHARED[name]
        for table in ("embeddings", "lineitem", "part", "orders", "events"):
            sql = sql.replace("{" + table + "}", table)
        out[name] = f"{name} AS ({sql})"

    for name in names:
        add(name)
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(out.values())


class Tables:
    """The driver's tables, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = SHARED[name]
        used = {t: self.read(t) for t in ("embeddings", "lineitem", "part", "orders", "events") if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)

    def cell(self) -> DataFrame:
        return self.view("cell")

    def expr(self) -> DataFrame:
        long = self.cell().select("cell_id", "perturbation", "analysis_group", F.posexplode("vec").alias("gene_pos", "value"))
        return long.select("cell_id", "perturbation", "analysis_group", F.format_string("g%03d", "gene_pos").alias("gene"), "gene_pos", F.col("value").cast("double").alias("value"))

    def control(self) -> DataFrame:
        """Controls, numbered by id."""
        from pairlane.functions.exprs import numbered

        return numbered(self.cell().where("analysis_group = 'control'").select("cell_id", "vec"), ["cell_id"], "control_pos")

    def treated(self) -> DataFrame:
        return self.cell().where("analysis_group <> 'control'").select("cell_id", "perturbation", "vec")

    def numbered_treated(self) -> DataFrame:
        """Treated cells, numbered by id."""
        from pairlane.functions.exprs import numbered

        return numbered(self.treated(), ["cell_id"], "pos")
