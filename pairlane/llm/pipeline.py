"""The stages of the corpus pipeline: toxicity, line dedup, near-duplicate join, source mixing, packing.

Each stage works on all rows of ``docs`` and decides by its operator's own interface. All but
the last return the columns of ``docs``, whatever others it has beside doc_id, text, lang,
source and n_chars. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm.common import named, read, word_count
from pairlane.llm.line_dedup import dedup_lines
from pairlane.llm.mixing import mix_sources
from pairlane.llm.ngram_join import near_duplicates
from pairlane.llm.packing import pack
from pairlane.llm.toxicity import fit_toxicity, flag_toxic


def _whole(docs: DataFrame):
    """All columns as one struct, so that no operator's column can clash with them."""
    return F.struct(*map(named, docs.columns)).alias("row")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score reaches the threshold of their language. NULL text is scored as the empty text."""
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    judged = flag_toxic(docs.select(_whole(docs), "text", "lang"), model)
    return judged.where(~F.col("toxic")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated line runs in their full length; every document stays with what is left of it (NULL text stays NULL)."""
    rest = F.struct(*[named(c) for c in docs.columns if c not in ("doc_id", "text")]).alias("row")
    out = dedup_lines(docs.select("doc_id", "text", rest))
    chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[F.col(c) if c in ("doc_id", "text") else chars.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id (NULL last), then text digest.

    A document is its id and text together, so rows that share an id, or have none, are
    decided one text at a time. Texts without words are no duplicates of each other.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")).alias("own")
    linked = near_duplicates(docs.select(own, "text"), key="own").where("n_links > 0")
    gone = linked.where("own <> class_id").select("own").distinct()
    # repeated rows of the document that stays are copies of one another: one of them stays
    twice = linked.where("own = class_id").groupBy("own").count().where("count > 1").select("own")
    rows = docs.select(_whole(docs), own)
    rest = rows.join(gone.union(twice).distinct(), "own", "left_anti").select("row.*")
    again = rows.join(twice, "own", "left_semi").groupBy("own").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row")).select("row.*")
    return rest.unionByName(again)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; NULL text has size 0, and NULL is a source of its own."""
    mixed = mix_sources(docs.select(_whole(docs), "doc_id", "source", word_count(F.col("text")).alias("size"))).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences; NULL text is empty: one end id."""
    return pack(docs.select("doc_id", "text"))
