"""Corpus pipeline: toxicity, line dedup, near-duplicate join, source mixing, packing.

The calling code writes a stage's rows and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlane.llm.common import discard, read, saved
from pairlane.llm.pipeline import line_dedup, mixing, ngram_join, packing, toxicity

STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram join", ngram_join), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder in between."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model and a tokenizer decide what run() returns, so SQL cannot express it.
ORACLE_SQL = None
