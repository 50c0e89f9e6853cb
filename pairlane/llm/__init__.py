"""Operators of a training-data pipeline; nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("mixing", "sharding", "chunk_dedup", "chat_format", "ngram_join", "line_dedup", "toxicity", "repetition", "packing", "byte_quality", "phrase_automata", "tokenizer_alignment", "resampling")


def _modules():
    return [importlib.import_module(f"pairlane.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
