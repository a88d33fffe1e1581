"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["survivor_queries", "name_queries", "lookalike_queries", "grouping_queries", "linkage_queries", "corpus_queries", "language_queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"quillspark.llm.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"quillspark.llm.{m}").ORACLES.items()}
