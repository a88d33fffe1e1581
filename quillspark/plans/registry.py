"""Collects the queries of all plan modules and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["integrity", "records", "fusion", "network", "flows", "people", "exchange", "storage", "collecting", "details"]

Query = Callable[[SparkSession, str], DataFrame]


def core_queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in import_module(f"quillspark.plans.{m}").QUERIES.items()}


def core_oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"quillspark.plans.{m}").ORACLES.items()}
