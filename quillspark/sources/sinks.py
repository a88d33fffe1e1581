"""Exports and read-back of CSV, JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.text import formula_safe, list_cell


def flat(rows: DataFrame, excel_safe: bool = False) -> DataFrame:
    """Nested columns as compact JSON text, so any table fits a CSV; ``excel_safe`` guards cells that look like formulas."""
    out = []
    for c, kind in rows.dtypes:
        cell = F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")
        out.append((formula_safe(cell) if excel_safe else cell).alias(c))
    return rows.select(*out)


def export(rows: DataFrame, path: str, form: str = "parquet", excel_safe: bool = False, order: str | None = None) -> None:
    """Writes a folder of files: parquet, json or csv. ``order`` sorts by a range shuffle, so files follow each other."""
    if order:
        rows = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    if form == "csv":
        flat(rows, excel_safe).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    elif form == "json":
        rows.write.mode("overwrite").json(path)
    elif form == "parquet":
        rows.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown form {form}")


def read_csv(spark: SparkSession, path: str, required: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with header, all text; rows without any value are dropped, ``lists`` are split at semicolons."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = rows.where(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in rows.columns]).isNotNull())
    return rows.withColumns({c: F.coalesce(list_cell(F.col(c)), F.array().cast("array<string>")) for c in lists}) if lists else rows


def work_lines(spark: SparkSession, path: str) -> DataFrame:
    """Work rows of (gzipped) JSON lines; a broken line fails the read."""
    kinds = "id string, title string, publication_year int, doi string, cited_by_count bigint, referenced_works array<string>"
    return spark.read.schema(kinds).option("mode", "FAILFAST").json(path)
