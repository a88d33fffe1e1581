"""Queries on look-alike text in titles, venues and bylines (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.lookalike import normalise_values
from quillspark.sources.tables import table


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(
        F.coalesce(F.col("authors"), F.array()),
        lambda a: F.struct(F.lit("name").alias("field"), a["position"].alias("position"), a["name"].alias("value"), F.lit(True).alias("is_name")),
    )
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(0).alias("position"), F.col(f).alias("value"), F.lit(False).alias("is_name")) for f in ("title", "venue")])
    rows = table(spark, sf_dir, "papers").select("ord", F.explode(F.concat(texts, names)).alias("v")).select("ord", "v.*")
    return normalise_values(rows.where(F.col("value").isNotNull()), "value", "is_name")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title, venue and byline name that isn't written in the plain characters it shows."""
    return _values(spark, sf_dir).where("altered").select("ord", "field", "position")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title, venue and byline name in the one form that compares equal."""
    return _values(spark, sf_dir).select("ord", "field", "position", "plain", "comparison")


QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms}
ORACLES: dict[str, str] = {}
