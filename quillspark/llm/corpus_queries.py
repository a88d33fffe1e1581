"""Queries that pack and mix documents (problems 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.mixing import mixture, mixture_report, plan_mixture, sized_documents, source_names
from quillspark.llm.packing import pack, packing_report
from quillspark.llm.tokens import count_tokens
from quillspark.session import cut
from quillspark.sources.tables import table


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its container or containers, for each kind of container."""
    sized = cut(table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text")).alias("n_tokens")))
    return pack(sized, table(spark, sf_dir, "pack_capacities"), "doc_id", "n_tokens").drop("capacity")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and room left over, for each kind of container."""
    sized = cut(table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text")).alias("n_tokens")))
    return packing_report(pack(sized, table(spark, sf_dir, "pack_capacities"), "doc_id", "n_tokens"))


#: Seed of the draws, the default of the operator.
SEED = 11


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where(F.col("source").isin(*source_names(table(spark, sf_dir, "mix_targets"))))
    return sized_documents(documents.select("doc_id", "source", "text"), count_tokens(F.col("text")), "n_tokens")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents in their global order."""
    return mixture(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "n_tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source, and the share before the means were settled."""
    targets, sized = table(spark, sf_dir, "mix_targets"), _sized(spark, sf_dir).drop("text")
    plans = plan_mixture(sized, targets, None, SEED, "doc_id", "source", "n_tokens")
    return mixture_report(mixture(sized, targets, "n_tokens", seed=SEED, plans=plans), targets, "n_tokens", plans=plans)


QUERIES = {"p7_packed": p7_packed, "p7_report": p7_report, "p8_mixture": p8_mixture, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
