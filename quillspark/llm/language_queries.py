"""Queries on the languages of documents (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.langid import detect, train_clean, training_sample
from quillspark.sources.tables import table

#: Running sentences from which a document holds a language.
LEAST_SENTENCES = 2


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return detect(documents, train_clean(training_sample(documents, "doc_id", "text", "lang")))


def _languages(detected: DataFrame) -> DataFrame:
    """One row per document and language, without a shuffle: segments of a document are in one row."""
    names = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    each = detected.select("doc_id", "labelled", "segments", F.explode(names).alias("lang"))
    own = F.filter("segments", lambda s: s["lang"] == F.col("lang"))
    total = F.aggregate(own, F.lit(0), lambda a, s: a + s["sentences"])
    weighted = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["sentences"] * s["confidence"])
    return each.select("doc_id", "labelled", "lang", total.alias("sentences"), (weighted / total).alias("confidence"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with at least two whole running sentences that the label doesn't name."""
    rows = _languages(_detected(spark, sf_dir))
    return rows.where((F.col("sentences") >= LEAST_SENTENCES) & ~F.array_contains("labelled", F.col("lang"))).select("doc_id", "lang")


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its main language, all languages and their confidence; null and empty ones without running text."""
    rows = _detected(spark, sf_dir)
    best = F.array_max(F.transform(F.array_distinct(F.transform("segments", lambda s: s["lang"])), lambda g: F.struct(
        F.aggregate(F.filter("segments", lambda s: s["lang"] == g), F.lit(0), lambda a, s: a + s["sentences"]).alias("n"),
        F.aggregate(F.filter("segments", lambda s: s["lang"] == g), F.lit(0.0), lambda a, s: a + s["sentences"] * s["confidence"]).alias("c"), g.alias("lang"))))
    main = rows.select("doc_id", "labelled", F.array_sort(F.array_distinct(F.transform("segments", lambda s: s["lang"]))).alias("languages"), best.alias("b"))
    return main.select("doc_id", "labelled", "languages", F.col("b.lang").alias("lang"), (F.col("b.c") / F.col("b.n")).alias("confidence"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment of each document with language, place and confidence."""
    return _detected(spark, sf_dir).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")


QUERIES = {"p9_found": p9_found, "p9_documents": p9_documents, "p9_segments": p9_segments}
ORACLES: dict[str, str] = {}
