"""Queries on references between the tables (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.ids import record_key
from quillspark.operators.orphans import find_orphans, orphan_report
from quillspark.sources.tables import table


def citation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of each citation as one reference: ref_field, ord, position, ref, at."""
    cites = table(spark, sf_dir, "snapshot_citations")
    ends = F.array(*[F.struct(F.lit(f).alias("ref_field"), record_key(F.col(f)).alias("ref")) for f in ("cited_id", "citing_id")])
    return cites.select("ord", "recorded_at", F.explode(ends).alias("e")).select("e.ref_field", "ord", F.lit(0).alias("position"), "e.ref", "recorded_at")


def byline_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author ids in bylines: ref_field, ord, position, ref, year."""
    papers = table(spark, sf_dir, "papers")
    return papers.select("ord", "year", F.explode("authors").alias("a")).select(
        F.lit("author_id").alias("ref_field"), "ord", F.col("a.position").alias("position"), record_key(F.col("a.author_id")).alias("ref"), "year"
    )


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    works = table(spark, sf_dir, "snapshot_works").select(record_key(F.col("id")).alias("key"), "loaded_at", "deleted_at")
    authors = table(spark, sf_dir, "authors").select(record_key(F.col("id")).alias("key"))
    cites = find_orphans(citation_refs(spark, sf_dir), works, [("ref", "key")], deleted=F.col("deleted_at").isNotNull(), loaded=F.col("loaded_at"), at="recorded_at")
    return cites, find_orphans(byline_refs(spark, sf_dir), authors, [("ref", "key")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference that leads nowhere, or not yet, with the reason."""
    cites, bylines = _orphans(spark, sf_dir)
    cols = ["ref_field", "ord", "position", "reason"]
    return cites.select(*cols).unionByName(bylines.select(*cols))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, period and reason (month of delivery; publication year for bylines)."""
    cites, bylines = _orphans(spark, sf_dir)
    cites = cites.select(F.lit("snapshot_citations").alias("table_name"), "ref_field", F.date_format("recorded_at", "yyyy-MM").alias("period"), "reason")
    bylines = bylines.select(F.lit("papers").alias("table_name"), "ref_field", F.col("year").cast("string").alias("period"), "reason")
    return orphan_report(cites.unionByName(bylines), ["table_name", "ref_field", "period", "reason"])


def p4_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of papers to snapshot works by DOI and year together, of which either may be null: orphans under full and under partial match."""
    refs = table(spark, sf_dir, "papers").select("ord", F.lower("doi").alias("doi"), "year")
    works = table(spark, sf_dir, "snapshot_works").select(F.lower("doi").alias("work_doi"), F.col("year").alias("work_year"))
    keys = [("doi", "work_doi"), ("year", "work_year")]
    each = [find_orphans(refs, works, keys, match=m).select(F.lit(m).alias("match"), "ord", "reason") for m in ("full", "partial")]
    return each[0].unionByName(each[1])


_KEY = r"nullif(trim(upper(regexp_replace(regexp_replace(trim({0}), '^.*[/:#=]\s*([^/:#=]+)/?$', '\1'), '/$', ''))), '')"
_SQL_REFS = f"""
works AS (SELECT {_KEY.format('id')} AS key, min(loaded_at) AS first_load, bool_and(deleted_at IS NOT NULL) AS gone FROM snapshot_works GROUP BY 1),
people AS (SELECT DISTINCT {_KEY.format('id')} AS key FROM authors),
refs AS (
  SELECT 'cited_id' AS ref_field, ord, {_KEY.format('cited_id')} AS ref, recorded_at FROM snapshot_citations
  UNION ALL SELECT 'citing_id', ord, {_KEY.format('citing_id')}, recorded_at FROM snapshot_citations),
cite_orphans AS (
  SELECT 'snapshot_citations' AS table_name, ref_field, ord, 0 AS position, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS period,
         CASE WHEN w.key IS NULL THEN 'missing' WHEN w.gone THEN 'deleted' WHEN w.first_load > r.recorded_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN works w ON r.ref = w.key WHERE r.ref IS NOT NULL),
entries AS (SELECT ord, year, unnest(authors) AS a FROM papers),
byline_orphans AS (
  SELECT 'papers' AS table_name, 'author_id' AS ref_field, ord, a.position AS position, CAST(year AS VARCHAR) AS period, 'missing' AS reason
  FROM (SELECT *, {_KEY.format('a.author_id')} AS ref FROM entries) e
  WHERE ref IS NOT NULL AND ref NOT IN (SELECT key FROM people WHERE key IS NOT NULL)),
orphans AS (SELECT * FROM cite_orphans WHERE reason IS NOT NULL UNION ALL SELECT * FROM byline_orphans)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_composite": p4_composite}
ORACLES = {
    "p4_found": f"WITH {_SQL_REFS} SELECT ref_field, ord, position, reason FROM orphans",
    "p4_report": f"WITH {_SQL_REFS} SELECT table_name, ref_field, period, reason, count(*) AS n_refs FROM orphans GROUP BY ALL",
    "p4_composite": """WITH p AS (SELECT ord, lower(doi) AS d, year AS y FROM papers), w AS (SELECT DISTINCT lower(doi) AS d, year AS y FROM snapshot_works)
        SELECT 'full' AS match, ord, 'partial_null' AS reason FROM p WHERE (d IS NULL) <> (y IS NULL)
        UNION ALL SELECT 'full', ord, 'missing' FROM p WHERE d IS NOT NULL AND y IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.d = p.d AND w.y = p.y)
        UNION ALL SELECT 'partial', ord, 'missing' FROM p WHERE d IS NOT NULL AND y IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.d = p.d AND w.y = p.y)
        UNION ALL SELECT 'partial', ord, 'missing' FROM p WHERE d IS NOT NULL AND y IS NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.d = p.d)
        UNION ALL SELECT 'partial', ord, 'missing' FROM p WHERE d IS NULL AND y IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.y = p.y)""",
}
