"""Queries on rows of papers linked by identifiers (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.ids import arxiv_key, doi_key, pmid_key
from quillspark.llm.grouping import linked_groups
from quillspark.sources.tables import table


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers").select("ord", doi_key(F.col("doi")).alias("doi"), arxiv_key(F.col("arxiv_id")).alias("arxiv_id"), pmid_key(F.col("pmid")).alias("pmid"))
    return linked_groups(papers, "ord", ["doi", "arxiv_id", "pmid"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in groups of two or more, with the smallest ``ord`` of their group."""
    return _groups(spark, sf_dir).where("group_rows > 1").select("ord", "group_ord")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its group and the group's size."""
    return _groups(spark, sf_dir)


_DOI = r"nullif(regexp_replace(regexp_extract(lower(replace(replace(trim(doi), '%2F', '/'), '%2f', '/')), '(10\.[0-9]{4,9}/[^\s]+)', 1), '[.,;]+$', ''), '')"
_ARXIV = r"nullif(regexp_extract(lower(trim(arxiv_id)), '([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?(\.pdf)?$', 1), '')"
_PMID = r"nullif(regexp_extract(lower(trim(pmid)), '^(.*[/:\s]|pmid)?\s*0*([1-9][0-9]{0,8})(\.0+)?/?$', 2), '')"
_SQL = f"""
WITH RECURSIVE ids AS (
  SELECT ord, 'd' || {_DOI} AS key FROM papers UNION ALL SELECT ord, 'a' || {_ARXIV} FROM papers UNION ALL SELECT ord, 'p' || {_PMID} FROM papers),
links AS (SELECT DISTINCT a.ord AS a, b.ord AS b FROM (SELECT key, min(ord) AS ord FROM ids WHERE key IS NOT NULL GROUP BY key) a JOIN ids b USING (key)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT ord, ord FROM papers),
reach AS (SELECT ord AS a, ord AS b FROM papers UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
grouped AS (SELECT a AS ord, min(b) AS group_ord, count(*) AS group_rows FROM reach GROUP BY a)
"""

QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
ORACLES = {
    "p5_found": _SQL + "SELECT ord, group_ord FROM grouped WHERE group_rows > 1",
    "p5_groups": _SQL + "SELECT ord, group_ord, group_rows FROM grouped",
}
