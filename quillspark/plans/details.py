"""Queries on name keys, identifiers out of identifiers, metered quotas, increments, pages and passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import text as T
from quillspark.operators import authors, caching, changes, edges, fusion
from quillspark.operators.upserts import last_wins
from quillspark.plans.fusion import _KEY, _SHIP
from quillspark.plans.records import _TITLE
from quillspark.sources.tables import table


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Surname, significant tokens and index keys of the authors' names."""
    rows = table(spark, d, "authors").select("ord", T.surname(F.col("name")).alias("surname"), T.significant_tokens(F.col("name")).alias("t"), T.index_keys(F.col("name")).alias("k"))
    return rows.select("ord", "surname", F.array_join("t", " ").alias("tokens"), F.array_join("k", " ").alias("keys"))


def arxiv_dois(spark: SparkSession, d: str) -> DataFrame:
    """Preprint ids that DOIs of the preprint server name, with versions cut off."""
    doi = F.concat(F.lit("10.48550/arXiv."), F.lpad((F.col("ord") % 2400).cast("string"), 4, "0"), F.lit("."), F.lpad((F.col("ord") % 100000).cast("string"), 5, "0"), F.when(F.col("ord") % 2 == 0, "v2").otherwise(""))
    return table(spark, d, "papers").select("ord", T.arxiv_of_doi(F.when(F.col("ord") % 5 == 0, F.col("doi")).otherwise(doi)).alias("arxiv"))


def sorted_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows as compact JSON with sorted names."""
    return table(spark, d, "snapshot_works").select("id", T.sorted_json({"year": F.col("year"), "cited_by_count": F.col("cited_by_count"), "doi": F.col("doi")}).alias("json"))


def list_changes(spark: SparkSession, d: str) -> DataFrame:
    """Keywords and bylines that changed between the first and the last delivery of an id."""
    rows = table(spark, d, "papers").where("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("keywords", "authors"), "ord").alias("o"), F.max_by(F.struct("keywords", "authors"), "ord").alias("n"))
    return rows.select("id", F.array_join(changes.changed_lists("o", "n"), ",").alias("changed"))


def metered_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that their source's daily allowance of 500 covers."""
    rows = caching.metered(table(spark, d, "events"), "event_type", "ts", "event_id", "value", 500.0)
    return rows.where("allowed").select("event_id", "event_type")


def coauthor_increments(spark: SparkSession, d: str) -> DataFrame:
    """Co-authorships of odd papers added to those of even ones."""
    papers = table(spark, d, "papers").select("id", "ord", "year", "authors")
    pairs = lambda rows: edges.coauthor_pairs(edges.authorships(rows.withColumn("id", F.lit(None).cast("string"))))
    return caching.coauthor_delta(pairs(papers.where("ord % 2 = 0")), pairs(papers.where("ord % 2 = 1")))


def two_passes(spark: SparkSession, d: str) -> DataFrame:
    """Works found by id (even papers), and of the odd papers those with other ids."""
    papers = table(spark, d, "papers").select("id", "ord", "title")
    return caching.two_passes(last_wins(papers.where("ord % 2 = 0"), ["id"], "ord"), last_wins(papers.where("ord % 2 = 1"), ["id"], "ord"), "id")


def paper_pages(spark: SparkSession, d: str) -> DataFrame:
    """All papers in pages of 1,000 by ord: rows and bounds of each page."""
    rows = caching.pages(table(spark, d, "papers").select("ord"), "ord", 1000)
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


def identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of one id against the first: whether they share an exact identifier and whether their titles conflict."""
    rows = fusion.match_features(table(spark, d, "papers")).where("id IS NOT NULL")
    firsts = rows.groupBy("id").agg(F.min_by(F.struct("ord", "doi", "arxiv", "pmid", "url", "title", F.lit(None).cast("string").alias("id")), "ord").alias("b"))
    pairs = rows.select("id", F.struct("ord", "doi", "arxiv", "pmid", "url", "title", F.lit(None).cast("string").alias("id")).alias("a")).join(firsts, "id").where("a.ord <> b.ord")
    return pairs.select(F.col("a.ord").alias("ord"), authors.shares_identity("a", "b").alias("shared"), authors.titles_conflict("a", "b").alias("conflict"))


QUERIES = {f.__name__: f for f in (name_keys, arxiv_dois, sorted_json, list_changes, metered_events, coauthor_increments, two_passes, paper_pages, identity_pairs)}

_SIG = f"list_sort(list_filter(list_distinct(string_split({_TITLE.format('name')}, ' ')), lambda t: length(t) > 1))"
_LOW = "list_transform(coalesce({0}, []), lambda x: lower(trim(x)))"
_ARX = r"CASE WHEN regexp_matches({0}, '^[0-9]{{4}}\.[0-9]{{4,5}}(v[0-9]+)?$|^[a-z.\-]+/[0-9]{{7}}(v[0-9]+)?$') THEN regexp_replace({0}, 'v[0-9]+$', '') END"
_AX = _ARX.format(r"trim(regexp_replace(lower(trim(arxiv_id)), '^(https?://arxiv\.org/(abs|pdf)/|arxiv:)\s*', ''))")
ORACLES = {
    "name_keys": f"""WITH t AS (SELECT ord, nullif(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9一-鿿 ]', ' ', 'g'), ' +', ' ', 'g')), ' ')[-1], '') AS surname, {_SIG} AS t FROM authors)
        SELECT ord, surname, array_to_string(t, ' ') AS tokens, array_to_string(list_sort(list_distinct(flatten(list_transform(t, lambda w: CASE WHEN length(w) IN (3, 4) THEN list_concat([w], list_transform(range(1, length(w)), lambda i: substr(w, CAST(i AS INT), 2))) ELSE [w] END)))), ' ') AS keys FROM t""",
    "arxiv_dois": r"SELECT ord, CASE WHEN ord % 5 = 0 THEN nullif(regexp_replace(regexp_extract(lower(trim(doi)), '10\.48550/arxiv\.(([0-9]{4}\.[0-9]{4,5}|[a-z\-.]+/[0-9]{7})(v[0-9]+)?)$', 1), 'v[0-9]+$', ''), '') ELSE lpad(CAST(ord % 2400 AS VARCHAR), 4, '0') || '.' || lpad(CAST(ord % 100000 AS VARCHAR), 5, '0') END AS arxiv FROM papers",
    "sorted_json": "SELECT id, CAST(to_json({'cited_by_count': cited_by_count, 'doi': doi, 'year': year}) AS VARCHAR) AS json FROM snapshot_works",
    "list_changes": f"""WITH e AS (SELECT id, arg_min({{'k': keywords, 'a': list_transform(authors, lambda a: a.name)}}, ord) AS o, arg_max({{'k': keywords, 'a': list_transform(authors, lambda a: a.name)}}, ord) AS n FROM papers WHERE id IS NOT NULL GROUP BY id)
        SELECT id, array_to_string(list_filter([CASE WHEN {_LOW.format('o.k')} <> {_LOW.format('n.k')} THEN 'keywords' END, CASE WHEN {_LOW.format('o.a')} <> {_LOW.format('n.a')} THEN 'authors' END], lambda x: x IS NOT NULL), ',') AS changed FROM e""",
    "metered_events": "WITH u AS (SELECT event_id, event_type, coalesce(sum(coalesce(value, 1)) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM events) SELECT event_id, event_type FROM u WHERE used < 500",
    "coauthor_increments": f"""WITH s AS (SELECT DISTINCT ord, year, {_KEY.format('a.author_id')} AS author FROM (SELECT ord, year, unnest(authors) AS a FROM papers) WHERE {_KEY.format('a.author_id')} IS NOT NULL)
        SELECT x.author AS a, y.author AS b, CAST(count(*) AS BIGINT) AS papers, min(x.year) AS first_year, max(x.year) AS last_year FROM s x JOIN s y ON x.ord = y.ord AND x.author < y.author GROUP BY 1, 2""",
    "two_passes": "SELECT id, ord, title FROM papers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord % 2, ord DESC) = 1",
    "paper_pages": "WITH p AS (SELECT ord, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / 1000) AS BIGINT) AS page FROM papers) SELECT page, count(*) AS n, min(ord) AS first, max(ord) AS last FROM p GROUP BY page",
    "identity_pairs": f"""WITH f AS (SELECT ord, id, nullif(lower(doi), '') AS doi, {_AX} AS arxiv, nullif(trim(pmid), '') AS pmid, nullif(lower(regexp_replace(url, '/+$', '')), '') AS url, {_TITLE.format('title')} AS title FROM papers WHERE id <> ''),
        b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)
        SELECT a.ord AS ord, coalesce(a.doi = b.doi, false) OR coalesce(a.arxiv = b.arxiv, false) OR coalesce(a.pmid = b.pmid, false) OR coalesce(a.url = b.url, false) AS shared, coalesce(a.title <> '' AND b.title <> '' AND a.title <> b.title, false) AS conflict FROM f a JOIN b ON a.id = b.id WHERE a.ord <> b.ord""",
}
