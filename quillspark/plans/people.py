"""Queries on the identity of authors and the open copies of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.text import surname
from quillspark.operators import identity
from quillspark.plans.fusion import _KEY
from quillspark.plans.records import _OK, _TITLE
from quillspark.session import block_join
from quillspark.sources.tables import table

def resolve_search(spark: SparkSession, d: str) -> DataFrame:
    """The best eight authors for the name of every author whose ord is divisible by 20, among all authors."""
    authors = table(spark, d, "authors")
    return identity.rank_candidates(authors.where("ord % 20 = 0 AND name IS NOT NULL").select(F.col("name").alias("query")), authors, 8)


def chosen_candidates(spark: SparkSession, d: str) -> DataFrame:
    """For the surname and given initial of every twentieth author, with and without the rest, the author a name search should take."""
    authors = table(spark, d, "authors").where("name IS NOT NULL").select("ord", "name", "citations", "h_index", surname(F.col("name")).alias("s")).where("s IS NOT NULL")
    asked = authors.where("ord % 20 = 0").select(F.col("name").alias("query"), "s").distinct()
    return identity.chosen_candidate(block_join(authors, asked, "s", "ord"))


def resolve_entries(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "papers").select("ord", F.explode("authors").alias("a")).select("ord", "a.position", "a.author_id", "a.name")
    return identity.confirmed_ids(entries, table(spark, d, "authors").select("id", "name"))


def authorities(spark: SparkSession, d: str) -> DataFrame:
    """How many byline entries name an author in which system."""
    entries = table(spark, d, "papers").select(F.explode("authors").alias("a"))
    return entries.groupBy(identity.authority(F.col("a.author_id")).alias("authority")).agg(F.count(F.lit(1)).alias("n"))


def byline_entries(spark: SparkSession, d: str) -> DataFrame:
    """The byline entry of each paper that a given name means."""
    found = identity.locate_in_byline("authors", "maria")
    return table(spark, d, "papers").select("ord", found["position"].alias("position"), found["name"].alias("name")).where("position IS NOT NULL")


def institution_parts(spark: SparkSession, d: str) -> DataFrame:
    """Named parts of the authors' affiliations and how many authors have them."""
    return table(spark, d, "authors").select(F.explode(identity.institution_words(F.col("affiliation"))).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def fused_authors(spark: SparkSession, d: str) -> DataFrame:
    return identity.fuse_authors(table(spark, d, "authors").withColumn("cluster", F.col("id")), "cluster")


def open_locations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("ord", identity.open_location().alias("location")).where("location IS NOT NULL")


def cross_validated(spark: SparkSession, d: str) -> DataFrame:
    rows = identity.cross_validated(table(spark, d, "papers").select("ord", "doi", "year", "abstract", "evidence_list"))
    return rows.select("ord", F.round("confidence", 6).alias("confidence"))


def watched_bylines(spark: SparkSession, d: str) -> DataFrame:
    """Byline names that are authors of the table, in any order of their parts."""
    names = table(spark, d, "papers").select("ord", F.explode("authors").alias("a")).select("ord", "a.position", "a.name")
    return identity.watch_list(names, table(spark, d, "authors").select("name")).select("ord", "position")


QUERIES = {f.__name__: f for f in (resolve_search, chosen_candidates, resolve_entries, authorities, byline_entries, institution_parts, fused_authors, open_locations, cross_validated, watched_bylines)}

_TOK = "list_sort(list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> '')))"
_CONF = "list_max(list_transform(list_filter(coalesce(evidence_list, []), lambda e: e.confidence >= 0 AND e.confidence <= 1), lambda e: e.confidence))"
_HOST = r"lower(regexp_extract({0}, '^[a-zA-Z]+://([^@/]*@)?([^/:?#]+)', 2))"
_LEGAL = f"({_OK} AND {_HOST} NOT IN ('academia.edu', 'researchgate.net', 'www.academia.edu', 'www.researchgate.net'))"
_FIRST = ", ".join(f"arg_min({c}, (-conf, ord)) FILTER ({c} <> '') AS {c}" for c in ("name", "orcid", "affiliation", "email", "homepage"))
_SUR = r"nullif(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9一-鿿 ]', ' ', 'g'), ' +', ' ', 'g')), ' ')[-1], '')"
_LONG = "list_sort(list_filter(list_distinct(string_split({0}, ' ')), lambda t: length(t) > 1))"
ORACLES = {
    "chosen_candidates": f"""WITH a AS (SELECT ord, name, coalesce(citations, 0) AS c, coalesce(h_index, 0) AS h, {_SUR.format('name')} AS s FROM authors), q AS (SELECT DISTINCT name AS query, s FROM a WHERE ord % 20 = 0 AND name IS NOT NULL),
        t AS (SELECT query, ord, c, h, CASE WHEN {_LONG.format(_TITLE.format('query'))} = {_LONG.format(_TITLE.format('name'))} AND len({_LONG.format(_TITLE.format('query'))}) > 0 THEN 1 ELSE 3 END AS tier FROM q JOIN a USING (s))
        SELECT query, ord, CAST(tier AS INT) AS tier FROM t QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier = 1 THEN -c ELSE -h END, CASE WHEN tier = 1 THEN 0 ELSE -c END, ord) = 1""",
    "resolve_search": f"""WITH q AS (SELECT query, {_TOK.format(_TITLE.format('query'))} AS q FROM (SELECT DISTINCT name AS query FROM authors WHERE ord % 20 = 0 AND name IS NOT NULL)), a AS (SELECT ord, citations, h_index, {_TOK.format(_TITLE.format('name'))} AS t FROM authors)
        SELECT query, ord, CAST(row_number() OVER (PARTITION BY query ORDER BY q <> t, citations DESC NULLS LAST, h_index DESC NULLS LAST, ord) AS INT) AS rank FROM q JOIN a ON len(q) > 0 AND list_has_all(t, q) QUALIFY rank <= 8""",
    "resolve_entries": f"""WITH i AS (SELECT DISTINCT {_KEY.format('id')} AS k FROM authors), n AS (SELECT lower(trim(name)) AS n, min({_KEY.format('id')}) AS b FROM authors GROUP BY 1 HAVING count(DISTINCT {_KEY.format('id')}) = 1),
        e AS (SELECT ord, a.position AS position, {_KEY.format('a.author_id')} AS k, lower(trim(a.name)) AS nm FROM (SELECT ord, unnest(authors) AS a FROM papers))
        SELECT ord, position, coalesce(i.k, n.b) AS resolved, CASE WHEN i.k IS NOT NULL THEN 'id' WHEN n.b IS NOT NULL THEN 'name' END AS how FROM e LEFT JOIN i ON i.k = e.k LEFT JOIN n ON n.n = e.nm""",
    "authorities": f"""SELECT CASE WHEN regexp_matches(k, '^[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{3}}[0-9X]$') THEN 'orcid' WHEN regexp_matches(k, '^A[0-9]{{5,}}$') THEN 'openalex' WHEN regexp_matches(k, '^[0-9]{{5,12}}$') THEN 'semantic_scholar' END AS authority, count(*) AS n
        FROM (SELECT {_KEY.format('a.author_id')} AS k FROM (SELECT unnest(authors) AS a FROM papers)) GROUP BY 1""",
    "byline_entries": f"""WITH m AS (SELECT ord, coalesce(list_filter(authors, lambda a: lower(trim(a.name)) = 'maria')[1], list_filter(authors, lambda a: contains(lower(a.name), 'maria') OR list_has_all(string_split({_TITLE.format('a.name')}, ' '), ['maria']))[1]) AS a FROM papers)
        SELECT ord, a.position AS position, a.name AS name FROM m WHERE a.position IS NOT NULL""",
    "institution_parts": "WITH p AS (SELECT lower(trim(unnest(regexp_split_to_array(affiliation, '[,;]')))) AS part FROM authors) SELECT part, count(*) AS n FROM p WHERE length(part) > 3 GROUP BY part",
    "fused_authors": f"""WITH p AS (SELECT *, coalesce({_CONF}, 0.0::DOUBLE) AS conf FROM authors WHERE id IS NOT NULL), s AS (SELECT id, array_to_string(list_sort(list_distinct(list_filter(flatten(list(list_concat([name], coalesce(aliases, [])))), lambda a: length(trim(a)) > 0))), '; ') AS aliases FROM p GROUP BY id)
        SELECT id AS cluster, count(*) AS n_records, {_FIRST}, max(h_index) AS h_index, max(citations) AS citations, max((disambiguation_status = 'confirmed')::INT) AS confirmed, any_value(s.aliases) AS aliases FROM p JOIN s USING (id) GROUP BY id""",
    "open_locations": f"""WITH l AS (SELECT ord, coalesce(CASE WHEN {_LEGAL.format('pdf_url')} THEN pdf_url END, 'https://arxiv.org/pdf/' || nullif(regexp_extract(arxiv_id, '([0-9]{{4}}\\.[0-9]{{4,5}})', 1), ''), CASE WHEN lower(url) LIKE '%.pdf' AND {_LEGAL.format('url')} THEN url END) AS location FROM papers)
        SELECT * FROM l WHERE location IS NOT NULL""",
    "cross_validated": f"""WITH a AS (SELECT ord, abstract, year, {_CONF} AS conf, least(1.0::DOUBLE, {_CONF} + CASE WHEN doi <> '' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS c FROM papers), b AS (SELECT *, least(1.0::DOUBLE, c + CASE WHEN year IS NOT NULL THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END) AS d FROM a)
        SELECT ord, CASE WHEN conf IS NOT NULL THEN round(least(1.0::DOUBLE, d + CASE WHEN abstract <> '' THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END), 6) END AS confidence FROM b""",
    "watched_bylines": f"WITH k AS (SELECT DISTINCT {_TOK.format(_TITLE.format('name'))} AS k FROM authors) SELECT ord, a.position AS position FROM (SELECT ord, unnest(authors) AS a FROM papers) WHERE {_TOK.format(_TITLE.format('a.name'))} IN (SELECT k FROM k WHERE len(k) > 0)",
}
