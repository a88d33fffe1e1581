"""Queries on single records: keys, filters, pages, validity, confidence, enrichment."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import text as T
from quillspark.operators import filters, quality
from quillspark.sources.tables import table

NOW = datetime(2025, 6, 30, tzinfo=timezone.utc)
_NOW = "TIMESTAMPTZ '2025-06-30 00:00:00+00'"
_TITLE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


def norm_title_keys(spark: SparkSession, d: str) -> DataFrame:
    """Title keys and token sets of all papers."""
    key = T.title_key(F.col("title"))
    return table(spark, d, "papers").select("ord", key.alias("title_key"), T.ascii_cjk_key(F.col("title")).alias("narrow_key"), F.array_join(T.tokens(key), " ").alias("tokens"))


def nfc_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("ord", T.nfc(F.col("title")).alias("title"))


def norm_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Strictly normalised identifiers of all papers, and the kind of each DOI text."""
    return table(spark, d, "papers").select(
        "ord", T.strict_doi(F.col("doi")).alias("doi"), T.strict_pmid(F.col("pmid")).alias("pmid"), T.strict_arxiv(F.col("arxiv_id")).alias("arxiv_id"), T.id_kind(F.coalesce("doi", "arxiv_id", "title")).alias("kind")
    )


def orcid_checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authors").where("orcid IS NOT NULL").select("ord", "orcid", T.orcid_ok(F.col("orcid")).alias("ok"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform("authors", lambda a: a["name"])
    return table(spark, d, "papers").select("ord", T.content_hash(F.col("title"), names, F.col("year"), F.col("venue")).alias("hash"))


def url_forms(spark: SparkSession, d: str) -> DataFrame:
    """Validity, safe file names and redacted forms of links."""
    with_secret = F.concat(F.col("url"), F.lit("?api_key="), F.col("ord").cast("string"), F.lit("&page=2"))
    return table(spark, d, "papers").where("url IS NOT NULL").select("ord", T.url_ok(F.col("url")).alias("ok"), T.safe_stem(F.col("url")).alias("stem"), T.redacted(with_secret).alias("shown"))


def papers_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    return filters.query_papers(table(spark, d, "papers"), keyword="lattice", year_from=2005, year_to=2020).select("ord", "year")


def papers_by_venue_year(spark: SparkSession, d: str) -> DataFrame:
    return filters.query_papers(table(spark, d, "papers"), venue="journal", year=2015).select("ord", "venue")


def author_name_match(spark: SparkSession, d: str) -> DataFrame:
    """Papers with a byline name that holds all tokens of the name asked for, in any order."""
    return filters.query_papers(table(spark, d, "papers"), author="Polulesku").select("ord")


def authors_by_interest(spark: SparkSession, d: str) -> DataFrame:
    return filters.query_authors(table(spark, d, "authors"), affiliation="university of", interest="neural").select("ord", "id")


def papers_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The 200 papers after a cursor in the order of year, title and ord; a page is the feature."""
    return filters.keyset_page(table(spark, d, "papers").select("year", "title", "ord"), ["year", "title", "ord"], (2010, "M", 0), 200)


def papers_offset_page(spark: SparkSession, d: str) -> DataFrame:
    return filters.offset_page(table(spark, d, "papers").select("ord", "title"), ["title", "ord"], 100, 150)


def paper_by_arxiv(spark: SparkSession, d: str) -> DataFrame:
    """Point read: every stored form and version of the arXiv id most papers share."""
    keyed = table(spark, d, "papers").select("ord", T.strict_arxiv(F.col("arxiv_id")).alias("key")).where("key IS NOT NULL")
    top = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(1)
    return keyed.join(F.broadcast(top.select("key")), "key").select("ord", "key")


def valid_papers(spark: SparkSession, d: str) -> DataFrame:
    """Errors and warnings of every paper, and whether it is valid."""
    errors, papers = quality.paper_errors(NOW), table(spark, d, "papers")
    return papers.select("ord", F.array_join(errors, ",").alias("errors"), F.array_join(quality.paper_warnings(NOW, dict(papers.dtypes)), ",").alias("warnings"), (F.size(errors) == 0).alias("valid"))


def valid_authors(spark: SparkSession, d: str) -> DataFrame:
    errors = quality.author_errors()
    return table(spark, d, "authors").select("ord", F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("valid"))


def valid_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations that may not be stored: an end is missing, or a work cites itself."""
    a, b = T.work_key(F.col("citing_id")), T.work_key(F.col("cited_id"))
    error = F.when(a.isNull(), "citing_id").when(b.isNull(), "cited_id").when(a == b, "self_citation")
    return table(spark, d, "snapshot_citations").select("ord", error.alias("error")).where("error IS NOT NULL")


def completeness_scores(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers")
    kinds = dict(papers.dtypes)
    return papers.select("ord", F.round(quality.completeness(kinds), 6).alias("completeness"), F.round(quality.record_confidence(NOW, kinds), 6).alias("confidence"))


def composite_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of a paper from the sources that report it, and with its field adjustments."""
    base = quality.composite_confidence(F.transform(quality.valid_evidence("evidence_list"), lambda e: e["source"]))
    papers = table(spark, d, "papers").select("ord", "doi", "pdf_url", "evidence_list", base.alias("base")).where("base IS NOT NULL")
    return papers.select("ord", F.round("base", 6).alias("base"), F.round(quality.adjusted_confidence(F.col("base"), NOW, "doi", "pdf_url", "evidence_list"), 6).alias("adjusted"))


def evidence_union_capped(spark: SparkSession, d: str) -> DataFrame:
    return quality.evidence_union(table(spark, d, "papers"), "id", "ord", "evidence_list").drop("collected_at")


def evidence_union_best(spark: SparkSession, d: str) -> DataFrame:
    return quality.evidence_union(table(spark, d, "papers"), "id", "ord", "evidence_list", best=True).drop("collected_at")


def enrich_chain(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers").select("ord", "title", "venue", "doi", "url", "pdf_url", "abstract", "authors")
    return quality.standard_enrichment()(papers).select("ord", "title", "venue", "doi", "pdf_url", F.array_join("names", "; ").alias("names"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_title_keys, nfc_titles, norm_identifiers, orcid_checks, content_hash, url_forms, papers_by_keyword, papers_by_venue_year, author_name_match, authors_by_interest,
        papers_keyset_page, papers_offset_page, paper_by_arxiv, valid_papers, valid_authors, valid_citations, completeness_scores, composite_confidence, evidence_union_capped, evidence_union_best, enrich_chain,
    )
}

_DOI = r"CASE WHEN regexp_matches(trim(regexp_replace(trim({0}), '^(https?://doi\.org/|doi:)', '', 'i')), '^10\.[0-9]{{4,9}}/\S+$') THEN trim(regexp_replace(trim({0}), '^(https?://doi\.org/|doi:)', '', 'i')) END"
_ARX = r"trim(regexp_replace(lower(trim({0})), '^(https?://arxiv\.org/(abs|pdf)/|arxiv:)\s*', ''))"
_ARXIV = f"CASE WHEN regexp_matches({_ARX}, '^([0-9]{{{{4}}}}\\.[0-9]{{{{4,5}}}}|[a-z.\\-]+/[0-9]{{{{7}}}})(v[0-9]+)?$') THEN regexp_replace({_ARX}, 'v[0-9]+$', '') END"
_WORK = r"nullif(upper(regexp_extract(trim({0}), '^(https?://[^/\s]+/)?([Ww][0-9]+)/?$', 2)), '')"
_GIVEN = "coalesce(length(trim({0})) > 0, false)"
_JOIN = "array_to_string(list_filter([{0}], lambda x: x IS NOT NULL), ',')"
_OK = "coalesce(regexp_matches({0}, '^(?i:https?)://[^/\\s?#]+\\S*$'), false)"
_EV = "list_filter(coalesce(evidence_list, []), lambda e: e.confidence >= 0 AND e.confidence <= 1)"
_FILLED = "((title IS NOT NULL AND title <> '')::INT + coalesce(len(authors) > 0, false)::INT + (year IS NOT NULL)::INT + (venue IS NOT NULL AND venue <> '')::INT + (abstract IS NOT NULL AND abstract <> '')::INT + (doi IS NOT NULL AND doi <> '')::INT + (url IS NOT NULL AND url <> '')::INT + (citations IS NOT NULL)::INT) / 8.0::DOUBLE"
_BASE = "CASE s " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in quality.BASELINE.items()) + " ELSE 0.5::DOUBLE END"


def _union_sql(rank: str) -> str:
    return f"""
WITH each AS (SELECT id, ord, e.source AS source, e.source_id AS source_id, e.confidence AS confidence, i AS pos
  FROM (SELECT id, ord, unnest(evidence_list) AS e, generate_subscripts(evidence_list, 1) AS i FROM papers WHERE id IS NOT NULL)),
one AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY id, source, source_id ORDER BY {rank} ord, pos) = 1)
SELECT id, source, source_id, confidence, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY coalesce(CASE WHEN isnan(confidence) THEN confidence ELSE -confidence END, 'inf'::DOUBLE), ord, pos) AS INT) AS rank FROM one) WHERE rank <= 500"""


ORACLES = {
    "norm_title_keys": f"SELECT ord, {_TITLE.format('title')} AS title_key, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}} ]', ' ', 'g'), ' +', ' ', 'g')) AS narrow_key, "
    f"array_to_string(list_sort(list_distinct(list_filter(string_split({_TITLE.format('title')}, ' '), lambda t: t <> ''))), ' ') AS tokens FROM papers",
    "nfc_titles": "SELECT ord, nfc_normalize(title) AS title FROM papers",
    "norm_identifiers": f"""SELECT ord, {_DOI.format('doi')} AS doi, CASE WHEN regexp_matches(trim(pmid), '^[0-9]{{1,8}}$') THEN trim(pmid) END AS pmid, {_ARXIV.format('arxiv_id')} AS arxiv_id,
        CASE WHEN {_DOI.format('k')} IS NOT NULL THEN 'doi' WHEN {_WORK.format('k')} IS NOT NULL THEN 'work' WHEN {_ARXIV.format('k')} IS NOT NULL THEN 'arxiv' ELSE 'text' END AS kind
        FROM (SELECT *, coalesce(doi, arxiv_id, title) AS k FROM papers)""",
    "orcid_checks": """WITH o AS (SELECT ord, orcid, replace(orcid, '-', '') AS d, regexp_matches(orcid, '^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$') AS form FROM authors WHERE orcid IS NOT NULL),
        t AS (SELECT *, CASE WHEN form THEN (12 - list_sum(list_transform(range(1, 16), lambda i: CAST(substr(d, CAST(i AS INT), 1) AS BIGINT) * CAST(pow(2, 16 - i) AS BIGINT))) % 11) % 11 END AS c FROM o)
        SELECT ord, orcid, form AND substr(d, 16, 1) = CASE WHEN c = 10 THEN 'X' ELSE CAST(CAST(c AS INT) AS VARCHAR) END AS ok FROM t""",
    "content_hash": "SELECT ord, substr(sha256(coalesce(title, '') || '|' || coalesce(array_to_string(list_transform(authors, lambda a: a.name), '|'), '') || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || coalesce(venue, '')), 1, 16) AS hash FROM papers",
    "url_forms": f"SELECT ord, {_OK.format('url')} AS ok, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS stem, url || '?api_key=***&page=2' AS shown FROM papers WHERE url IS NOT NULL",
    "papers_by_keyword": "SELECT ord, year FROM papers WHERE year BETWEEN 2005 AND 2020 AND (coalesce(contains(lower(title), 'lattice'), false) OR coalesce(contains(lower(abstract), 'lattice'), false) OR len(list_filter(keywords, lambda w: contains(lower(w), 'lattice'))) > 0)",
    "papers_by_venue_year": "SELECT ord, venue FROM papers WHERE contains(lower(venue), 'journal') AND year = 2015",
    "author_name_match": f"SELECT ord FROM papers WHERE len(list_filter(authors, lambda a: contains(lower(a.name), 'polulesku') OR list_has_all(string_split({_TITLE.format('a.name')}, ' '), ['polulesku']))) > 0",
    "authors_by_interest": "SELECT ord, id FROM authors WHERE contains(lower(affiliation), 'university of') AND len(list_filter(interests, lambda i: contains(lower(i), 'neural'))) > 0",
    "papers_keyset_page": "SELECT year, title, ord FROM papers WHERE year > 2010 OR (year = 2010 AND (title > 'M' OR (title = 'M' AND ord > 0))) ORDER BY year NULLS FIRST, title NULLS FIRST, ord LIMIT 200",
    "papers_offset_page": "SELECT ord, title FROM papers ORDER BY title NULLS FIRST, ord LIMIT 150 OFFSET 100",
    "paper_by_arxiv": f"WITH k AS (SELECT ord, {_ARXIV.format('arxiv_id')} AS key FROM papers) SELECT ord, key FROM k WHERE key = (SELECT key FROM k WHERE key IS NOT NULL GROUP BY key ORDER BY count(*) DESC, key LIMIT 1)",
    "valid_papers": f"""WITH p AS (SELECT ord, {_JOIN.format(f'''CASE WHEN NOT {_GIVEN.format('title')} THEN 'title' END, CASE WHEN year < 1800 OR year > 2026 THEN 'year' END,
        CASE WHEN {_GIVEN.format('doi')} AND NOT regexp_matches(doi, '^10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+$') THEN 'doi' END, CASE WHEN citations < 0 THEN 'citations' END,
        CASE WHEN coalesce(len(evidence_list), 0) = 0 THEN 'evidence' END, CASE WHEN len(list_filter(evidence_list, lambda e: NOT coalesce(length(trim(e.source_url)) > 0, false))) > 0 THEN 'evidence.source_url' END,
        CASE WHEN len(list_filter(evidence_list, lambda e: NOT coalesce(e.confidence >= 0 AND e.confidence <= 1, false))) > 0 THEN 'evidence.confidence' END''')} AS errors,
        {_JOIN.format(f'''CASE WHEN length(title) > 500 THEN 'title' END, CASE WHEN coalesce(len(authors), 0) = 0 THEN 'authors' END, CASE WHEN {_GIVEN.format('url')} AND NOT {_OK.format('url')} THEN 'url' END,
        CASE WHEN {_GIVEN.format('pdf_url')} AND NOT {_OK.format('pdf_url')} THEN 'pdf_url' END, CASE WHEN year > 2025 THEN 'future_year' END, CASE WHEN lower(trim(doi)) LIKE '10.65215%' THEN 'doi_prefix' END''')} AS warnings FROM papers)
        SELECT ord, errors, warnings, errors = '' AS valid FROM p""",
    "valid_authors": f"""WITH p AS (SELECT ord, {_JOIN.format(f'''CASE WHEN NOT {_GIVEN.format('name')} THEN 'name' END, CASE WHEN {_GIVEN.format('email')} AND NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') THEN 'email' END,
        CASE WHEN h_index < 0 THEN 'h_index' END, CASE WHEN citations < 0 THEN 'citations' END, CASE WHEN coalesce(len(evidence_list), 0) = 0 THEN 'evidence' END''')} AS errors FROM authors) SELECT ord, errors, errors = '' AS valid FROM p""",
    "valid_citations": f"SELECT * FROM (SELECT ord, CASE WHEN {_WORK.format('citing_id')} IS NULL THEN 'citing_id' WHEN {_WORK.format('cited_id')} IS NULL THEN 'cited_id' WHEN {_WORK.format('citing_id')} = {_WORK.format('cited_id')} THEN 'self_citation' END AS error FROM snapshot_citations) WHERE error IS NOT NULL",
    "completeness_scores": f"""WITH p AS (SELECT ord, {_FILLED} AS c, list_sort(list_transform({_EV}, lambda e, i: {{'a': -e.confidence, 'b': i, 'confidence': e.confidence, 'at': e.collected_at, 'raw': e.raw_data}}))[1] AS e FROM papers),
        q AS (SELECT ord, c, least(1.0::DOUBLE, e.confidence + CASE WHEN length(e.raw) > 0 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END) AS s, floor((epoch_us({_NOW}) - epoch_us(e.at)) / 86400000000.0::DOUBLE) AS days FROM p)
        SELECT ord, round(c, 6) AS completeness, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE * (CASE WHEN days IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, s + CASE WHEN days <= 30 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END) END) + 0.3::DOUBLE * c)), 6) AS confidence FROM q""",
    "composite_confidence": f"""WITH p AS (SELECT ord, doi, pdf_url, evidence_list, list_distinct(list_transform({_EV}, lambda e: e.source)) AS src FROM papers),
        q AS (SELECT *, least(1.0::DOUBLE, list_max(list_transform(src, lambda s: {_BASE})) + 0.05::DOUBLE * (len(src) - 1)) AS base, floor((epoch_us({_NOW}) - epoch_us(list_max(list_transform(evidence_list, lambda e: e.collected_at)))) / 86400000000.0::DOUBLE) AS days FROM p WHERE len(src) > 0)
        SELECT ord, round(base, 6) AS base, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, base + CASE WHEN {_GIVEN.format('doi')} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN {_GIVEN.format('pdf_url')} THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END)
        - CASE WHEN days > 730 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END), 6) AS adjusted FROM q""",
    "evidence_union_capped": _union_sql(""),
    "evidence_union_best": _union_sql("coalesce(CASE WHEN isnan(confidence) THEN confidence ELSE -confidence END, 'inf'::DOUBLE),"),
    "enrich_chain": r"""WITH p AS (SELECT ord, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, trim(regexp_replace(trim(regexp_replace(venue, '\s+', ' ', 'g')), ',\s*(19|20)[0-9]{2}\s*$', '')) AS venue,
        CASE WHEN coalesce(length(trim(doi)) > 0, false) THEN doi ELSE coalesce(nullif(regexp_extract(concat_ws(' ', url, pdf_url, abstract), '(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)', 1), ''), doi) END AS doi,
        CASE WHEN coalesce(length(trim(pdf_url)) > 0, false) THEN pdf_url ELSE coalesce(CASE WHEN lower(url) LIKE '%.pdf' THEN url WHEN contains(url, '/abs/') THEN replace(url, '/abs/', '/pdf/') || '.pdf' END, pdf_url) END AS pdf_url,
        list_filter(list_transform(authors, lambda a: trim(regexp_replace(a.name, '\s+', ' ', 'g'))), lambda n: coalesce(length(n) > 0, false)) AS ns FROM papers)
        SELECT ord, title, venue, doi, pdf_url, array_to_string(list_filter(ns, lambda n, i: list_position(list_transform(ns, lambda x: lower(x)), lower(n)) = i), '; ') AS names FROM p""",
}
# Records of little confidence are warned of as well: the confidence is that of completeness_scores.
ORACLES["valid_papers"] = f"WITH v AS ({ORACLES['valid_papers']}), c AS ({ORACLES['completeness_scores']}) SELECT ord, errors, CASE WHEN c.confidence < 0.5 THEN CASE WHEN warnings = '' THEN 'confidence' ELSE warnings || ',confidence' END ELSE warnings END AS warnings, valid FROM v JOIN c USING (ord)"
