"""Queries on results put together from several sources, identity contexts, extraction and incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.ids import record_key
from quillspark.functions.text import work_key
from quillspark.operators import changes, citing, collecting, extraction, refresh
from quillspark.operators.quality import primary_evidence
from quillspark.plans.fusion import _KEY, _WORK
from quillspark.plans.records import _ARXIV, _TITLE, NOW
from quillspark.sources.tables import table

SPEC = extraction.Spec("page", {"heading": extraction.Rule("article h1.title"), "links": extraction.Rule("a", "href", many=True), "kind": extraction.Rule("meta[name=kind]", "content", default="page")})


def _candidates(spark: SparkSession, d: str) -> list[DataFrame]:
    authors = table(spark, d, "authors").select("ord", "name", "citations", "h_index", "openalex_id", "semantic_scholar_id", "id")
    one = lambda source, c: authors.groupBy(F.col(c).alias("id")).agg(F.min_by(F.struct("name", "citations", "h_index"), "ord").alias("r")).select(F.lit(source).alias("source"), "id", "r.*")
    return [one("openalex", "openalex_id"), one("s2", "semantic_scholar_id"), one("openalex", "id")]


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of two catalogues and the stored authors, each id of a source once."""
    return collecting.candidate_union(_candidates(spark, d))


def candidate_order(spark: SparkSession, d: str) -> DataFrame:
    """The eight best candidates for each name, scored by their confidence."""
    rows = table(spark, d, "authors").where("name IS NOT NULL").select(F.lower("name").alias("name"), "id", "ord", "citations", "h_index", primary_evidence("evidence_list")["confidence"].alias("score")).where("id IS NOT NULL")
    rows = rows.groupBy("name", "id").agg(F.max_by(F.struct("citations", "h_index", "score"), "ord").alias("r")).select("name", "id", "r.*")
    return collecting.candidate_order(rows, ["name"], "score", 8).select("name", "id", "place")


def works_context(spark: SparkSession, d: str) -> DataFrame:
    rows = collecting.works_context(table(spark, d, "papers"))
    return rows.select("author", "n_works", F.size("titles").alias("n_titles"), F.array_join("dois", ";").alias("dois"), F.array_join("arxiv_ids", ";").alias("arxiv_ids"))


def papers_in_works(spark: SparkSession, d: str) -> DataFrame:
    """Papers that are among the works of a known author, though their byline gives no id."""
    papers = table(spark, d, "papers").select("ord", "title", "doi", "arxiv_id", "authors")
    works = papers.select("title", "doi", "arxiv_id", F.explode("authors").alias("a")).select(record_key(F.col("a.author_id")).alias("author"), "title", "doi", "arxiv_id").where("author IS NOT NULL")
    without = papers.where(~F.exists("authors", lambda a: record_key(a["author_id"]).isNotNull()))
    return collecting.in_works(without, works)


def institution_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Words that tell the authors' organisations apart, and how many authors have them."""
    return table(spark, d, "authors").select(F.explode(F.array_distinct(collecting.institution_keywords(F.col("affiliation")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def sibling_works(spark: SparkSession, d: str) -> DataFrame:
    """Works of namesakes whose byline names the organisation of another entry of that name."""
    profiles = table(spark, d, "authors").where("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("name", "affiliation"), "ord").alias("p")).select("id", "p.*")
    entries = table(spark, d, "papers").select("ord", "citations", F.explode("authors").alias("a")).select("ord", "citations", record_key(F.col("a.author_id")).alias("author"), "a.affiliation").where("author IS NOT NULL")
    return collecting.sibling_works(profiles.withColumn("id", record_key(F.col("id"))), entries)


def _runs(spark: SparkSession, d: str) -> list[DataFrame]:
    each = table(spark, d, "papers").select("ord", F.explode("evidence_list").alias("e")).select("ord", F.col("e.source").alias("source"), F.col("e.confidence").alias("confidence"))
    count = lambda rows: rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"))
    return [count(each.where("ord % 2 = 0")), count(each.where("ord % 2 = 1 AND confidence > 0.9"))]


def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Figures of two runs: of a source both name, the later run's count."""
    return collecting.merged_results(_runs(spark, d))


def collection_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = collecting.collection_statistics(table(spark, d, "papers"), primary_evidence("evidence_list")["confidence"])
    return rows.select("n_rows", F.round("mean_confidence", 6).alias("mean_confidence"), "empty")


def cluster_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of papers by id, and records merged into them."""
    return collecting.cluster_statistics(table(spark, d, "papers").where("id IS NOT NULL"), "id")


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: those with a value below 10 failed."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("source"), F.coalesce(F.col("value") < 10, F.lit(False)).alias("failed"), F.lit(1).alias("items"), F.concat(F.lit("code "), F.floor("value").cast("string")).alias("message"))
    return collecting.run_counters(rows)


def fallback_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as failures: which are worth asking another source."""
    status = (F.col("event_id") % 200 + 400).cast("int")
    return table(spark, d, "events").select("event_id", status.alias("status")).where(collecting.worth_falling_back(F.col("status"), F.lit("")))


def snapshot_routes(spark: SparkSession, d: str) -> DataFrame:
    """Works by where their citing works come from: the index knows them, or they must be fetched."""
    asked = table(spark, d, "snapshot_works").select(work_key(F.col("id")).alias("work")).where("work IS NOT NULL")
    return collecting.routed(asked, citing.inverted_edges(table(spark, d, "snapshot_citations")), True)


def merged_citing(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty citing works of each work over odd and even deliveries, the first of them credited."""
    rows = table(spark, d, "snapshot_citations").select(work_key(F.col("cited_id")).alias("cited"), work_key(F.col("citing_id")).alias("citing"), (F.col("ord") % 2).alias("rank"), "ord").where("cited IS NOT NULL AND citing IS NOT NULL")
    return collecting.limited_after_merge(rows, "cited", "citing", "rank", "ord", 20)


def open_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Papers by what their evidence tells of open copies: nothing, none, or some."""
    links = collecting.evidence_locations(F.col("evidence_list"))
    return table(spark, d, "papers").select("ord", F.when(links.isNull(), "ask").when(F.size(links) == 0, "none").otherwise("some").alias("told"))


def numbered_entries(spark: SparkSession, d: str) -> DataFrame:
    """Numbered references in documents, their titles told apart."""
    return collecting.numbered_entries(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "n", F.length("raw").alias("n_raw"))


def author_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Byline names with papers but without a profile."""
    return collecting.author_warning(table(spark, d, "papers"), table(spark, d, "authors"))


def extracted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents wrapped as pages, fields extracted by declared rules."""
    n = F.col("doc_id").cast("string")
    page = F.concat(F.when(F.col("doc_id") % 2 == 0, '<meta name="kind" content="paper">').otherwise(""), F.lit("<article><h1 class='big title'>Page <i>"), n, F.lit("</i></h1><h1 class=title>Other</h1></article><h1 class=title>Outside</h1><a href='x/"), n, F.lit("'>one</a><a href=#top>two</a>"))
    rows = extraction.crawled(table(spark, d, "documents").select(n.alias("url"), F.when(F.col("doc_id") % 5 == 0, 404).otherwise(200).alias("status"), page.alias("page")), SPEC)
    one = lambda k: F.try_element_at(F.try_element_at("fields", F.lit(k)), F.lit(1))
    return rows.select("url", "status", one("heading").alias("heading"), one("kind").alias("kind"), F.size(F.try_element_at("fields", F.lit("links"))).alias("n_links"))


def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Relative links of pages made absolute."""
    n = F.col("doc_id").cast("string")
    page = F.concat(F.lit("<a href='../b/"), n, F.lit("#p'>x</a><a href='mailto:a@b'>y</a><a href='/c'>z</a><a href='/c'>z</a>"))
    rows = table(spark, d, "documents").select("doc_id", extraction.absolute_links(page, F.lit("https://example.org/a/index.html")).alias("links"))
    return rows.select("doc_id", F.array_join("links", " ").alias("links"))


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, d, "papers").select("ord", "id", "authors", "keywords", "evidence_list", *changes.TRACKED)
    return papers.where("ord % 2 = 1"), papers.where("ord % 2 = 0")


def detected_changes(spark: SparkSession, d: str) -> DataFrame:
    """Odd deliveries against even ones in all five tiers, each stored record once."""
    return refresh.detect(*_states(spark, d))


def applied_changes(spark: SparkSession, d: str) -> DataFrame:
    """The stored table after those changes are merged and written."""
    new, old = _states(spark, d)
    return refresh.applied(refresh.detect(new, old), new, old)[0].select("id", "title", "year", "citations", F.size("keywords").alias("n_keywords"))


def merged_updates(spark: SparkSession, d: str) -> DataFrame:
    """New states merged with the stored ones that have the same id (each row with the last stored row of its id)."""
    new, old = _states(spark, d)
    last = old.where("id IS NOT NULL").groupBy("id").agg(F.max("ord").alias("old_ord"))
    pairs = new.select("ord", "id").join(last, "id").select("ord", "old_ord")
    rows = refresh.merged(pairs, new, old)
    return rows.select("ord", "old_ord", "id", "title", "year", "venue", "doi", "citations", F.array_join("keywords", ";").alias("keywords"))


def due_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers due for a refresh: no source was asked within a year."""
    each = table(spark, d, "papers").where("id IS NOT NULL").select(F.col("id").alias("entity"), F.explode("evidence_list").alias("e"))
    synced = each.select("entity", F.col("e.source").alias("source"), F.col("e.collected_at").alias("at"))
    entities = table(spark, d, "papers").where("id IS NOT NULL").select(F.col("id").alias("entity")).distinct()
    asked = entities.withColumn("source", F.lit("openalex"))
    return refresh.gate(entities, changes.stale(asked, synced, F.lit(NOW), 365))


QUERIES = {
    f.__name__: f
    for f in (
        candidate_union, candidate_order, works_context, papers_in_works, institution_keywords, sibling_works, merged_runs, collection_statistics, cluster_statistics, run_counters, fallback_events, snapshot_routes, merged_citing, open_evidence,
        numbered_entries, author_warnings, extracted_pages, resolved_links, detected_changes, applied_changes, merged_updates, due_papers,
    )
}

_EVC = "list_max(list_transform(list_filter(coalesce(evidence_list, []), lambda e: e.confidence >= 0 AND e.confidence <= 1), lambda e: e.confidence))"
_CJK = r"nullif(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9一-鿿 ]', ' ', 'g'), ' +', ' ', 'g')), '')"
_BY = f"by_ AS (SELECT ord, title, doi, arxiv_id, citations, {_KEY.format('a.author_id')} AS author, a.affiliation AS affiliation FROM (SELECT ord, title, doi, arxiv_id, citations, unnest(authors) AS a FROM papers))"
_KW = r"list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), lambda t: length(t) >= 3 AND t NOT IN ('and', 'at', 'in', 'of', 'the', 'universities', 'university'))"
_PICK = lambda f, text: f"CASE WHEN fresh THEN coalesce({'nullif(%s, %s)' % ('n.' + f, chr(39) * 2) if text else 'n.' + f}, o.{f}) ELSE coalesce({'nullif(%s, %s)' % ('o.' + f, chr(39) * 2) if text else 'o.' + f}, n.{f}) END AS {f}"
ORACLES = {
    "candidate_union": """WITH r AS (SELECT 0 AS p, 'openalex' AS source, openalex_id AS id, name, citations, h_index, ord FROM authors UNION ALL SELECT 1, 's2', semantic_scholar_id, name, citations, h_index, ord FROM authors UNION ALL SELECT 2, 'openalex', id, name, citations, h_index, ord FROM authors)
        SELECT source, id, name, citations, h_index FROM r WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY p, ord) = 1""",
    "candidate_order": f"""WITH r AS (SELECT lower(name) AS name, id, citations, h_index, {_EVC} AS score FROM authors WHERE name IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(name), id ORDER BY ord DESC) = 1)
        SELECT name, id, CAST(row_number() OVER (PARTITION BY name ORDER BY score IS NULL, score DESC, coalesce(citations, 0) DESC, coalesce(h_index, 0) DESC, id) AS INT) AS place FROM r QUALIFY place <= 8""",
    "works_context": f"""WITH {_BY}, w AS (SELECT author, {_CJK.format('title')} AS t, nullif(lower(doi), '') AS d, {_ARXIV.format('arxiv_id')} AS x FROM by_ WHERE author IS NOT NULL)
        SELECT author, count(*) AS n_works, CAST(count(DISTINCT t) AS INT) AS n_titles, coalesce(string_agg(DISTINCT d, ';' ORDER BY d), '') AS dois, coalesce(string_agg(DISTINCT x, ';' ORDER BY x), '') AS arxiv_ids FROM w GROUP BY author""",
    "papers_in_works": f"""WITH {_BY}, k AS (SELECT ord, author, 'a' AS f, {_ARXIV.format('arxiv_id')} AS v FROM by_ UNION ALL SELECT ord, author, 'd', nullif(lower(doi), '') FROM by_ UNION ALL SELECT ord, author, 't', {_CJK.format('title')} FROM by_),
        p AS (SELECT ord, 'a' AS f, {_ARXIV.format('arxiv_id')} AS v FROM papers UNION ALL SELECT ord, 'd', nullif(lower(doi), '') FROM papers UNION ALL SELECT ord, 't', {_CJK.format('title')} FROM papers)
        SELECT DISTINCT p.ord, k.author FROM p JOIN k ON p.f = k.f AND p.v = k.v WHERE k.author IS NOT NULL AND p.ord NOT IN (SELECT ord FROM by_ WHERE author IS NOT NULL)""",
    "institution_keywords": f"SELECT word, count(*) AS n FROM (SELECT ord, unnest(list_distinct({_KW.format('affiliation')})) AS word FROM authors) GROUP BY word",
    "sibling_works": f"""WITH {_BY}, p AS (SELECT {_KEY.format('id')} AS id, arg_min({{'n': name, 'a': affiliation}}, ord) AS r FROM authors WHERE id IS NOT NULL GROUP BY id), own AS (SELECT id, trim(r.n) AS name, {_KW.format('r.a')} AS k FROM p),
        near AS (SELECT o.id, s.id AS sibling, o.k, dense_rank() OVER (PARTITION BY o.id ORDER BY s.id) AS s FROM own o JOIN (SELECT DISTINCT id, name FROM own) s ON o.name = s.name AND o.id <> s.id WHERE len(o.k) > 0),
        h AS (SELECT n.id, n.sibling, b.ord, max(b.citations) AS citations FROM near n JOIN by_ b ON b.author = n.sibling WHERE s <= 5 AND len(list_filter(n.k, lambda w: contains(lower(coalesce(b.affiliation, '')), w))) > 0 GROUP BY 1, 2, 3)
        SELECT id, sibling, ord, CAST(row_number() OVER (PARTITION BY id, sibling ORDER BY citations DESC NULLS LAST, ord) AS INT) AS place FROM h QUALIFY place <= 5""",
    "merged_runs": """WITH e AS (SELECT ord, e.source AS source, e.confidence AS c FROM (SELECT ord, unnest(evidence_list) AS e FROM papers)), a AS (SELECT source, count(*) AS n FROM e WHERE ord % 2 = 0 GROUP BY 1), b AS (SELECT source, count(*) AS n FROM e WHERE ord % 2 = 1 AND (c > 0.9) GROUP BY 1)
        SELECT coalesce(b.source, a.source) AS source, coalesce(b.n, a.n) AS n_items FROM a FULL JOIN b ON a.source = b.source""",
    "collection_statistics": f"SELECT count(*) AS n_rows, round(coalesce(avg({_EVC}), 0.0), 6) AS mean_confidence, count(*) = 0 AS empty FROM papers",
    "cluster_statistics": "SELECT count(DISTINCT id) AS n_clusters, count(*) - count(DISTINCT id) AS n_merged FROM papers WHERE id IS NOT NULL",
    "run_counters": "SELECT event_type AS source, count(*) AS n_requests, CAST(sum(coalesce(value < 10, false)::INT) AS BIGINT) AS n_failed, CAST(sum((NOT coalesce(value < 10, false))::INT) AS BIGINT) AS n_items, count(DISTINCT CASE WHEN value < 10 THEN floor(value) END) AS n_errors FROM events GROUP BY 1",
    "fallback_events": "SELECT event_id, CAST(event_id % 200 + 400 AS INT) AS status FROM events WHERE event_id % 200 + 400 IN (401, 402, 403, 408, 429) OR event_id % 200 + 400 >= 500",
    "snapshot_routes": f"""WITH i AS (SELECT cited, count(*) AS n FROM (SELECT DISTINCT {_WORK.format('cited_id')} AS cited, {_WORK.format('citing_id')} AS citing FROM snapshot_citations) WHERE cited IS NOT NULL AND citing IS NOT NULL GROUP BY 1)
        SELECT work, CASE WHEN n IS NULL THEN 'fetch' ELSE 'index' END AS route, coalesce(n, 0) AS n FROM (SELECT DISTINCT {_WORK.format('id')} AS work FROM snapshot_works) LEFT JOIN i ON cited = work WHERE work IS NOT NULL""",
    "merged_citing": f"""WITH r AS (SELECT {_WORK.format('cited_id')} AS cited, {_WORK.format('citing_id')} AS citing, min((ord % 2, ord)) AS o FROM snapshot_citations GROUP BY 1, 2)
        SELECT cited, citing, o[1] AS rank, CAST(row_number() OVER (PARTITION BY cited ORDER BY o, citing) AS INT) AS place FROM r WHERE cited IS NOT NULL AND citing IS NOT NULL QUALIFY place <= 20""",
    "open_evidence": "WITH t AS (SELECT ord, list_filter(coalesce(evidence_list, []), lambda e: e.source = 'unpaywall') AS e FROM papers) SELECT ord, CASE WHEN len(e) = 0 THEN 'ask' WHEN len(list_filter(e, lambda x: regexp_matches(x.source_url, '^https?://'))) = 0 THEN 'none' ELSE 'some' END AS told FROM t",
    "numbered_entries": r"""WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '^\s*[0-9]{1,2}\.\s+\S')),
        r AS (SELECT doc_id, i, CAST(regexp_extract(line, '^\s*([0-9]{1,2})\.', 1) AS INT) AS n, trim(regexp_extract(line, '^\s*[0-9]{1,2}\.\s+(.*)$', 1)) AS raw FROM l) SELECT doc_id, n, CAST(length(arg_max(raw, i)) AS INT) AS n_raw FROM r GROUP BY doc_id, n""",
    "author_warnings": f"""WITH n AS (SELECT {_TITLE.format('a.name')} AS author FROM (SELECT unnest(authors) AS a FROM papers)), k AS (SELECT DISTINCT {_TITLE.format('name')} AS author FROM authors)
        SELECT author, count(*) AS n_papers, CASE WHEN author NOT IN (SELECT author FROM k WHERE author IS NOT NULL) THEN 'papers without a profile' END AS warning FROM n WHERE author <> '' GROUP BY author""",
    "extracted_pages": "SELECT CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 <> 0 THEN 'Page ' || doc_id END AS heading, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'paper' ELSE 'page' END END AS kind, CASE WHEN doc_id % 5 <> 0 THEN 2 END AS n_links FROM documents",
    "resolved_links": "SELECT doc_id, 'https://example.org/b/' || doc_id || ' https://example.org/c' AS links FROM documents",
    "merged_updates": f"""WITH l AS (SELECT id, max(ord) AS old_ord FROM papers WHERE ord % 2 = 0 AND id IS NOT NULL GROUP BY id), c AS (SELECT *, coalesce({_EVC}, 0.0) AS conf FROM papers),
        m AS (SELECT n, o, n.conf >= o.conf - 0.1 AS fresh, CASE WHEN n.conf >= o.conf - 0.1 THEN list_concat(coalesce(n.keywords, []), coalesce(o.keywords, [])) ELSE list_concat(coalesce(o.keywords, []), coalesce(n.keywords, [])) END AS w FROM c n JOIN l ON n.id = l.id JOIN c o ON o.ord = l.old_ord WHERE n.ord % 2 = 1)
        SELECT n.ord AS ord, o.ord AS old_ord, coalesce(nullif(o.id, ''), n.id) AS id, {_PICK('title', 1)}, {_PICK('year', 0)}, {_PICK('venue', 1)}, {_PICK('doi', 1)}, greatest(o.citations, n.citations) AS citations, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ';') AS keywords FROM m""",
    "due_papers": "WITH s AS (SELECT id, max(e.collected_at) AS t FROM (SELECT id, unnest(evidence_list) AS e FROM papers WHERE id IS NOT NULL) WHERE e.source = 'openalex' GROUP BY id) SELECT DISTINCT p.id AS entity FROM papers p LEFT JOIN s ON p.id = s.id WHERE p.id IS NOT NULL AND (t IS NULL OR t < TIMESTAMPTZ '2025-06-30 00:00:00+00' - INTERVAL 365 DAY)",
}
