"""Queries on duplicates, fusion, edges and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.text import work_key
from quillspark.operators import edges, fusion, upserts
from quillspark.operators.components import connected_components
from quillspark.plans.records import _ARXIV, _TITLE, _WORK
from quillspark.sources.tables import table


def exact_cluster_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Records of one id fused into one."""
    return fusion.fuse(table(spark, d, "papers").withColumn("cluster", F.col("id")), "cluster").drop("id")


def fused_keywords(spark: SparkSession, d: str) -> DataFrame:
    return fusion.united_lists(table(spark, d, "papers"), "id", "keywords")


def field_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return fusion.field_conflicts(table(spark, d, "papers"), "id")


def id_components(spark: SparkSession, d: str) -> DataFrame:
    """Papers linked by an equal identifier, internal id or link, closed transitively."""
    papers = table(spark, d, "papers")
    found = connected_components(fusion.id_edges(fusion.match_features(papers)))
    return found.select(F.col("vertex").alias("ord"), "component")


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct titles with a Jaccard similarity of .75 or more, by prefix filtering."""
    titles = fusion.match_features(table(spark, d, "papers")).where(F.size("words") > 0).groupBy("title").agg(F.first("words").alias("words"))
    return fusion.similar_titles(titles)


def dedup_full(spark: SparkSession, d: str) -> DataFrame:
    """Every paper with its cluster under all match rules."""
    return fusion.dedup_clusters(table(spark, d, "papers"))


def authorship_table(spark: SparkSession, d: str) -> DataFrame:
    return edges.authorships(table(spark, d, "papers"))


def coauthor_pairs(spark: SparkSession, d: str) -> DataFrame:
    return edges.coauthor_pairs(edges.authorships(table(spark, d, "papers")))


def author_papers(spark: SparkSession, d: str) -> DataFrame:
    """For every known author the number of papers and the years spanned."""
    rows = edges.authorships(table(spark, d, "papers")).where(~F.col("author").startswith("~"))
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("n_papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def citations_by_direction(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct works each work cites, and how many cite it."""
    e = edges.citation_edges(table(spark, d, "snapshot_citations"))
    ends = e.select(F.explode(F.array(F.struct(F.col("citing").alias("work"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("cited").alias("work"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.work").agg(F.sum("x.o").alias("cites"), F.sum("x.i").alias("cited_by"))


def resolve_bylines(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "papers").select("ord", F.explode("authors").alias("a")).select("ord", "a.position", "a.author_id", "a.name")
    return edges.resolve_names(entries, table(spark, d, "authors").select("id", "name")).select("ord", "position", "resolved")


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Papers as a batch: the last delivery of each id is stored."""
    papers = table(spark, d, "papers").select("id", "ord", "title", "year", "citations")
    return upserts.last_wins(papers, ["id"], "ord")


def paper_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Even deliveries stored first, odd ones on top of them."""
    papers = table(spark, d, "papers").select("id", "ord", "title", "year")
    old, new = upserts.last_wins(papers.where("ord % 2 = 0"), ["id"], "ord"), upserts.last_wins(papers.where("ord % 2 = 1"), ["id"], "ord")
    return upserts.upsert(old, new, ["id"])


def citation_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One row a citation pair: the first delivery's number is kept, the time is the latest delivery's."""
    rows = table(spark, d, "snapshot_citations").select("ord", work_key(F.col("citing_id")).alias("citing"), work_key(F.col("cited_id")).alias("cited"), F.unix_micros("recorded_at").alias("at")).where("citing IS NOT NULL AND cited IS NOT NULL")
    last = rows.agg(F.max("ord").alias("_m")).withColumn("_one", F.lit(1))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").drop("_one")
    half = F.lit(2) * F.col("ord") <= F.col("_m")
    first = rows.where(half).groupBy("citing", "cited").agg(F.min("ord").alias("ord"), F.max("at").alias("at"))
    later = rows.where(~half).groupBy("citing", "cited").agg(F.min("ord").alias("ord"), F.max("at").alias("at"))
    return upserts.upsert_keep(first, later, ["citing", "cited"], ["ord"])


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Citations that remain when all deleted works are removed with their edges."""
    gone = table(spark, d, "snapshot_works").groupBy(work_key(F.col("id")).alias("id")).agg(F.min(F.col("deleted_at").isNotNull().cast("int")).alias("g")).where("g = 1").select("id")
    return upserts.delete_keys(edges.citation_edges(table(spark, d, "snapshot_citations")), gone, ["citing", "cited"])


def collapse_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Migration: repeated citation rows collapsed to the one with the smallest number."""
    rows = table(spark, d, "snapshot_citations").select("ord", work_key(F.col("citing_id")).alias("citing"), work_key(F.col("cited_id")).alias("cited")).where("citing IS NOT NULL AND cited IS NOT NULL")
    return rows.groupBy("citing", "cited").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n_rows"))


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of all stored tables."""
    names = ("papers", "authors", "snapshot_works", "snapshot_citations", "s2_papers", "documents")
    parts = [table(spark, d, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        exact_cluster_fuse, fused_keywords, field_conflicts, id_components, jaccard_pairs, dedup_full, authorship_table, coauthor_pairs, author_papers, citations_by_direction, resolve_bylines,
        upsert_last_wins, paper_upsert, citation_upsert, delete_cascade, collapse_pairs, table_counts,
    )
}

_CONF = "coalesce(list_max(list_transform(list_filter(evidence_list, lambda e: e.confidence >= 0 AND e.confidence <= 1), lambda e: e.confidence)), 0.0::DOUBLE)"
_P = f"p AS (SELECT *, {_CONF} AS conf FROM papers WHERE id IS NOT NULL)"
_FIRST = ", ".join(f"arg_min({c}, (-conf, ord)) FILTER ({c} IS NOT NULL{t}) AS {c}" for c, t in [(c, f" AND {c} <> ''") for c in ("venue", "venue_type", "abstract", "doi", "arxiv_id", "pmid", "url", "pdf_url")] + [("year", ""), ("reference_count", "")])
_VT = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(replace({0}, '&', ' and ')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')), ' '), lambda t: t NOT IN ('', 'the', 'of', 'and'))"
_KEY = r"nullif(trim(upper(regexp_replace(regexp_replace(trim({0}), '^.*[/:#=]\s*([^/:#=]+)/?$', '\1'), '/$', ''))), '')"
_SHIP = f"""ships AS (SELECT paper, author, min(position) AS position, min(year) AS year FROM (
  SELECT coalesce(id, 'ord:' || CAST(ord AS VARCHAR)) AS paper, year, a.position AS position, coalesce({_KEY.format('a.author_id')}, '~' || {_TITLE.format('a.name')}) AS author FROM (SELECT id, ord, year, unnest(authors) AS a FROM papers)) GROUP BY paper, author)"""
_EDGES = f"edges AS (SELECT DISTINCT {_WORK.format('citing_id')} AS citing, {_WORK.format('cited_id')} AS cited FROM snapshot_citations WHERE {_WORK.format('citing_id')} <> {_WORK.format('cited_id')})"
_FEAT = f"""feat AS (SELECT ord, lower(doi) AS doi, {_ARXIV.format('arxiv_id')} AS arxiv, trim(pmid) AS pmid, lower(regexp_replace(url, '/+$', '')) AS url, nullif(id, '') AS id,
  list_sort(list_distinct(list_filter(string_split({_TITLE.format('title')}, ' '), lambda t: t <> ''))) AS words FROM papers)"""
ORACLES = {
    "exact_cluster_fuse": f"WITH {_P} SELECT id AS cluster, count(*) AS n_records, arg_min(title, (-conf, ord)) AS title, {_FIRST}, max(citations) AS citations FROM p GROUP BY id",
    "fused_keywords": f"WITH {_P}, k AS (SELECT id, conf, ord, unnest(keywords) AS value, generate_subscripts(keywords, 1) AS i FROM p) SELECT id, lower(value) AS key, arg_min(value, (-conf, ord, i)) AS value FROM k GROUP BY 1, 2",
    "field_conflicts": f"""WITH {_P}, w AS (SELECT id, arg_min(ord, (-conf, ord)) AS word FROM p GROUP BY id), j AS (SELECT p.*, b.ord AS bo, b.year AS byear, b.venue AS bvenue, b.title AS btitle FROM p JOIN w USING (id) JOIN p b ON b.ord = w.word WHERE p.ord <> b.ord),
        v AS (SELECT *, {_VT.format('venue')} AS va, {_VT.format('bvenue')} AS vb FROM j)
        SELECT id, ord, 'year' AS field FROM v WHERE abs(year - byear) > 1
        UNION ALL SELECT id, ord, 'venue' FROM v WHERE venue <> '' AND bvenue <> '' AND NOT (va = vb OR (len(va) > 0 AND len(va) = len(vb) AND list_bool_and(list_transform(va, lambda t, i: starts_with(t, vb[i]) OR starts_with(vb[i], t)))))
        UNION ALL SELECT id, ord, 'title' FROM v WHERE {_TITLE.format('title')} <> {_TITLE.format('btitle')}""",
    "id_components": f"""WITH RECURSIVE {_FEAT}, ids AS (SELECT ord, 'doi' AS f, doi AS v FROM feat UNION ALL SELECT ord, 'arxiv', arxiv FROM feat UNION ALL SELECT ord, 'pmid', pmid FROM feat UNION ALL SELECT ord, 'url', url FROM feat UNION ALL SELECT ord, 'id', id FROM feat),
        firsts AS (SELECT f, v, min(ord) AS b FROM ids WHERE v <> '' GROUP BY f, v HAVING count(*) > 1), l AS (SELECT DISTINCT ids.ord AS a, b FROM ids JOIN firsts USING (f, v)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT a AS ord, min(b) AS component FROM reach GROUP BY a""",
    "jaccard_pairs": f"""WITH o AS (SELECT DISTINCT {_TITLE.format('title')} AS t FROM papers), w AS (SELECT t, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS ws FROM o WHERE t <> ''),
        j AS (SELECT a.t AS t1, b.t AS t2, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) + len(b.ws) AS s FROM w a JOIN w b ON a.t < b.t) SELECT t1, t2 FROM j WHERE i / (s - i)::DOUBLE >= 0.75""",
    "authorship_table": f"WITH {_SHIP} SELECT * FROM ships",
    "coauthor_pairs": f"WITH {_SHIP} SELECT x.author AS a, y.author AS b, count(DISTINCT x.paper) AS papers, min(py.year) AS first_year, max(py.year) AS last_year FROM ships x JOIN ships y ON x.paper = y.paper AND x.author < y.author JOIN (SELECT paper, min(year) AS year FROM ships WHERE author[1] <> '~' GROUP BY paper) py ON py.paper = x.paper WHERE x.author[1] <> '~' AND y.author[1] <> '~' GROUP BY 1, 2",
    "author_papers": f"WITH {_SHIP} SELECT author, count(*) AS n_papers, min(year) AS first_year, max(year) AS last_year FROM ships WHERE author[1] <> '~' GROUP BY author",
    "citations_by_direction": f"WITH {_EDGES} SELECT work, CAST(sum(o) AS BIGINT) AS cites, CAST(sum(i) AS BIGINT) AS cited_by FROM (SELECT citing AS work, 1 AS o, 0 AS i FROM edges UNION ALL SELECT cited, 0, 1 FROM edges) GROUP BY work",
    "resolve_bylines": f"WITH k AS (SELECT lower(trim(name)) AS n, min(id) AS id FROM authors WHERE name IS NOT NULL GROUP BY 1) SELECT ord, a.position AS position, coalesce({_KEY.format('a.author_id')}, k.id, '~' || lower(trim(a.name))) AS resolved FROM (SELECT ord, unnest(authors) AS a FROM papers) LEFT JOIN k ON k.n = lower(trim(a.name))",
    "upsert_last_wins": "SELECT id, ord, title, year, citations FROM papers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1",
    "paper_upsert": "SELECT id, ord, title, year FROM papers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord % 2 DESC, ord DESC) = 1",
    "citation_upsert": f"""WITH r AS (SELECT ord, {_WORK.format('citing_id')} AS citing, {_WORK.format('cited_id')} AS cited, epoch_us(recorded_at) AS at_us FROM snapshot_citations), w AS (SELECT * FROM r WHERE citing IS NOT NULL AND cited IS NOT NULL), h AS (SELECT *, 2 * ord > (SELECT max(ord) FROM w) AS late FROM w)
        SELECT citing, cited, min(ord) AS ord, coalesce(max(at_us) FILTER (late), max(at_us)) AS at FROM h GROUP BY citing, cited""",
    "delete_cascade": f"WITH {_EDGES}, gone AS (SELECT {_WORK.format('id')} AS id FROM snapshot_works GROUP BY 1 HAVING bool_and(deleted_at IS NOT NULL)) SELECT citing, cited FROM edges WHERE citing NOT IN (SELECT id FROM gone WHERE id IS NOT NULL) AND cited NOT IN (SELECT id FROM gone WHERE id IS NOT NULL)",
    "collapse_pairs": f"SELECT {_WORK.format('citing_id')} AS citing, {_WORK.format('cited_id')} AS cited, min(ord) AS ord, count(*) AS n_rows FROM snapshot_citations WHERE {_WORK.format('citing_id')} IS NOT NULL AND {_WORK.format('cited_id')} IS NOT NULL GROUP BY 1, 2",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ("papers", "authors", "snapshot_works", "snapshot_citations", "s2_papers", "documents")),
}
