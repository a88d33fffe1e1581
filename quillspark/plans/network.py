"""Queries on the citation graph, citing works, changes and author pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.text import work_key
from quillspark.operators import changes, citing, edges, graph
from quillspark.operators.upserts import last_wins
from quillspark.plans.fusion import _EDGES, _KEY, _WORK
from quillspark.plans.records import NOW, _NOW
from quillspark.session import stored
from quillspark.sources.tables import table

DEPTH, BUDGET = 3, 50


def _edges(spark: SparkSession, d: str) -> DataFrame:
    e = edges.citation_edges(table(spark, d, "snapshot_citations"))
    return stored(e.select(F.col("citing").alias("source"), F.col("cited").alias("target"), F.lit("references").alias("relation")))


def _start(e: DataFrame) -> DataFrame:
    """The work that cites most others (then the smallest id)."""
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(1).select(F.col("source").alias("node"))


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(e := _edges(spark, d), _start(e))


def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs_levels(e := _edges(spark, d), _start(e), DEPTH)


def ego_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges among the nodes within two undirected hops of the start."""
    return graph.ego_subgraph(e := _edges(spark, d), _start(e), 2)[1]


def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.shortest_paths(e := _edges(spark, d), _start(e), DEPTH)
    return rows.select("node", "length", F.array_join("path", ">").alias("path"))


def expand_budgeted(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand_budgeted(e := _edges(spark, d), _start(e), DEPTH, BUDGET)


def edge_upserts(spark: SparkSession, d: str) -> DataFrame:
    """One edge an ordered pair over citations and their reverses; the later delivery's relation stays."""
    rows = table(spark, d, "snapshot_citations").select("ord", work_key(F.col("citing_id")).alias("x"), work_key(F.col("cited_id")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = rows.select(F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("target"), F.lit("references").alias("relation"), (F.col("ord") * 2).alias("o")), F.struct(F.col("y").alias("source"), F.col("x").alias("target"), F.lit("citations").alias("relation"), (F.col("ord") * 2 + 1).alias("o")))).alias("e"))
    return graph.upsert_edges(both.select("e.*"), "o")


def _snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return citing.inverted_edges(table(spark, d, "snapshot_citations")), citing.load_works(table(spark, d, "snapshot_works"))


def snapshot_load(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d)[1]


def snapshot_citing(spark: SparkSession, d: str) -> DataFrame:
    """Every citation with the citing work's year and citations."""
    return citing.citing_works(*_snapshot(spark, d)).select("cited", "citing", "year", "cited_by_count")


def snapshot_top_citing(spark: SparkSession, d: str) -> DataFrame:
    """The three most-cited citing works of each work."""
    return citing.top_citing(*_snapshot(spark, d), 3).select("cited", "citing", "cited_by_count", "rank")


def snapshot_doi_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The best row for each DOI of the snapshot (most citations, then smallest id)."""
    works = _snapshot(spark, d)[1].where("doi IS NOT NULL")
    return works.groupBy(F.lower("doi").alias("key")).agg(F.min_by(F.struct("id", "cited_by_count"), F.struct(-F.coalesce("cited_by_count", F.lit(-1)), F.col("id"))).alias("w")).select("key", "w.id", "w.cited_by_count")


def snapshot_stats(spark: SparkSession, d: str) -> DataFrame:
    """Works, edges, edges without a citing work, and self-citations in the index."""
    e, w = _snapshot(spark, d)
    keys = w.select(F.col("id").alias("citing")).withColumn("_w", F.lit(1))
    joined = e.join(keys, "citing", "left").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("_w").isNull().cast("bigint")).alias("n_dangling"), F.sum((F.col("cited") == F.col("citing")).cast("bigint")).alias("n_self"))
    totals = joined.withColumn("n_works", F.lit(0).cast("bigint")).unionByName(w.agg(F.count(F.lit(1)).alias("n_works")).select(*[F.lit(0).cast("bigint").alias(c) for c in ("n_edges", "n_dangling", "n_self")], "n_works"))
    return totals.agg(*[F.sum(c).alias(c) for c in totals.columns])


def snapshot_resume(spark: SparkSession, d: str) -> DataFrame:
    """Monthly parts of the citation feed that still have to be built when all months before 2024 are done."""
    parts = table(spark, d, "snapshot_citations").groupBy(F.date_format("recorded_at", "yyyy-MM").alias("part")).agg(F.count(F.lit(1)).alias("n_records"))
    built = parts.where("part < '2024-01'").select("part")
    return parts.join(built, "part", "left_anti")


def citing_merge(spark: SparkSession, d: str) -> DataFrame:
    """Works of two sources by DOI: papers first, then the snapshot; the first of a key is kept, untitled ones give way."""
    a = table(spark, d, "papers").select(F.col("doi").alias("key"), "title", "year", F.lit("papers").alias("source"), F.lit(0).alias("rank"), F.col("ord").alias("position"))
    w = table(spark, d, "snapshot_works").select(F.col("doi").alias("key"), "title", "year", F.lit("snapshot").alias("source"), F.lit(1).alias("rank"), F.unix_micros("loaded_at").alias("position"))
    return citing.merge_sources(a.unionByName(w), "key", "rank", "position", prefer_titled=True).select("key", "source", "year", "title")


def citing_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows pulled and keys written per source after merging."""
    a = table(spark, d, "papers").select(F.col("doi").alias("key"), "title", F.lit("papers").alias("source"), F.lit(0).alias("rank"), F.col("ord").alias("position"))
    w = table(spark, d, "snapshot_works").select(F.col("doi").alias("key"), "title", F.lit("snapshot").alias("source"), F.lit(1).alias("rank"), F.unix_micros("loaded_at").alias("position"))
    rows = a.unionByName(w)
    kept = citing.merge_sources(rows, "key", "rank", "position").groupBy("source").agg(F.count(F.lit(1)).alias("written"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("pulled")).join(kept, "source", "left").select("source", "pulled", F.coalesce("written", F.lit(0)).alias("written"))


def flatten_authors(spark: SparkSession, d: str) -> DataFrame:
    return citing.flatten_authors(table(spark, d, "papers"))


def flatten_authors_filtered(spark: SparkSession, d: str) -> DataFrame:
    return citing.flatten_authors(table(spark, d, "papers"), "University of")


def top_works(spark: SparkSession, d: str) -> DataFrame:
    return citing.top_works(table(spark, d, "papers"))


def author_profiles(spark: SparkSession, d: str) -> DataFrame:
    return citing.author_profiles(table(spark, d, "papers"))


def profile_join(spark: SparkSession, d: str) -> DataFrame:
    return citing.join_profiles(citing.flatten_authors(table(spark, d, "papers")), table(spark, d, "authors").select("id", "name", "h_index", "citations"))


def detect_changes_keyed(spark: SparkSession, d: str) -> DataFrame:
    """Odd deliveries as a new collection against the even ones as stored."""
    papers = table(spark, d, "papers").select("ord", "id", "authors", *changes.TRACKED)
    return changes.detect_changes(papers.where("ord % 2 = 1"), papers.where("ord % 2 = 0"))


def change_counts(spark: SparkSession, d: str) -> DataFrame:
    return detect_changes_keyed(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    """Papers of which some source was last asked more than a year ago, or never."""
    each = table(spark, d, "papers").where("id IS NOT NULL").select(F.col("id").alias("entity"), F.explode("evidence_list").alias("e"))
    synced = each.select("entity", F.col("e.source").alias("source"), F.col("e.collected_at").alias("at"))
    asked = table(spark, d, "papers").where("id IS NOT NULL").select(F.col("id").alias("entity"), F.explode(F.array(F.lit("openalex"), F.lit("crossref"))).alias("source"))
    return changes.stale(asked, synced, F.lit(NOW), 365)


def author_features(spark: SparkSession, d: str) -> DataFrame:
    """Affiliation, topic, coauthor, year and venue overlap of author pairs that may be one person."""
    rows = changes.author_features(changes.author_pairs(table(spark, d, "authors")))
    return rows.select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), *[F.round(c, 9).alias(c) for c in ("affiliation", "topic", "coauthor", "years", "venue")])


def disambiguate_scores(spark: SparkSession, d: str) -> DataFrame:
    return changes.author_scores(changes.author_pairs(table(spark, d, "authors")))


def stored_papers(spark: SparkSession, d: str) -> DataFrame:
    """The stored projection of papers: nested columns as compact JSON, timestamps dropped, last delivery a key."""
    rows = last_wins(table(spark, d, "papers").select("id", "ord", "title", "year", "keywords", "fields_of_study"), ["id"], "ord")
    return rows.select("id", "title", "year", F.to_json("keywords").alias("keywords"), F.to_json("fields_of_study").alias("fields_of_study"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_neighbours, bfs_levels, ego_subgraph, shortest_paths, expand_budgeted, edge_upserts, snapshot_load, snapshot_citing, snapshot_top_citing, snapshot_doi_lookup, snapshot_stats, snapshot_resume,
        citing_merge, citing_counts, flatten_authors, flatten_authors_filtered, top_works, author_profiles, profile_join, detect_changes_keyed, change_counts, stale_sources, author_features, disambiguate_scores, stored_papers,
    )
}

_START = f"{_EDGES}, start AS (SELECT citing AS node FROM edges GROUP BY citing ORDER BY count(*) DESC, citing LIMIT 1)"
_LEVELS = "lv AS (SELECT node, 0 AS level FROM start UNION SELECT e.cited, lv.level + 1 FROM lv JOIN edges e ON e.citing = lv.node WHERE lv.level < 3), best AS (SELECT node, min(level) AS level FROM lv GROUP BY node)"
_WORKS = f"works AS (SELECT k AS id, w.title AS title, w.year AS year, w.doi AS doi, w.cited_by_count AS cited_by_count FROM (SELECT {_WORK.format('id')} AS k, arg_min({{'title': title, 'year': year, 'doi': doi, 'cited_by_count': cited_by_count}}, (loaded_at, coalesce(title, ''), coalesce(year, 0), coalesce(cited_by_count, 0))) AS w FROM snapshot_works GROUP BY 1) WHERE k IS NOT NULL)"
_INV = f"inv AS (SELECT DISTINCT {_WORK.format('cited_id')} AS cited, {_WORK.format('citing_id')} AS citing FROM snapshot_citations WHERE {_WORK.format('cited_id')} IS NOT NULL AND {_WORK.format('citing_id')} IS NOT NULL)"
_SRC = "src AS (SELECT doi AS key, title, year, 'papers' AS source, 0 AS rank, ord AS position FROM papers UNION ALL SELECT doi, title, year, 'snapshot', 1, epoch_us(loaded_at) FROM snapshot_works)"
_SLOTS = f"slots AS (SELECT ord, i, a.name AS name, a.affiliation AS affiliation, {_KEY.format('a.author_id')} AS id FROM (SELECT ord, unnest(authors) AS a, generate_subscripts(authors, 1) AS i FROM papers) WHERE a.name IS NOT NULL)"
_FLAT = "SELECT coalesce('id:' || id, 'name:' || name) AS author, arg_min(name, (ord, i)) AS name, arg_min({'x': affiliation}, (ord, i)).x AS affiliation, count(DISTINCT ord) AS n_papers, min(ord) AS first_ord FROM slots"
_CHG = ", ".join(
    f"CASE WHEN {('trim(o.%s)' if t else 'o.%s') % c} IS DISTINCT FROM {('trim(n.%s)' if t else 'n.%s') % c} THEN '{c}' END" for c, t in (("title", 1), ("year", 0), ("venue", 1), ("abstract", 1), ("doi", 1), ("url", 1), ("pdf_url", 1), ("citations", 0))
)
_DETECT = f"""news AS (SELECT *, nullif(id, '') AS k1, nullif(lower(doi), '') AS k2, nullif(lower(regexp_replace(url, '/+$', '')), '') AS k3, CASE WHEN title IS NOT NULL THEN title || '|' || coalesce(array_to_string(list_filter(list_transform(authors, lambda a: a.name), lambda x: x IS NOT NULL), '|'), '') || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || coalesce(venue, '') END AS k4 FROM papers WHERE ord % 2 = 1),
olds AS (SELECT *, nullif(id, '') AS k1, nullif(lower(doi), '') AS k2, nullif(lower(regexp_replace(url, '/+$', '')), '') AS k3, CASE WHEN title IS NOT NULL THEN title || '|' || coalesce(array_to_string(list_filter(list_transform(authors, lambda a: a.name), lambda x: x IS NOT NULL), '|'), '') || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || coalesce(venue, '') END AS k4 FROM papers WHERE ord % 2 = 0),
m AS (SELECT n.ord AS n_ord, coalesce((SELECT max(ord) FROM olds o WHERE o.k1 = n.k1), (SELECT max(ord) FROM olds o WHERE o.k2 = n.k2), (SELECT max(ord) FROM olds o WHERE o.k3 = n.k3), (SELECT max(ord) FROM olds o WHERE o.k4 = n.k4)) AS o_ord FROM news n),
chg AS (SELECT m.n_ord AS ord, m.o_ord AS old_ord, CASE WHEN m.o_ord IS NOT NULL THEN array_to_string(list_filter([{_CHG}], lambda x: x IS NOT NULL), ',') END AS changed FROM m JOIN papers n ON n.ord = m.n_ord LEFT JOIN papers o ON o.ord = m.o_ord),
detected AS (SELECT ord, CASE WHEN old_ord IS NULL THEN 'new' WHEN changed <> '' THEN 'updated' ELSE 'unchanged' END AS change, old_ord, changed FROM chg)"""

ORACLES = {
    "graph_neighbours": f"WITH {_START} SELECT citing AS node, cited AS neighbour FROM edges JOIN start ON citing = node",
    "bfs_levels": f"WITH RECURSIVE {_START}, {_LEVELS} SELECT node, level FROM best",
    "ego_subgraph": f"""WITH RECURSIVE {_START}, both_ways AS (SELECT citing AS s, cited AS t FROM edges UNION ALL SELECT cited, citing FROM edges),
        lv AS (SELECT node, 0 AS level FROM start UNION SELECT t, level + 1 FROM lv JOIN both_ways ON s = node WHERE level < 2), ins AS (SELECT DISTINCT node FROM lv)
        SELECT citing AS source, cited AS target FROM edges WHERE citing IN (SELECT node FROM ins) AND cited IN (SELECT node FROM ins)""",
    "shortest_paths": f"""WITH RECURSIVE {_START}, {_LEVELS}, l1 AS (SELECT b.node, min(e.citing) AS parent FROM best b JOIN edges e ON e.cited = b.node JOIN best p ON p.node = e.citing AND p.level = b.level - 1 GROUP BY b.node),
        paths AS (SELECT node, 0 AS length, node AS path FROM start UNION ALL SELECT l1.node, p.length + 1, p.path || '>' || l1.node FROM paths p JOIN l1 ON l1.parent = p.node) SELECT node, length, path FROM paths""",
    "edge_upserts": f"""WITH r AS (SELECT ord, {_WORK.format('citing_id')} AS x, {_WORK.format('cited_id')} AS y FROM snapshot_citations), b AS (SELECT x AS source, y AS target, 'references' AS relation, ord * 2 AS o FROM r WHERE x <> y UNION ALL SELECT y, x, 'citations', ord * 2 + 1 FROM r WHERE x <> y)
        SELECT source, target, arg_max(relation, o) AS relation FROM b GROUP BY source, target""",
    "snapshot_load": f"WITH {_WORKS} SELECT * FROM works",
    "snapshot_citing": f"WITH {_WORKS}, {_INV} SELECT cited, citing, year, cited_by_count FROM inv JOIN works ON id = citing",
    "snapshot_top_citing": f"WITH {_WORKS}, {_INV} SELECT cited, citing, cited_by_count, CAST(row_number() OVER (PARTITION BY cited ORDER BY cited_by_count DESC NULLS LAST, citing) AS INT) AS rank FROM inv JOIN works ON id = citing QUALIFY rank <= 3",
    "snapshot_doi_lookup": f"WITH {_WORKS} SELECT lower(doi) AS key, id, cited_by_count FROM works WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(doi) ORDER BY coalesce(cited_by_count, -1) DESC, id) = 1",
    "snapshot_stats": f"WITH {_WORKS}, {_INV} SELECT count(*) AS n_edges, CAST(sum((w.id IS NULL)::INT) AS BIGINT) AS n_dangling, CAST(sum((cited = citing)::INT) AS BIGINT) AS n_self, (SELECT count(*) FROM works) AS n_works FROM inv LEFT JOIN works w ON w.id = citing",
    "snapshot_resume": "SELECT strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS part, count(*) AS n_records FROM snapshot_citations GROUP BY 1 HAVING part >= '2024-01'",
    "citing_merge": f"WITH {_SRC} SELECT key, source, year, title FROM src WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY title IS NULL, rank, position) = 1",
    "citing_counts": f"WITH {_SRC}, k AS (SELECT source FROM src WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, position) = 1) SELECT source, count(*) AS pulled, (SELECT count(*) FROM k WHERE k.source = src.source) AS written FROM src GROUP BY source",
    "flatten_authors": f"WITH {_SLOTS} {_FLAT} GROUP BY 1",
    "flatten_authors_filtered": f"WITH {_SLOTS} {_FLAT} WHERE contains(affiliation, 'University of') GROUP BY 1",
    "top_works": f"WITH r AS (SELECT DISTINCT ord, citations, {_KEY.format('a.author_id')} AS author FROM (SELECT ord, citations, unnest(authors) AS a FROM papers)) SELECT ord, citations, author, CAST(row_number() OVER (PARTITION BY author ORDER BY citations DESC NULLS LAST, ord) AS INT) AS rank FROM r WHERE author IS NOT NULL QUALIFY rank <= 5",
    "author_profiles": f"""WITH r AS (SELECT DISTINCT ON (author, ord) ord, citations, keywords, {_KEY.format('a.author_id')} AS author FROM (SELECT ord, citations, keywords, unnest(authors) AS a FROM papers) WHERE {_KEY.format('a.author_id')} IS NOT NULL),
        w AS (SELECT author, lower(k) AS k, min((ord, i)) AS o FROM (SELECT author, ord, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS i FROM r) GROUP BY 1, 2), t AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY author ORDER BY o) <= 15), g AS (SELECT author, string_agg(k, '; ' ORDER BY o) AS keywords FROM t GROUP BY author)
        SELECT author, CAST(sum(citations) AS BIGINT) AS citations, count(*) AS n_papers, any_value(g.keywords) AS keywords FROM r LEFT JOIN g USING (author) GROUP BY author""",
    "profile_join": f"""WITH {_SLOTS}, f AS ({_FLAT} GROUP BY 1), p AS (SELECT 'id:' || id AS author, min({{'id': id, 'h_index': coalesce(h_index, -1), 'citations': coalesce(citations, -1)}}) AS p FROM authors GROUP BY 1 UNION ALL SELECT 'name:' || name, min({{'id': id, 'h_index': coalesce(h_index, -1), 'citations': coalesce(citations, -1)}}) FROM authors GROUP BY 1 HAVING count(DISTINCT id) = 1)
        SELECT author, n_papers, p.p.id AS profile, nullif(p.p.h_index, -1) AS h_index, starts_with(author, 'name:') AS by_name FROM f LEFT JOIN p USING (author)""",
    "detect_changes_keyed": f"WITH {_DETECT} SELECT * FROM detected",
    "change_counts": f"WITH {_DETECT} SELECT change, count(*) AS n FROM detected GROUP BY change",
    "stale_sources": f"""WITH s AS (SELECT id AS entity, e.source AS source, max(e.collected_at) AS at_time FROM (SELECT id, unnest(evidence_list) AS e FROM papers WHERE id IS NOT NULL) GROUP BY 1, 2), q AS (SELECT DISTINCT id AS entity, source FROM papers, (VALUES ('openalex'), ('crossref')) v(source) WHERE id IS NOT NULL)
        SELECT entity, bool_or(at_time IS NULL OR at_time < {_NOW} - INTERVAL 365 DAY) AS stale FROM q LEFT JOIN s USING (entity, source) GROUP BY entity""",
    "stored_papers": "SELECT id, title, year, CAST(to_json(keywords) AS VARCHAR) AS keywords, CAST(to_json(fields_of_study) AS VARCHAR) AS fields_of_study FROM papers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1",
}
