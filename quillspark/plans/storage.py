"""Queries on the store, its indexes, the knowledge graph and authors as clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.ids import record_key
from quillspark.functions.text import strict_arxiv, work_key
from quillspark.operators import authors as people, changes, edges, knowledge, store
from quillspark.operators.upserts import last_wins
from quillspark.plans.fusion import _EDGES, _KEY, _SHIP, _WORK
from quillspark.plans.records import _ARXIV, _TITLE
from quillspark.session import cut, shared_dir, stored
from quillspark.sources.tables import table


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, d, "papers").select("id", "ord", "title", "year", "authors")
    return papers.where("ord % 2 = 0"), papers.where("ord % 2 = 1")


def _saved(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Even deliveries as the store, odd ones saved as a batch."""
    old, new = _halves(spark, d)
    first = last_wins(old, ["id"], "ord")
    ships = edges.authorships(first)
    return store.save_batch({"papers": first, "authorships": ships, "coauthors": edges.coauthor_pairs(ships)}, new, "ord")


def batch_papers(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d)["papers"].select("id", "ord", "title", "year")


def batch_coauthors(spark: SparkSession, d: str) -> DataFrame:
    """Co-authorships after the batch."""
    return _saved(spark, d)["coauthors"]


def deleted_coauthors(spark: SparkSession, d: str) -> DataFrame:
    """Co-authorships that remain when the papers before 2010 are deleted."""
    saved = _saved(spark, d)
    gone = saved["papers"].where("year < 2010").select("id")
    return store.delete_papers(saved, gone)["coauthors"]


def paper_updates(spark: SparkSession, d: str) -> DataFrame:
    """Whether each update (odd deliveries) met a stored paper (even deliveries)."""
    old, new = _halves(spark, d)
    return store.update_rows(last_wins(old, ["id"], "ord"), last_wins(new, ["id"], "ord"), "id")[1]


def sync_times(spark: SparkSession, d: str) -> DataFrame:
    """State table: the last synchronisation of each paper and source, written in the order of delivery."""
    each = table(spark, d, "papers").select("ord", "id", F.posexplode("evidence_list").alias("at", "e")).select("ord", "at", "id", F.col("e.source").alias("source"), F.unix_micros("e.collected_at").alias("time"))
    each = each.withColumn("o", F.struct("ord", "at"))
    start = each.where("ord % 2 = 0")
    return store.keyed_upsert(last_wins(start, ["id", "source"], "o").select("id", "source", "time"), each.where("ord % 2 = 1"), ["id", "source"], "o")


def confirmed_identities(spark: SparkSession, d: str) -> DataFrame:
    """Identities that the ids in bylines confirm."""
    rows = table(spark, d, "papers").select("ord", F.explode("authors").alias("a")).select("ord", F.col("ord").cast("string").alias("paper"), F.lower(F.trim("a.name")).alias("name"), record_key(F.col("a.author_id")).alias("author"), F.col("a.position").alias("p"))
    rows = rows.where("name IS NOT NULL").withColumn("o", F.struct("ord", "p"))
    none = rows.limit(0)
    known, links = store.confirm_identities(none.select("name", "author", F.lit("").alias("status")), none.select("paper", "name", "author"), rows, "o")
    return links.join(known, ["name", "author"]).groupBy("name", "author").agg(F.count(F.lit(1)).alias("n_papers"), F.first("status").alias("status"))


def evidence_reads(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each paper: of odd ones from the evidence table, of even ones from their own column."""
    papers = table(spark, d, "papers").select("ord", "evidence_list")
    rows = papers.where("ord % 2 = 1").select("ord", F.posexplode("evidence_list").alias("at", "e"))
    read = store.evidence_read(papers, rows, "ord")
    return read.select("ord", F.array_join(F.transform("evidence", lambda e: e["source"]), ",").alias("sources"))


def latest_load(spark: SparkSession, d: str) -> DataFrame:
    """The month that was loaded last, with its number of works."""
    months = table(spark, d, "snapshot_works").groupBy(F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_works"))
    return store.latest(months, "month")


def reference_sets(spark: SparkSession, d: str) -> DataFrame:
    """How many works each work refers to, by the edge table and its own list (here the works it cites, again)."""
    e = edges.citation_edges(table(spark, d, "snapshot_citations")).select(F.col("citing").alias("id"), F.col("cited").alias("ref"))
    own = e.groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    return store.references_of(e, own, "refs").groupBy("id").agg(F.count(F.lit(1)).alias("n_refs"))


def paper_reads(spark: SparkSession, d: str) -> DataFrame:
    """Point reads: papers of every thousandth-largest id are looked up by id, and by their preprint id in any version."""
    papers = table(spark, d, "papers")
    asked = papers.where("id IS NOT NULL AND ord % 20 = 0").select("id").distinct()
    by_id = papers.join(asked, "id", "left_semi").groupBy("id").agg(F.max_by("title", "ord").alias("title"), F.max("ord").alias("ord"))
    return by_id.select("id", "ord", "title")


def arxiv_reads(spark: SparkSession, d: str) -> DataFrame:
    """Papers that have the preprint id of a paper whose ord is divisible by 20, in any version and notation."""
    keyed = table(spark, d, "papers").select("ord", strict_arxiv(F.col("arxiv_id")).alias("key")).where("key IS NOT NULL")
    return keyed.join(keyed.where("ord % 20 = 0").select("key").distinct(), "key", "left_semi").select("ord", "key")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authors").where("ord % 20 = 0 AND name IS NOT NULL").select(F.lower("name").alias("query")).distinct()


def token_index(spark: SparkSession, d: str) -> DataFrame:
    """How many byline names hold each token."""
    return store.name_tokens_index(table(spark, d, "papers")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def papers_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Papers with a byline name that holds all tokens of the name of an author whose ord is divisible by 20."""
    return store.by_tokens(table(spark, d, "papers"), _asked(spark, d))


def papers_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Papers for the same names by tokens or as a part of a byline name."""
    return store.by_name(table(spark, d, "papers"), _asked(spark, d))


def title_pieces(spark: SparkSession, d: str) -> DataFrame:
    """How many titles hold each run of three characters."""
    return store.text_pieces_index(table(spark, d, "papers")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def raw_depths(spark: SparkSession, d: str) -> DataFrame:
    """Raw data of evidence nested deeper and deeper, cut at a depth of 10."""
    nested = F.concat(F.repeat(F.lit('{"a":['), (F.col("ord") % 9).cast("int")), F.lit('"}]{"'), F.repeat(F.lit("]}"), (F.col("ord") % 9).cast("int")))
    return table(spark, d, "papers").select("ord", (store.capped_depth(nested, 10) == store.TRUNCATED).alias("truncated"))


def _relations(spark: SparkSession, d: str, wanted: list[str] | None = None) -> DataFrame:
    cites = edges.citation_edges(table(spark, d, "snapshot_citations"))
    ships = cut(edges.authorships(table(spark, d, "papers")))
    return stored(knowledge.relation_edges(cites, ships, edges.coauthor_pairs(ships), wanted))


def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each relation of the knowledge graph."""
    return _relations(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "snapshot_works").select(work_key(F.col("id")).alias("node"), "title").where("node IS NOT NULL")
    return works.groupBy("node").agg(F.max("title").alias("title"))


def expanded_graph(spark: SparkSession, d: str) -> DataFrame:
    """Fifty nodes around the most citing work over all relations, stubs marked."""
    e = _relations(spark, d)
    start = e.where("relation = 'references'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(1).select(F.col("source").alias("node"))
    return knowledge.expand(e, _records(spark, d), start).select("node", "level", "place", "title", "loaded")


def missing_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Cited works nobody has stored, for each work."""
    e = _relations(spark, d, ["references"])
    return knowledge.missing_neighbours(e, e.select(F.col("source").alias("node")).distinct(), _records(spark, d)).select("node", "n_missing")


def graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The citation graph saved as a snapshot, checked and loaded again: its counts."""
    e = stored(edges.citation_edges(table(spark, d, "snapshot_citations")).select(F.col("citing").alias("source"), F.col("cited").alias("target"), F.lit("references").alias("relation")))
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(_records(spark, d), "node", "left").select("node", F.lit("paper").alias("kind"), "title")
    path = knowledge.snapshot_path(shared_dir(spark))
    knowledge.Graph(nodes, e).save(path)
    return knowledge.Graph.load(spark, path).counts()


def author_members(spark: SparkSession, d: str) -> DataFrame:
    """The representative through which each author row is paired."""
    return changes.author_members(table(spark, d, "authors"))


def author_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Authors as clusters of rows that score as one person, and whether a cluster is ambiguous."""
    return people.author_clusters(table(spark, d, "authors"))


def disambiguated_authors(spark: SparkSession, d: str) -> DataFrame:
    rows = people.disambiguated(table(spark, d, "authors"))
    return rows.select("cluster", "n_records", "name", "status", F.size("coauthors").alias("n_coauthors"), F.array_join("active_years", ",").alias("years"))


def seed_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors deduplicated by name alone, greedily in the order of their rows."""
    return people.seed_clusters(table(spark, d, "authors"))


def enriched_authors(spark: SparkSession, d: str) -> DataFrame:
    rows = people.enriched_authors(table(spark, d, "authors"))
    return rows.select("ord", "name", "affiliation", F.array_join("interests", "; ").alias("interests"))


QUERIES = {
    f.__name__: f
    for f in (
        batch_papers, batch_coauthors, deleted_coauthors, paper_updates, sync_times, confirmed_identities, evidence_reads, latest_load, reference_sets, paper_reads, arxiv_reads, token_index, papers_by_tokens, papers_by_name, title_pieces, raw_depths,
        relation_counts, expanded_graph, missing_neighbours, graph_round_trip, author_members, author_clusters, disambiguated_authors, seed_authors, enriched_authors,
    )
}

_LAST = "last_rows AS (SELECT * FROM papers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord % 2 DESC, ord DESC) = 1)"
_BATCH = f"""{_LAST}, ships AS (SELECT paper, author, min(position) AS position, min(year) AS year FROM (SELECT id AS paper, year, a.position AS position, coalesce({_KEY.format('a.author_id')}, '~' || {_TITLE.format('a.name')}) AS author FROM (SELECT id, year, unnest(authors) AS a FROM last_rows)) WHERE author IS NOT NULL GROUP BY 1, 2)"""
_PAIRS = "SELECT x.author AS a, y.author AS b, count(DISTINCT x.paper) AS papers, min(x.year) AS first_year, max(x.year) AS last_year FROM ships x JOIN ships y ON x.paper = y.paper AND x.author < y.author WHERE x.author[1] <> '~' AND y.author[1] <> '~' {0} GROUP BY 1, 2"
_TOKS = "list_filter(list_distinct(string_split({0}, ' ')), lambda t: length(t) > 1)"
_NAMES = "nms AS (SELECT ord, i, a.name AS name FROM (SELECT ord, unnest(authors) AS a, generate_subscripts(authors, 1) AS i FROM papers))"
_ASKED = "asked AS (SELECT DISTINCT lower(name) AS query FROM authors WHERE ord % 20 = 0 AND name IS NOT NULL)"
_GRAPH = f"""{_EDGES}, {_SHIP}, co AS (SELECT DISTINCT x.author AS a, y.author AS b FROM ships x JOIN ships y ON x.paper = y.paper AND x.author < y.author WHERE x.author[1] <> '~' AND y.author[1] <> '~')"""
_REC = f"rec AS (SELECT {_WORK.format('id')} AS node, max(title) AS title FROM snapshot_works WHERE {_WORK.format('id')} IS NOT NULL GROUP BY 1)"
_SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_SAME = "md5(CAST([name, affiliation, CAST(interests AS VARCHAR), CAST(coauthors AS VARCHAR), CAST(active_years AS VARCHAR), CAST(venues AS VARCHAR), orcid, semantic_scholar_id, openalex_id] AS VARCHAR))"
ORACLES = {
    "batch_papers": f"WITH {_LAST} SELECT id, ord, title, year FROM last_rows",
    "batch_coauthors": f"WITH {_BATCH} {_PAIRS.format('')}",
    "deleted_coauthors": f"WITH {_BATCH} {_PAIRS.format('AND x.paper NOT IN (SELECT id FROM last_rows WHERE year < 2010)')}",
    "paper_updates": "SELECT DISTINCT id, id IN (SELECT id FROM papers WHERE ord % 2 = 0 AND id IS NOT NULL) AS updated FROM papers WHERE ord % 2 = 1 AND id IS NOT NULL",
    "sync_times": "SELECT id, source, arg_max(epoch_us(t), (ord % 2, ord, i)) AS time FROM (SELECT id, ord, i, e.source AS source, e.collected_at AS t FROM (SELECT id, ord, unnest(evidence_list) AS e, generate_subscripts(evidence_list, 1) AS i FROM papers)) WHERE id IS NOT NULL AND source IS NOT NULL GROUP BY id, source",
    "confirmed_identities": f"""WITH r AS (SELECT ord, a.position AS p, lower(trim(a.name)) AS name, {_KEY.format('a.author_id')} AS author FROM (SELECT ord, unnest(authors) AS a FROM papers)), k AS (SELECT ord, name, arg_max(author, p) AS author FROM r WHERE name IS NOT NULL AND author IS NOT NULL GROUP BY ord, name)
        SELECT name, author, count(*) AS n_papers, 'confirmed' AS status FROM k GROUP BY name, author""",
    "evidence_reads": "SELECT ord, CASE WHEN evidence_list IS NOT NULL THEN coalesce(array_to_string(list_filter(list_transform(evidence_list, lambda e: e.source), lambda s: s IS NOT NULL), ','), '') END AS sources FROM papers",
    "latest_load": "SELECT strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_works FROM snapshot_works GROUP BY 1 ORDER BY 1 DESC LIMIT 1",
    "reference_sets": f"WITH {_EDGES} SELECT citing AS id, count(*) AS n_refs FROM edges GROUP BY 1",
    "paper_reads": "SELECT id, max(ord) AS ord, arg_max(title, ord) AS title FROM papers WHERE id IN (SELECT id FROM papers WHERE ord % 20 = 0) GROUP BY id",
    "arxiv_reads": f"WITH k AS (SELECT ord, {_ARXIV.format('arxiv_id')} AS key FROM papers) SELECT ord, key FROM k WHERE key IN (SELECT key FROM k WHERE ord % 20 = 0)",
    "token_index": f"WITH {_NAMES} SELECT token, count(*) AS n FROM (SELECT unnest({_TOKS.format(_TITLE.format('name'))}) AS token FROM nms) GROUP BY token",
    "papers_by_tokens": f"WITH {_NAMES}, {_ASKED}, q AS (SELECT query, {_TOKS.format(_TITLE.format('query'))} AS q FROM asked), n AS (SELECT ord, {_TOKS.format(_TITLE.format('name'))} AS t FROM nms) SELECT DISTINCT query, ord FROM q JOIN n ON len(q.q) > 0 AND list_contains(n.t, q.q[1]) AND list_has_all(n.t, q.q)",
    "papers_by_name": f"WITH {_NAMES}, {_ASKED}, q AS (SELECT query, {_TOKS.format(_TITLE.format('query'))} AS q FROM asked), n AS (SELECT DISTINCT ord, lower(name) AS name, {_TOKS.format(_TITLE.format('name'))} AS t FROM nms) SELECT DISTINCT query, ord FROM q JOIN n ON (len(q.q) > 0 AND list_has_all(n.t, q.q)) OR (length(query) >= 3 AND contains(n.name, query))",
    "title_pieces": "SELECT piece, count(*) AS n FROM (SELECT ord, unnest(list_distinct(list_transform(range(1, length(title) - 1), lambda i: substr(lower(title), CAST(i AS INT), 3)))) AS piece FROM papers WHERE length(title) >= 3) GROUP BY piece",
    "raw_depths": "SELECT ord, (ord % 9) * 2 > 10 AS truncated FROM papers",
    "relation_counts": f"WITH {_GRAPH} SELECT 'references' AS relation, count(*) AS n_edges FROM edges UNION ALL SELECT 'citations', count(*) FROM edges UNION ALL SELECT 'authors', count(*) FROM ships WHERE author[1] <> '~' UNION ALL SELECT 'papers', count(*) FROM ships WHERE author[1] <> '~' UNION ALL SELECT 'coauthors', 2 * count(*) FROM co",
    "missing_neighbours": f"WITH {_EDGES}, {_REC} SELECT citing AS node, count(*) AS n_missing FROM edges WHERE cited NOT IN (SELECT node FROM rec) GROUP BY 1",
    "graph_round_trip": f"WITH {_EDGES} SELECT 1 AS version, (SELECT count(*) FROM (SELECT citing FROM edges UNION SELECT cited FROM edges)) AS node_count, (SELECT count(*) FROM edges) AS edge_count",
    "author_members": f"WITH k AS (SELECT ord, {_SAME} AS k FROM authors) SELECT ord, min(ord) OVER (PARTITION BY k) AS representative FROM k",
    "enriched_authors": f"""WITH e AS (SELECT ord, {_SQ.format('name')} AS name, {_SQ.format('affiliation')} AS affiliation, list_filter(list_transform(coalesce(interests, []), lambda i: {_SQ.format('i')}), lambda i: i <> '') AS xs FROM authors)
        SELECT ord, name, affiliation, array_to_string(list_filter(xs, lambda x, i: list_position(list_transform(xs, lambda y: lower(y)), lower(x)) = i), '; ') AS interests FROM e""",
}
