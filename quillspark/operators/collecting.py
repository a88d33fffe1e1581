"""Results of several sources put together: candidates for a person, contexts, sibling entries, statistics, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.ids import record_key
from quillspark.functions.text import ascii_cjk_key, strict_arxiv, title_key

# Words of an organisation's name that say nothing about which one it is.
PLAIN_WORDS = ("and", "at", "in", "of", "the", "universities", "university")
MOST_SIBLINGS, MOST_WORKS = 5, 5


def candidate_union(parts: list[DataFrame]) -> DataFrame:
    """Candidates (columns source, id and others) of several sources, each id of a source once: the first part that has it counts."""
    rows = None
    for i, part in enumerate(parts):
        one = part.withColumn("_part", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    others = [c for c in rows.columns if c not in ("source", "id", "_part")]
    return rows.where("id IS NOT NULL").groupBy("source", "id").agg(F.min_by(F.struct(*others), F.struct("_part", *others)).alias("r")).select("source", "id", "r.*")


def candidate_order(rows: DataFrame, by: list[str], score: str, most: int) -> DataFrame:
    """Adds ``place`` within each group ``by``: highest score, then citations, then h-index (nulls count as none), then id; ``most`` are kept."""
    w = Window.partitionBy(*by).orderBy(F.col(score).isNull(), F.desc(score), F.desc(F.coalesce("citations", F.lit(0))), F.desc(F.coalesce("h_index", F.lit(0))), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def works_context(papers: DataFrame) -> DataFrame:
    """``author, n_works, titles, dois, arxiv_ids``: what is known of each author id's works, as sorted sets of normal forms."""
    rows = papers.select("title", "doi", "arxiv_id", F.explode("authors").alias("a")).withColumn("author", record_key(F.col("a.author_id"))).where("author IS NOT NULL")
    some = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("n_works"), some(F.nullif(ascii_cjk_key(F.col("title")), F.lit("")), "titles"), some(F.nullif(F.lower("doi"), F.lit("")), "dois"), some(strict_arxiv(F.col("arxiv_id")), "arxiv_ids"))


def in_works(papers: DataFrame, works: DataFrame) -> DataFrame:
    """``ord, author``: papers that are among an author's works (columns author, title, doi, arxiv_id) by preprint id, DOI or title.

    Three joins on one key each, united; works are reduced to distinct keys first.
    """
    keys = {"arxiv": lambda: strict_arxiv(F.col("arxiv_id")), "doi": lambda: F.nullif(F.lower("doi"), F.lit("")), "title": lambda: F.nullif(ascii_cjk_key(F.col("title")), F.lit(""))}
    each = lambda d, *keep: d.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("f"), k().alias("v")) for n, k in keys.items()])).alias("k")).where("k.v IS NOT NULL").distinct()
    return each(papers, "ord").join(each(works, "author"), "k").select("ord", "author").distinct()


def institution_keywords(affiliation: Column) -> Column:
    """Words of an organisation that tell it apart: three characters or more, in lower case."""
    words = F.split(F.regexp_replace(F.lower(affiliation), r"[^a-z0-9一-鿿]+", " "), " ")
    return F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*PLAIN_WORDS))


def institutions_match(lines: Column, keywords: Column) -> Column:
    """Whether any line (array) contains a keyword."""
    joined = F.lower(F.array_join(lines, " "))
    return F.exists(keywords, lambda k: joined.contains(k))


def sibling_works(profiles: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, sibling, ord, place``: works of other entries with exactly the same name whose byline names the profile's organisation; at most
    ``MOST_SIBLINGS`` siblings (smallest ids) and ``MOST_WORKS`` works (most cited) each. Both limits are the feature.

    ``profiles`` has id, name, affiliation; ``entries`` has author, name, affiliation, ord, citations: bylines with an id.
    """
    own = profiles.where("name IS NOT NULL").select("id", F.trim("name").alias("name"), institution_keywords(F.col("affiliation")).alias("keywords")).where(F.size("keywords") > 0)
    others = profiles.select(F.col("id").alias("sibling"), F.trim("name").alias("name")).distinct()
    w = Window.partitionBy("id").orderBy("sibling")
    near = own.join(others, "name").where("id <> sibling").withColumn("s", F.dense_rank().over(w)).where(F.col("s") <= MOST_SIBLINGS)
    works = entries.select(F.col("author").alias("sibling"), "ord", "affiliation", "citations")
    hits = near.join(works, "sibling").where(institutions_match(F.array(F.coalesce("affiliation", F.lit(""))), F.col("keywords")))
    hits = hits.groupBy("id", "sibling", "ord").agg(F.max("citations").alias("citations"))
    v = Window.partitionBy("id", "sibling").orderBy(F.desc_nulls_last("citations"), "ord")
    return hits.withColumn("place", F.row_number().over(v)).where(F.col("place") <= MOST_WORKS).select("id", "sibling", "ord", "place")


def merged_results(parts: list[DataFrame]) -> DataFrame:
    """Results of several runs under each other; of a source that several runs name (column source), the last run's figures count."""
    rows = None
    for i, part in enumerate(parts):
        one = part.withColumn("_run", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy("source").agg(F.max("_run").alias("_run"))
    return rows.join(last, ["source", "_run"], "left_semi").drop("_run")


def collection_statistics(rows: DataFrame, confidence: Column) -> DataFrame:
    """``n_rows, mean_confidence, empty`` in one row; without rows the mean is 0."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("mean_confidence")).withColumn("empty", F.col("n_rows") == 0)


def cluster_statistics(clusters: DataFrame, cluster: str) -> DataFrame:
    """``n_clusters, n_merged``: clusters, and records beyond the first of each."""
    sizes = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_merged"))


def run_counters(events: DataFrame) -> DataFrame:
    """``source, n_requests, n_failed, n_items, errors`` of requests (source, failed, items, message); each error of a source once."""
    return events.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum(F.col("failed").cast("int")).alias("n_failed"), F.sum(F.when(~F.col("failed"), F.col("items")).otherwise(0)).alias("n_items"), F.countDistinct(F.when(F.col("failed"), F.col("message"))).alias("n_errors")
    )


def worth_falling_back(status: Column, message: Column) -> Column:
    """Whether another source should be asked after a failure: refused, limited, a server's fault, or a timeout."""
    return F.coalesce(status.isin(401, 402, 403, 408, 429) | (status >= 500), F.lit(False)) | F.coalesce(F.lower(message).rlike("timeout|timed out|connection|rate limit"), F.lit(False))


def routed(asked: DataFrame, index: DataFrame, switched_on: bool) -> DataFrame:
    """``work, route, n``: whether the citing works of ``asked`` (column work) come from the index (column cited) or must be fetched. The route
    is the index where it knows the work, and only if it is switched on."""
    counts = index.groupBy(F.col("cited").alias("work")).agg(F.count(F.lit(1)).alias("n"))
    rows = asked.select("work").distinct().join(counts, "work", "left")
    hit = F.col("n").isNotNull() & F.lit(switched_on)
    return rows.select("work", F.when(hit, "index").otherwise("fetch").alias("route"), F.when(hit, F.col("n")).otherwise(0).alias("n"))


def limited_after_merge(rows: DataFrame, group: str, key: str, rank: str, position: str, most: int) -> DataFrame:
    """The first ``most`` keys of each group after repeats over sources are merged (the first source is credited); the limit is the feature."""
    firsts = rows.groupBy(group, key).agg(F.min(F.struct(rank, position)).alias("o"))
    w = Window.partitionBy(group).orderBy("o", key)
    return firsts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(group, key, F.col(f"o.{rank}").alias(rank), "place")


def evidence_locations(entries: Column) -> Column:
    """Open locations told by a paper's evidence: null if no entry tells of them (ask the source), empty if one says there are none."""
    told = F.filter(F.coalesce(entries, F.array()), lambda e: e["source"] == "unpaywall")
    links = F.array_compact(F.transform(told, lambda e: F.when(e["source_url"].rlike("^https?://"), e["source_url"])))
    return F.when(F.size(told) == 0, F.lit(None).cast("array<string>")).otherwise(F.array_distinct(links))


def numbered_entries(texts: DataFrame, text: str, doc: str) -> DataFrame:
    """``<doc>, n, raw, title``: numbered lines ('3. Names. A title. Venue'); of a number given twice the last counts. The title is the first
    part of more than 15 characters after the names."""
    lines = texts.select(doc, F.posexplode(F.split(text, "\n")).alias("at", "line")).where(F.col("line").rlike(r"^\s*[0-9]{1,2}\.\s+\S"))
    rows = lines.select(doc, "at", F.regexp_extract("line", r"^\s*([0-9]{1,2})\.", 1).cast("int").alias("n"), F.trim(F.regexp_extract("line", r"^\s*[0-9]{1,2}\.\s+(.*)$", 1)).alias("raw"))
    last = rows.groupBy(doc, "n").agg(F.max_by("raw", "at").alias("raw"))
    parts = F.filter(F.transform(F.split("raw", r"\. "), lambda p: F.trim(p)), lambda p: p != "")
    longer = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: (F.length(p) > 15) & p.contains(" "))
    return last.select(doc, "n", "raw", F.coalesce(F.try_element_at(longer, F.lit(1)), F.try_element_at(parts, F.lit(1)), F.col("raw")).alias("title"))


def author_warning(papers: DataFrame, profiles: DataFrame) -> DataFrame:
    """``author, n_papers, warning``: authors whose papers were found without a profile of theirs."""
    counts = papers.select(F.explode("authors").alias("a")).select(title_key(F.col("a.name")).alias("author")).where("author <> ''").groupBy("author").agg(F.count(F.lit(1)).alias("n_papers"))
    known = profiles.select(title_key(F.col("name")).alias("author"), F.lit(True).alias("_k")).distinct()
    return counts.join(known, "author", "left").select("author", "n_papers", F.when(F.col("_k").isNull(), "papers without a profile").alias("warning"))
