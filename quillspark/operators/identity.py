"""Who an author is: candidates, ranking, byline look-ups, author fusion, open copies of a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.ids import record_key
from quillspark.functions.text import title_key, tokens, url_ok
from quillspark.operators.filters import name_matches
from quillspark.operators.quality import primary_evidence
from quillspark.session import block_join, lookup

# Hosts whose copies can't be told to be legal open access.
DENIED_HOSTS = ("academia.edu", "researchgate.net", "www.academia.edu", "www.researchgate.net")


def rank_candidates(queries: DataFrame, authors: DataFrame, n: int) -> DataFrame:
    """``query, ord, rank``: the best ``n`` authors for each name asked for; top n is the feature.

    Candidates hold all tokens of the query. Exact token sets come first, then most citations, then the highest h-index
    (nulls last), then ord. Authors are met by their last token in order, so nothing is compared with
    all authors. Empty queries find nothing.
    """
    asked = queries.select("query", tokens(title_key(F.col("query"))).alias("q")).where(F.size("q") > 0).distinct()
    known = authors.select("ord", "citations", "h_index", tokens(title_key(F.col("name"))).alias("t"))
    hits = block_join(known.select("*", F.explode("t").alias("k")), asked.select("*", F.element_at("q", -1).alias("k")), "k", "ord").where(F.size(F.array_except("q", "t")) == 0)
    w = Window.partitionBy("query").orderBy((F.col("q") != F.col("t")).cast("int"), F.desc_nulls_last("citations"), F.desc_nulls_last("h_index"), "ord")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query", "ord", "rank")


def chosen_candidate(hits: DataFrame) -> DataFrame:
    """``query, ord, tier`` of the hit that a name search should take (columns query, name, citations, h_index, ord).

    Hits with exactly the query's tokens (of two characters or more) come first: the most cited, for names in CJK signs the one with the highest
    h-index; then, for such queries, hits in those signs by citations; then all by h-index and citations. Equals go by ord.
    """
    longer = lambda c: F.filter(tokens(title_key(c)), lambda t: F.length(t) > 1)
    signs = lambda c: c.rlike("[\\u3400-\\u9fff]")
    q, n = longer(F.col("query")), longer(F.col("name"))
    h, c = -F.coalesce("h_index", F.lit(0)).cast("bigint"), -F.coalesce("citations", F.lit(0)).cast("bigint")
    tier = F.when((F.size(q) > 0) & (q == n), 1).when(signs(F.col("query")) & signs(F.col("name")), 2).otherwise(3)
    first, second = F.when(tier == 1, F.when(signs(F.col("query")), h).otherwise(c)).when(tier == 2, c).otherwise(h), F.when((tier == 3) | ((tier == 1) & signs(F.col("query"))), c).otherwise(F.lit(0))
    return hits.groupBy("query").agg(F.min(F.struct(tier.alias("tier"), first.alias("a"), second.alias("b"), "ord")).alias("r")).select("query", "r.ord", "r.tier")


def locate_in_byline(authors: str, name: str) -> Column:
    """The byline entry with that name (case aside), else the first whose name matches it; null if there is none."""
    equal = F.filter(authors, lambda a: F.lower(F.trim(a["name"])) == name.lower().strip())
    close = F.filter(authors, lambda a: name_matches(name, a["name"]))
    return F.coalesce(F.try_element_at(equal, F.lit(1)), F.try_element_at(close, F.lit(1)))


def institution_words(affiliation: Column) -> Column:
    """The parts of an affiliation line that name something: longer than three letters, in lower case."""
    return F.filter(F.transform(F.split(affiliation, r"[,;]"), lambda p: F.lower(F.trim(p))), lambda p: F.length(p) > 3)


def authority(c: Column) -> Column:
    """Which system an author id belongs to: orcid, openalex, semantic_scholar or null."""
    key = record_key(c)
    return F.when(key.rlike(r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$"), "orcid").when(key.rlike(r"^A[0-9]{5,}$"), "openalex").when(key.rlike(r"^[0-9]{5,12}$"), "semantic_scholar")


def confirmed_ids(entries: DataFrame, authors: DataFrame) -> DataFrame:
    """``ord, position, resolved, how``: a byline entry's author by its id if that is stored, else by its unique name.

    Names several authors have, and names nobody has, give null. Each side is reduced to one row a key before the join.
    """
    by_id = authors.select(record_key(F.col("id")).alias("_id")).where("_id IS NOT NULL").distinct()
    by_name = authors.where("name IS NOT NULL").groupBy(F.lower(F.trim("name")).alias("_n")).agg(F.min(record_key(F.col("id"))).alias("_by"), F.countDistinct(record_key(F.col("id"))).alias("_c")).where("_c = 1")
    keyed = entries.withColumn("_key", record_key(F.col("author_id"))).withColumn("_n", F.lower(F.trim("name")))
    rows = lookup(lookup(keyed, by_id.select(F.col("_id").alias("_key"), F.lit(True).alias("_hit")), "_key"), by_name, "_n")
    return rows.select("ord", "position", F.when(F.col("_hit"), F.col("_key")).otherwise(F.col("_by")).alias("resolved"), F.when(F.col("_hit"), "id").when(F.col("_by").isNotNull(), "name").alias("how"))


def fuse_authors(authors: DataFrame, cluster: str) -> DataFrame:
    """One author a cluster: texts from the most trusted row that has them, largest h-index and citations, all spellings
    (name and aliases) as sorted distinct ``aliases``, a confirmed status wins. Null clusters are left out."""
    conf = F.coalesce(primary_evidence("evidence_list")["confidence"], F.lit(0.0))
    rows = authors.where(F.col(cluster).isNotNull()).withColumn("_r", F.struct((-conf).alias("c"), F.col("ord").alias("o")))
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("_r"))).alias(c)
    fused = rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_records"), first("name"), first("orcid"), first("affiliation"), first("email"), first("homepage"), F.max("h_index").alias("h_index"), F.max("citations").alias("citations"),
        F.max((F.col("disambiguation_status") == "confirmed").cast("int")).alias("confirmed"),
    )
    spellings = rows.select(cluster, F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")).where(F.length(F.trim("a")) > 0)
    return fused.join(spellings.groupBy(cluster).agg(F.array_join(F.array_sort(F.collect_set("a")), "; ").alias("aliases")), cluster, "left")


def legal_url(c: Column) -> Column:
    """Whether a link is http(s) and its host isn't denied."""
    host = F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://(?:[^@/]*@)?([^/:?#]+)", 1))
    return url_ok(c) & ~host.isin(*DENIED_HOSTS)


def open_location() -> Column:
    """The first legal copy of a paper in a fixed order: its PDF link, its arXiv copy, its page if that is a PDF."""
    arxiv = F.concat(F.lit("https://arxiv.org/pdf/"), F.nullif(F.regexp_extract("arxiv_id", r"([0-9]{4}\.[0-9]{4,5})", 1), F.lit("")))
    return F.coalesce(F.when(legal_url(F.col("pdf_url")), F.col("pdf_url")), arxiv, F.when(F.lower("url").endswith(".pdf") & legal_url(F.col("url")), F.col("url")))


def cross_validated(papers: DataFrame) -> DataFrame:
    """``ord, confidence``: primary confidence, +.05 with a DOI, +.02 with a year, +.02 with an abstract, at most 1 after each;
    null without valid evidence."""
    given = c = primary_evidence("evidence_list")["confidence"]
    for test, plus in ((F.col("doi") != "", 0.05), (F.col("year").isNotNull(), 0.02), (F.col("abstract") != "", 0.02)):
        c = F.least(F.lit(1.0), c + F.when(F.coalesce(test, F.lit(False)), plus).otherwise(0.0))
    return papers.select("ord", F.when(given.isNotNull(), c).alias("confidence"))  # least() skips nulls


def watch_list(names: DataFrame, watched: DataFrame) -> DataFrame:
    """Names (column name) that are on a list (column name), in either order of their parts."""
    key = lambda c: F.array_join(tokens(title_key(F.col(c))), " ")
    return names.withColumn("_k", key("name")).join(watched.select(key("name").alias("_k")).where("_k <> ''").distinct(), "_k", "left_semi").drop("_k")
