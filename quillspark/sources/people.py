"""Parsers of author and citing-work payloads, and what each source can be asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.text import strict_doi, strict_pmid, work_key

# What each source can be asked for; anything not named is refused.
CAPABILITIES = {
    "arxiv": {"search", "doi", "arxiv", "author_papers"}, "core": {"search", "doi", "work", "full_text"}, "crossref": {"search", "doi"}, "europe_pmc": {"search", "doi", "pmid", "full_text"},
    "google_scholar": {"search", "doi", "author_papers", "citations"}, "ieee": {"search", "doi", "author_papers"}, "openalex": {"search", "doi", "work", "author_papers", "citations", "citing_papers"},
    "opencitations": {"citations"}, "pubmed": {"search", "doi", "author_papers", "citations"}, "semantic_scholar": {"search", "doi", "author_papers", "citations"}, "unpaywall": {"doi", "full_text"},
}
# Other names of sources.
ALIASES = {"s2": "semantic_scholar", "semanticscholar": "semantic_scholar", "scholar": "google_scholar", "europepmc": "europe_pmc", "coci": "opencitations"}
#: Most citations taken from one answer of a source.
MOST_CITATIONS = 50

OPENALEX_AUTHOR = (
    "id string, display_name string, works_count bigint, cited_by_count bigint, h_index int, last_known_institution struct<display_name:string>, last_known_institutions array<struct<display_name:string>>, "
    "affiliations array<struct<institution:struct<display_name:string>>>, institutions array<struct<display_name:string>>, summary_stats struct<h_index:int,cited_by_count:bigint>, topics array<struct<display_name:string>>"
)


def supports(source: str, operation: str) -> bool:
    """Whether a source can be asked for something; unknown sources and operations can't."""
    return operation in CAPABILITIES.get(canonical_source(source) or "", set())


def canonical_source(name: str) -> str | None:
    """A source's own name for any of its names, or None."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    key = ALIASES.get(key, key)
    return key if key in CAPABILITIES else None


def chosen_sources(names: list[str] | None) -> list[str]:
    """Sources named in any notation, each once in the order given; unknown ones are skipped. None means all."""
    return list(CAPABILITIES) if names is None else list(dict.fromkeys(s for n in names if (s := canonical_source(n))))


def capability_rows() -> list[tuple[str, str]]:
    return [(s, o) for s, ops in sorted(CAPABILITIES.items()) for o in sorted(ops)]


def _rest(payloads: DataFrame, text: str) -> list[str]:
    return [c for c in payloads.columns if c != text]


def _last_part(c: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1), F.lit(""))


def openalex_authors(payloads: DataFrame, text: str) -> DataFrame:
    """Authors: bare id, h-index from either place, citations from either place, the first institution of three shapes, topics."""
    r = payloads.withColumn("_p", F.from_json(text, OPENALEX_AUTHOR))
    none = F.array().cast("array<string>")
    known = F.concat(*[F.coalesce(c, none) for c in (F.transform("_p.last_known_institutions", lambda i: i["display_name"]), F.transform("_p.affiliations", lambda a: a["institution"]["display_name"]), F.transform("_p.institutions", lambda i: i["display_name"]))])
    institution = F.try_element_at(F.filter(known, lambda n: F.coalesce(n != "", F.lit(False))), F.lit(1))
    return r.select(
        *_rest(payloads, text), _last_part(F.col("_p.id")).alias("id"), F.coalesce(F.nullif("_p.display_name", F.lit("")), F.lit("Unknown")).alias("name"), F.coalesce("_p.last_known_institution.display_name", institution).alias("affiliation"),
        F.coalesce("_p.summary_stats.h_index", "_p.h_index").alias("h_index"), F.coalesce("_p.cited_by_count", "_p.summary_stats.cited_by_count").alias("citations"), F.col("_p.works_count").alias("n_papers"),
        F.coalesce(F.filter(F.transform("_p.topics", lambda t: t["display_name"]), lambda t: F.coalesce(t != "", F.lit(False))), none).alias("topics"), F.when(F.col("_p.id").startswith("http"), F.col("_p.id")).alias("profile_url"),
    )


def s2_authors(payloads: DataFrame, text: str) -> DataFrame:
    """Authors of the other catalogue: the first affiliation, a text or an object with a name; a link is made from the id where none is given."""
    r = payloads.withColumn("_v", F.try_parse_json(text))
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    entries = F.coalesce(get("$.affiliations", "array<variant>"), F.array().cast("array<variant>"))
    of = lambda e: F.nullif(F.coalesce(F.try_variant_get(e, "$.name", "string"), F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))), F.lit(""))
    link = F.coalesce(get("$.url"), F.concat(F.lit("https://www.semanticscholar.org/author/"), get("$.authorId")))
    return r.select(
        *_rest(payloads, text), get("$.authorId").alias("id"), F.coalesce(F.nullif(get("$.name"), F.lit("")), F.lit("Unknown")).alias("name"), F.try_element_at(F.array_compact(F.transform(entries, of)), F.lit(1)).alias("affiliation"),
        get("$.hIndex", "int").alias("h_index"), get("$.citationCount", "bigint").alias("citations"), get("$.paperCount", "bigint").alias("n_papers"), F.when(link.startswith("http"), link).alias("profile_url"), F.when(get("$.homepage").startswith("http"), get("$.homepage")).alias("homepage"),
    )


def citing_page(payloads: DataFrame, text: str, order: str) -> DataFrame:
    """``cited`` and the works of an answer that cite it (``{"results": [...]}``): the last of repeated ids counts; works without id are left out."""
    kinds = "results array<struct<id:string,title:string,display_name:string,publication_year:int,doi:string,primary_location:struct<source:struct<display_name:string>>,authorships:array<struct<author:struct<display_name:string>>>>>"
    each = payloads.select(*_rest(payloads, text), F.posexplode(F.from_json(text, kinds)["results"]).alias("_at", "_w")).withColumn("citing", work_key(F.col("_w.id"))).where("citing IS NOT NULL")
    names = F.filter(F.transform("_w.authorships", lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n != "", F.lit(False)))
    work = F.struct(F.coalesce("_w.title", "_w.display_name").alias("title"), F.col("_w.publication_year").alias("year"), F.col("_w.primary_location.source.display_name").alias("venue"), strict_doi(F.col("_w.doi")).alias("doi"), names.alias("names"))
    return each.groupBy("cited", "citing").agg(F.max_by(work, F.struct(F.col(order), F.col("_at"))).alias("w")).select("cited", "citing", "w.*")


def citing_list(payloads: DataFrame, text: str) -> DataFrame:
    """``cited, citing, place`` of an answer ``{"data": [{"citingPaper": {...}}]}``: key is the paper id, else the DOI; the first of repeated keys counts."""
    kinds = "data array<struct<citingPaper:struct<paperId:string,title:string,year:int,venue:string,externalIds:map<string,string>,authors:array<struct<name:string>>>>>"
    each = payloads.select(*_rest(payloads, text), F.posexplode(F.from_json(text, kinds)["data"]).alias("place", "_d")).withColumn("_w", F.col("_d.citingPaper"))
    doi = strict_doi(F.try_element_at(F.col("_w.externalIds"), F.lit("DOI")))
    each = each.withColumn("citing", F.coalesce(F.nullif("_w.paperId", F.lit("")), doi)).where("citing IS NOT NULL")
    names = F.filter(F.transform("_w.authors", lambda a: a["name"]), lambda n: F.coalesce(n != "", F.lit(False)))
    return each.groupBy("cited", "citing").agg(F.min_by(F.struct("place", F.col("_w.title").alias("title"), F.col("_w.year").alias("year"), doi.alias("doi"), names.alias("names")), "place").alias("w")).select("cited", "citing", "w.*")


def citation_answer(rows: DataFrame, cited: str, citing: str, place: str, most: int = MOST_CITATIONS) -> DataFrame:
    """The first ``most`` citations of each work in an answer, without those that lack an id or cite themselves; the limit is the feature."""
    kept = rows.where(f"{citing} IS NOT NULL AND {citing} <> {cited}")
    w = Window.partitionBy(cited).orderBy(place)
    return kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(cited, citing)


def cited_in_links(payloads: DataFrame, text: str) -> DataFrame:
    """``cited, citing`` PubMed numbers of an answer with link sets, their databases and links; self-citations are left out."""
    kinds = "linksets array<struct<ids:array<string>,linksetdbs:array<struct<linkname:string,links:array<string>>>>>"
    sets = payloads.select(*_rest(payloads, text), F.explode(F.from_json(text, kinds)["linksets"]).alias("_s"))
    dbs = sets.select("cited", F.explode("_s.linksetdbs").alias("_d"))
    links = dbs.select("cited", F.explode("_d.links").alias("_l")).select("cited", strict_pmid(F.col("_l")).alias("citing"))
    return links.where("citing IS NOT NULL AND citing <> cited").distinct()


def byline_names(text: Column) -> Column:
    """Names of a byline given as texts or as objects with a name (JSON array)."""
    entries = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.array_compact(F.transform(entries, lambda e: F.nullif(F.coalesce(F.try_variant_get(e, "$.name", "string"), F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))), F.lit(""))))
