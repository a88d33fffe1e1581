"""Parsers of recorded payloads: JSON or XML text in, columns out. All JVM-side; what doesn't parse gives nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.ids import arxiv_key
from quillspark.functions.text import squeezed_blanks, strict_doi, strict_pmid, work_key
from quillspark.sources.articles import publisher_of

OPENALEX_WORK = (
    "id string, title string, display_name string, publication_year int, doi string, cited_by_count bigint, authorships array<struct<author:struct<id:string,display_name:string>>>, "
    "primary_location struct<source:struct<display_name:string>,landing_page_url:string,pdf_url:string>, keywords array<struct<display_name:string>>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
)
S2_PAPER = "paperId string, title string, year int, venue string, abstract string, citationCount bigint, referenceCount bigint, externalIds map<string,string>, url string, openAccessPdf struct<url:string>, authors array<struct<authorId:string,name:string>>"
CROSSREF = (
    "DOI string, title array<string>, author array<struct<given:string,family:string,name:string,affiliation:array<struct<name:string>>>>, `container-title` array<string>, publisher string, `is-referenced-by-count` bigint, "
    "`published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>, created struct<`date-parts`:array<array<int>>>, URL string, abstract string"
)
EUROPE_PMC = "id string, pmid string, doi string, title string, authorString string, journalTitle string, pubYear string, abstractText string, citedByCount bigint, fullTextUrlList struct<fullTextUrl:array<struct<url:string,documentStyle:string,availabilityCode:string>>>"
CORE = "id string, title string, doi string, yearPublished int, publisher string, abstract string, downloadUrl string, authors array<struct<name:string>>, journals array<struct<title:string>>"
UNPAYWALL = "doi string, title string, year int, journal_name string, best_oa_location struct<url:string,license:string,host_type:string>, oa_locations array<struct<url:string,license:string,host_type:string>>"
ATOM_ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, doi string, journal_ref string, category array<struct<_term:string>>"


def inverted_abstract(index: Column) -> Column:
    """The text of an inverted index: words by position."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(""))


def openalex_works(payloads: DataFrame, text: str) -> DataFrame:
    """Works: bare id, byline, abstract from its inverted index, references that are works, valid DOI or null."""
    p = F.from_json(text, OPENALEX_WORK)
    r = payloads.withColumn("_p", p)
    return r.select(
        *[c for c in payloads.columns if c != text], work_key(F.col("_p.id")).alias("id"), F.coalesce("_p.title", "_p.display_name").alias("title"), F.col("_p.publication_year").alias("year"), strict_doi(F.col("_p.doi")).alias("doi"),
        F.col("_p.cited_by_count").alias("citations"), F.transform("_p.authorships", lambda a: a["author"]["display_name"]).alias("names"), F.col("_p.primary_location.source.display_name").alias("venue"),
        F.col("_p.primary_location.pdf_url").alias("pdf_url"), inverted_abstract(F.col("_p.abstract_inverted_index")).alias("abstract"),
        F.array_compact(F.transform("_p.referenced_works", work_key)).alias("references"), F.transform("_p.keywords", lambda k: k["display_name"]).alias("keywords"),
    )


def s2_papers(payloads: DataFrame, text: str) -> DataFrame:
    r = payloads.withColumn("_p", F.from_json(text, S2_PAPER))
    ids = F.col("_p.externalIds")
    return r.select(
        *[c for c in payloads.columns if c != text], F.col("_p.paperId").alias("id"), F.col("_p.title").alias("title"), F.col("_p.year").alias("year"), F.nullif("_p.venue", F.lit("")).alias("venue"), F.col("_p.abstract").alias("abstract"),
        strict_doi(F.try_element_at(ids, F.lit("DOI"))).alias("doi"), arxiv_key(F.try_element_at(ids, F.lit("ArXiv"))).alias("arxiv_id"), strict_pmid(F.try_element_at(ids, F.lit("PubMed"))).alias("pmid"),
        F.col("_p.citationCount").alias("citations"), F.col("_p.openAccessPdf.url").alias("pdf_url"), F.transform("_p.authors", lambda a: a["name"]).alias("names"),
    )


def crossref_items(payloads: DataFrame, text: str) -> DataFrame:
    """Items: given and family name, first affiliation, the year of the first date that is there."""
    r = payloads.withColumn("_p", F.from_json(text, CROSSREF))
    year = F.coalesce(*[F.try_element_at(F.try_element_at(F.col(f"_p.`{k}`.`date-parts`"), F.lit(1)), F.lit(1)) for k in ("published-print", "published-online", "issued", "created")])
    name = lambda a: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", a["given"], a["family"])), F.lit("")), a["name"])
    return r.select(
        *[c for c in payloads.columns if c != text], strict_doi(F.col("_p.DOI")).alias("doi"), F.try_element_at(F.col("_p.title"), F.lit(1)).alias("title"), year.alias("year"), F.try_element_at(F.col("_p.`container-title`"), F.lit(1)).alias("venue"),
        F.coalesce(F.nullif("_p.publisher", F.lit("")), publisher_of(F.col("_p.DOI"))).alias("publisher"), F.transform("_p.author", name).alias("names"), F.transform("_p.author", lambda a: F.try_element_at(a["affiliation"], F.lit(1))["name"]).alias("affiliations"), F.col("_p.`is-referenced-by-count`").alias("citations"),
    )


def europe_pmc_results(payloads: DataFrame, text: str) -> DataFrame:
    """Results: markup stripped, bounded year, the first open PDF link."""
    r = payloads.withColumn("_p", F.from_json(text, EUROPE_PMC))
    bare = lambda c: squeezed_blanks(F.regexp_replace(c, "<[^>]+>", " "))
    year = F.col("_p.pubYear").try_cast("int")
    pdf = F.filter("_p.fullTextUrlList.fullTextUrl", lambda u: (u["documentStyle"] == "pdf") & u["availabilityCode"].isin("OA", "F"))
    return r.select(*[c for c in payloads.columns if c != text], strict_pmid(F.col("_p.pmid")).alias("pmid"), strict_doi(F.col("_p.doi")).alias("doi"), bare(F.col("_p.title")).alias("title"), bare(F.col("_p.abstractText")).alias("abstract"),
                    F.when((year >= 1800) & (year <= 2100), year).alias("year"), F.col("_p.journalTitle").alias("venue"), F.try_element_at(pdf, F.lit(1))["url"].alias("pdf_url"))


def core_works(payloads: DataFrame, text: str) -> DataFrame:
    """Works: venue is the publisher, else the first journal's title; texts cut to the stored lengths."""
    r = payloads.withColumn("_p", F.from_json(text, CORE))
    return r.select(*[c for c in payloads.columns if c != text], F.substring("_p.title", 1, 500).alias("title"), strict_doi(F.col("_p.doi")).alias("doi"), F.col("_p.yearPublished").alias("year"),
                    F.substring(F.coalesce(F.nullif("_p.publisher", F.lit("")), F.try_element_at(F.col("_p.journals"), F.lit(1))["title"]), 1, 300).alias("venue"), F.transform("_p.authors", lambda a: a["name"]).alias("names"), F.col("_p.downloadUrl").alias("pdf_url"))


def unpaywall_locations(payloads: DataFrame, text: str) -> DataFrame:
    """One row an open location (http links only), the best one first, each link once."""
    r = payloads.withColumn("_p", F.from_json(text, UNPAYWALL))
    every = F.concat(F.array_compact(F.array("_p.best_oa_location")), F.coalesce("_p.oa_locations", F.array().cast("array<struct<url:string,license:string,host_type:string>>")))
    every = F.filter(every, lambda x: F.coalesce(x["url"].rlike(r"^https?://"), F.lit(False)))
    firsts = F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["url"]), x["url"]) == i + 1)
    return r.select(*[c for c in payloads.columns if c != text], strict_doi(F.col("_p.doi")).alias("doi"), F.posexplode(firsts).alias("rank", "l")).select(*[c for c in payloads.columns if c != text], "doi", "rank", "l.url", "l.license", "l.host_type")


def coci_edges(payloads: DataFrame, text: str) -> DataFrame:
    """``citing, cited`` DOIs of a list of citation records; invalid ends and self-citations are dropped."""
    each = payloads.select(F.explode(F.from_json(text, "array<struct<citing:string,cited:string>>")).alias("e"))
    last = lambda c: strict_doi(F.element_at(F.split(F.trim(c), " "), -1))
    return each.select(last(F.col("e.citing")).alias("citing"), last(F.col("e.cited")).alias("cited")).where("citing IS NOT NULL AND cited IS NOT NULL AND lower(citing) <> lower(cited)").distinct()


def atom_entries(payloads: DataFrame, text: str) -> DataFrame:
    """Atom entries (one XML element a row): year from the date, links from the id, category as fallback venue."""
    r = payloads.withColumn("_p", F.from_xml(text, ATOM_ENTRY))
    key = arxiv_key(F.col("_p.id"))
    category = F.try_element_at(F.col("_p.category"), F.lit(1))["_term"]
    return r.select(*[c for c in payloads.columns if c != text], key.alias("arxiv_id"), squeezed_blanks(F.col("_p.title")).alias("title"), squeezed_blanks(F.col("_p.summary")).alias("abstract"), F.substring("_p.published", 1, 4).try_cast("int").alias("year"),
                    F.transform("_p.author", lambda a: a["name"]).alias("names"), strict_doi(F.col("_p.doi")).alias("doi"), F.coalesce(clean_journal_ref(F.col("_p.journal_ref")), F.concat(F.lit("arXiv:"), category)).alias("venue"))


def clean_journal_ref(c: Column) -> Column:
    """The journal of a reference line, without volume, pages, year, ISSN and DOI."""
    bare = F.regexp_replace(c, r"(?i)\b(doi|issn)\b[:\s]*\S+", " ")
    bare = F.regexp_replace(bare, r"(?i)\b(vol(ume)?|no|issue|pp?|pages?)\.?\s*[0-9][0-9\-–:()]*", " ")
    bare = F.regexp_replace(bare, r"\(?\b(1[89]|20)[0-9]{2}\b\)?", " ")
    lead = F.element_at(F.split(bare, r"[,;]|\s[0-9]"), 1)
    return F.nullif(F.trim(F.regexp_replace(squeezed_blanks(lead), r"[\s,.:;\-]+$", "")), F.lit(""))


def manifest_files(payloads: DataFrame, text: str) -> DataFrame:
    """Files of a snapshot manifest (``files`` or the older ``entries``): https link, size, records, partition date."""
    p = F.from_json(text, "files array<struct<url:string,meta:struct<content_length:bigint,record_count:bigint>>>, entries array<struct<url:string,meta:struct<content_length:bigint,record_count:bigint>>>")
    each = payloads.select(F.posexplode(F.coalesce(p["files"], p["entries"])).alias("at", "f"))
    url = F.regexp_replace(F.col("f.url"), r"^s3://([^/]+)/", "https://$1.s3.amazonaws.com/")
    return each.select("at", url.alias("url"), F.col("f.meta.content_length").alias("size"), F.col("f.meta.record_count").alias("records"), F.nullif(F.regexp_extract("f.url", r"updated_date=([0-9-]+)", 1), F.lit("")).alias("part"))
