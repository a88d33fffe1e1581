"""Parsers of article payloads: PubMed XML, IEEE and web-search results, publishers of DOIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import strict_doi, strict_pmid

# Publishers by the registrant of a DOI.
PUBLISHERS = {
    "10.1000": "DOI Foundation", "10.1002": "Wiley", "10.1007": "Springer", "10.1016": "Elsevier", "10.1021": "ACS", "10.1024": "Hogrefe", "10.1029": "Wiley", "10.1038": "Springer Nature", "10.1039": "RSC",
    "10.1055": "Thieme", "10.1063": "AIP Publishing", "10.1073": "PNAS", "10.1080": "Taylor & Francis", "10.1088": "IOP", "10.1093": "Oxford University Press", "10.1097": "Wolters Kluwer",
    "10.1101": "Cold Spring Harbor Laboratory", "10.1103": "American Physical Society", "10.1109": "IEEE", "10.1111": "Wiley", "10.1117": "SPIE", "10.1126": "American Association for the Advancement of Science",
    "10.1128": "American Society for Microbiology", "10.1136": "BMJ", "10.1142": "World Scientific", "10.1145": "ACM", "10.1148": "Radiological Society of North America", "10.1152": "American Physiological Society",
    "10.1155": "Hindawi", "10.1162": "MIT Press", "10.1172": "American Society for Clinical Investigation", "10.1177": "SAGE", "10.1186": "BioMed Central", "10.1190": "Society of Exploration Geophysicists",
    "10.1200": "American Society of Clinical Oncology", "10.1287": "INFORMS", "10.1364": "Optica Publishing Group", "10.1371": "PLOS", "10.1525": "University of California Press", "10.1542": "American Academy of Pediatrics",
    "10.21105": "The Open Journal", "10.3233": "IOS Press", "10.3389": "Frontiers", "10.3390": "MDPI", "10.48550": "arXiv", "10.5194": "Copernicus Publications", "10.5281": "Zenodo", "10.5334": "Ubiquity Press",
    "10.7554": "eLife", "10.7717": "PeerJ",
}
YEAR = r"\b((?:19|20)[0-9]{2})\b"
MOST_TERMS = 30

PUBMED = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string,CollectiveName:string>>>,"
    "Journal:struct<Title:string,ISOAbbreviation:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,ELocationID:array<struct<_EIdType:string,_VALUE:string>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>,KeywordList:struct<Keyword:array<string>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _rest(payloads: DataFrame, text: str) -> list[str]:
    return [c for c in payloads.columns if c != text]


def publisher_of(doi: Column) -> Column:
    """The publisher whose registrant a DOI has (exactly), or null. A literal table of fifty rows, so no join is needed."""
    registrant = F.element_at(F.split(F.trim(doi), "/"), 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PUBLISHERS.items() for x in kv]), registrant)


def pubmed_articles(payloads: DataFrame, text: str) -> DataFrame:
    """PubMed articles (one XML element a row): labelled parts of the abstract joined, headings and keywords without repeats and at
    most ``MOST_TERMS``, the year from the date or the first four digits of its free form. Articles without a title give no row."""
    r = payloads.withColumn("_p", F.from_xml(text, PUBMED))
    a = "_p.MedlineCitation.Article"
    part = lambda p: F.when(_text(p["_VALUE"]).isNotNull(), F.concat(F.when(F.coalesce(p["_Label"], F.lit("")) != "", F.concat(p["_Label"], F.lit(": "))).otherwise(""), F.trim(p["_VALUE"])))
    fore = lambda x: F.coalesce(_text(x["ForeName"]), _text(x["Initials"]))
    name = lambda x: F.coalesce(F.concat(fore(x), F.lit(" "), _text(x["LastName"])), _text(x["LastName"]), _text(x["CollectiveName"]))
    year, free = F.trim(f"{a}.Journal.JournalIssue.PubDate.Year"), F.substring(F.trim(f"{a}.Journal.JournalIssue.PubDate.MedlineDate"), 1, 4)
    digits = lambda c: F.when(c.rlike("^[0-9]+$"), c.cast("int"))
    id_of = lambda path, kind: _text(F.try_element_at(F.filter(path, lambda x: F.lower(x[kind]) == "doi"), F.lit(1))["_VALUE"])
    none = F.array().cast("array<string>")
    terms = F.concat(F.coalesce(F.transform("_p.MedlineCitation.MeshHeadingList.MeshHeading", lambda m: _text(m["DescriptorName"])), none), F.coalesce(F.transform("_p.MedlineCitation.KeywordList.Keyword", _text), none))
    abstract = F.nullif(F.array_join(F.array_compact(F.transform(f"{a}.Abstract.AbstractText", part)), " "), F.lit(""))
    return r.select(
        *_rest(payloads, text), strict_pmid(F.col("_p.MedlineCitation.PMID")).alias("pmid"), _text(F.col(f"{a}.ArticleTitle")).alias("title"), abstract.alias("abstract"), F.array_compact(F.transform(f"{a}.AuthorList.Author", name)).alias("names"),
        F.coalesce(digits(year), digits(free)).alias("year"), F.coalesce(_text(F.col(f"{a}.Journal.Title")), _text(F.col(f"{a}.Journal.ISOAbbreviation"))).alias("venue"),
        strict_doi(F.coalesce(id_of("_p.PubmedData.ArticleIdList.ArticleId", "_IdType"), id_of(f"{a}.ELocationID", "_EIdType"))).alias("doi"), F.slice(F.array_distinct(F.array_compact(terms)), 1, MOST_TERMS).alias("keywords"),
    ).where("title IS NOT NULL")


def ieee_articles(payloads: DataFrame, text: str) -> DataFrame:
    """IEEE articles: bylines in a block or a list, of objects or texts, or as one text; index terms united without repeats."""
    v = F.try_parse_json(text)
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    r = payloads.withColumn("_v", v)
    entries = F.coalesce(get("$.authors.authors", "array<variant>"), get("$.authors", "array<variant>"), F.array().cast("array<variant>"))
    of = lambda e: F.coalesce(*[F.nullif(F.try_variant_get(e, p, "string"), F.lit("")) for p in ("$.full_name", "$.preferred_name", "$.name")], F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")))
    listed = F.array_compact(F.transform(entries, of))
    typed = F.filter(F.transform(F.split(F.coalesce(get("$.author_names"), F.lit("")), "[;,]"), lambda t: F.trim(t)), lambda t: t != "")
    none = F.array().cast("array<string>")
    paths = [p for k in ("ieee_terms", "author_terms", "controlledterms", "controlled_terms") for p in (f"$.index_terms.{k}.terms", f"$.index_terms.{k}.term", f"$.index_terms.{k}")] + [f"$.{k}" for k in ("keywords", "ieee_terms", "author_terms")]
    terms = F.concat(*[F.coalesce(get(p, "array<string>"), none) for p in paths])
    https = lambda c: F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)
    number = F.coalesce(get("$.article_number"), get("$.articleNumber"))
    return r.select(
        *_rest(payloads, text), F.coalesce(_text(F.coalesce(F.nullif(get("$.title"), F.lit("")), get("$.article_title"))), F.lit("Untitled")).alias("title"), F.when(F.size(listed) > 0, listed).otherwise(typed).alias("names"),
        F.substring(F.coalesce(get("$.publication_year"), get("$.year")), 1, 4).try_cast("int").alias("year"), _text(F.coalesce(*[F.nullif(get(f"$.{k}"), F.lit("")) for k in ("publication_title", "conference_name", "publisher")])).alias("venue"),
        strict_doi(get("$.doi")).alias("doi"), https(F.coalesce(get("$.html_url"), get("$.abstract_url"), F.concat(F.lit("https://ieeexplore.ieee.org/document/"), number))).alias("url"), https(get("$.pdf_url")).alias("pdf_url"),
        F.coalesce(get("$.citing_paper_count"), get("$.citation_count")).try_cast("bigint").alias("citations"), F.slice(F.array_distinct(F.filter(terms, lambda t: F.coalesce(t != "", F.lit(False)))), 1, MOST_TERMS).alias("keywords"),
    )


SEARCH_HIT = "result_id string, title string, link string, snippet string, publication_info struct<summary:string,authors:array<struct<name:string>>>, inline_links struct<cited_by:struct<total:bigint>>, resources array<struct<file_format:string,link:string>>"


def search_hits(payloads: DataFrame, text: str) -> DataFrame:
    """Hits of a web search whose summary reads 'authors - venue, year - publisher', or lacks the venue or the authors."""
    r = payloads.withColumn("_p", F.from_json(text, SEARCH_HIT)).withColumn("_s", F.coalesce("_p.publication_info.summary", F.lit("")))
    parts = F.filter(F.transform(F.split("_s", " - "), lambda t: F.trim(t)), lambda t: t != "")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, YEAR, ""), r"^[ ,]+|[ ,]+$", "")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    trimmed = lambda c: F.regexp_replace(c, r"^[ ,]+|[ ,]+$", "")
    three = F.when(F.trim(F.regexp_replace(at(2), YEAR, "")) == "", trimmed(at(3))).otherwise(bare(at(2)))
    two = F.when(at(1).rlike(YEAR) & ~at(2).rlike(YEAR), trimmed(at(1))).otherwise(bare(at(2)))
    head = F.filter(F.transform(F.split(F.element_at(F.split("_s", " - "), 1), ","), lambda t: F.trim(t)), lambda t: t != "")
    pdf = F.try_element_at(F.filter("_p.resources", lambda x: F.upper(x["file_format"]) == "PDF"), F.lit(1))["link"]
    year = F.coalesce(F.nullif(F.regexp_extract("_s", YEAR, 1), F.lit("")), F.nullif(F.regexp_extract("_p.title", YEAR, 1), F.lit("")))
    return r.where(F.length(F.trim("_p.title")) > 0).select(
        *_rest(payloads, text), F.col("_p.result_id").alias("id"), F.trim("_p.title").alias("title"), F.coalesce(F.transform("_p.publication_info.authors", lambda a: a["name"]), head).alias("names"), year.cast("int").alias("year"),
        F.nullif(F.when(F.size(parts) >= 3, three).when(F.size(parts) == 2, two), F.lit("")).alias("venue"), F.col("_p.snippet").alias("abstract"), F.col("_p.inline_links.cited_by.total").alias("citations"), pdf.alias("pdf_url"),
    )
