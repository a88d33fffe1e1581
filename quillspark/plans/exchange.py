"""Queries that write tables as the payloads and files of the sources and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.plans.records import _ARXIV, _DOI, _OK, _WORK
from quillspark.session import shared_dir
from quillspark.sources import articles, payloads, people, sinks
from quillspark.sources.tables import table

GAP = "; "


def _names(c: str = "names") -> Column:
    return F.array_join(c, GAP).alias("names")


def _papers(spark: SparkSession, d: str, body: Column, *keep: str) -> DataFrame:
    return table(spark, d, "papers").select("ord", *keep, F.to_json(body).alias("payload"))


def _byline(name: str = "name") -> Column:
    return F.transform("authors", lambda a: F.struct(a["name"].alias(name)))


def openalex_works(spark: SparkSession, d: str) -> DataFrame:
    """Papers as works of the open catalogue, their abstracts as inverted indexes of single words."""
    words = F.transform(F.array_distinct(F.array_compact(F.array("venue", "publisher"))), lambda w, i: F.struct(w.alias("key"), F.array(i).alias("value")))
    body = F.struct(
        F.concat(F.lit("https://openalex.org/W"), F.col("ord").cast("string")).alias("id"), "title", F.col("year").alias("publication_year"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.col("citations").alias("cited_by_count"),
        F.transform("authors", lambda a: F.struct(F.struct(a["name"].alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source"), "pdf_url").alias("primary_location"),
        F.map_from_entries(words).alias("abstract_inverted_index"), F.array(F.concat(F.lit("https://openalex.org/W"), F.col("citations").cast("string")), F.lit("https://example.org/x")).alias("referenced_works"),
    )
    got = payloads.openalex_works(_papers(spark, d, body), "payload")
    return got.select("ord", "id", "title", "year", "doi", "citations", "venue", "pdf_url", "abstract", _names(), F.array_join("references", GAP).alias("refs"))


def crossref_items(spark: SparkSession, d: str) -> DataFrame:
    """Papers as items of the registration agency; a missing publisher is told by the DOI."""
    dates = lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    body = F.struct(
        F.col("doi").alias("DOI"), F.array("title").alias("title"), F.array("venue").alias("container-title"), F.when(F.col("ord") % 2 == 0, F.col("publisher")).alias("publisher"), F.col("citations").alias("is-referenced-by-count"),
        F.when(F.col("ord") % 3 == 0, dates(F.col("year"))).alias("published-online"), dates(F.col("year") + 1).alias("created"), F.transform("authors", lambda a: F.struct(F.lit("Dr").alias("given"), a["name"].alias("family"), F.array(F.struct(a["affiliation"].alias("name"))).alias("affiliation"))).alias("author"),
    )
    got = payloads.crossref_items(_papers(spark, d, body), "payload")
    return got.select("ord", "doi", "title", "year", "venue", "publisher", "citations", _names(), F.array_join("affiliations", GAP).alias("places"))


def europe_pmc_results(spark: SparkSession, d: str) -> DataFrame:
    """Papers as results of the life-science index, titles in markup."""
    links = F.array(F.struct(F.lit("https://example.org/a").alias("url"), F.lit("html").alias("documentStyle"), F.lit("OA").alias("availabilityCode")), F.struct(F.col("pdf_url").alias("url"), F.lit("pdf").alias("documentStyle"), F.when(F.col("ord") % 2 == 0, "OA").otherwise("S").alias("availabilityCode")))
    body = F.struct("pmid", "doi", F.concat(F.lit("<h4>"), F.regexp_replace("title", "[<>]", " "), F.lit("</h4>")).alias("title"), F.col("year").cast("string").alias("pubYear"), F.col("venue").alias("journalTitle"), F.struct(links.alias("fullTextUrl")).alias("fullTextUrlList"))
    got = payloads.europe_pmc_results(_papers(spark, d, body), "payload")
    return got.select("ord", "pmid", "doi", "year", "venue", "pdf_url", F.length("title").alias("n_title"))


def core_works(spark: SparkSession, d: str) -> DataFrame:
    """Papers as works of the repository aggregator."""
    body = F.struct("title", "doi", F.col("year").alias("yearPublished"), F.when(F.col("ord") % 2 == 0, F.col("publisher")).alias("publisher"), F.array(F.struct(F.col("venue").alias("title"))).alias("journals"), F.col("pdf_url").alias("downloadUrl"), _byline().alias("authors"))
    got = payloads.core_works(_papers(spark, d, body), "payload")
    return got.select("ord", "title", "doi", "year", "venue", "pdf_url", _names())


def byline_texts(spark: SparkSession, d: str) -> DataFrame:
    """Bylines as texts (odd deliveries) or as objects."""
    body = F.when(F.col("ord") % 2 == 1, F.to_json(F.transform("authors", lambda a: a["name"]))).otherwise(F.to_json(_byline()))
    return table(spark, d, "papers").select("ord", F.array_join(people.byline_names(body), GAP).alias("names"))


def unpaywall_locations(spark: SparkSession, d: str) -> DataFrame:
    """Links of papers as open locations, the PDF as the best one."""
    place = lambda c, k: F.struct(F.col(c).alias("url"), F.lit("cc-by").alias("license"), F.lit(k).alias("host_type"))
    body = F.struct("doi", place("pdf_url", "publisher").alias("best_oa_location"), F.array(place("url", "repository"), place("pdf_url", "publisher")).alias("oa_locations"))
    return payloads.unpaywall_locations(_papers(spark, d, body), "payload").select("ord", "rank", "url", "host_type")


def coci_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the open citation index: each paper's DOI cites one made of its number, and itself (which is dropped)."""
    made = F.concat(F.lit("doi:10.5072/n"), F.col("ord").cast("string"))
    body = F.array(F.struct(F.concat(F.lit("coci => "), "doi").alias("citing"), made.alias("cited")), F.struct(F.col("doi").alias("citing"), F.col("doi").alias("cited")))
    return payloads.coci_edges(_papers(spark, d, body), "payload")


def _xml(c: Column) -> Column:
    """Text for XML: marks replaced, control characters left out."""
    safe = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def _tag(name: str, c: Column | str, attributes: str = "") -> Column:
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit(f"<{name}{attributes}>"), text, F.lit(f"</{name}>")), F.lit(""))


def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    """Papers with a preprint id as feed entries; those without a journal are named after their category."""
    rows = table(spark, d, "papers").where("arxiv_id IS NOT NULL AND year IS NOT NULL").select("ord", "arxiv_id", "year", "doi")
    entry = F.concat(
        F.lit("<entry>"), _tag("id", F.concat(F.lit("http://arxiv.org/abs/"), _xml(F.col("arxiv_id")))), _tag("title", F.concat(F.lit(" No.  "), F.col("ord").cast("string"))), _tag("published", F.concat(F.col("year").cast("string"), F.lit("-05-01T00:00:00Z"))),
        F.lit("<author><name>A. One</name></author><author><name>B. Two</name></author>"), _tag("doi", _xml(F.col("doi"))), F.when(F.col("ord") % 2 == 0, "<journal_ref>J. Test 12 (2001) 33-40</journal_ref>").otherwise(""), F.lit('<category term="cs.DB"/></entry>'),
    )
    return payloads.atom_entries(rows.select("ord", entry.alias("payload")), "payload").select("ord", "title", "year", "doi", "venue", _names(), (F.col("arxiv_id").isNotNull()).alias("named"))


def pubmed_articles(spark: SparkSession, d: str) -> DataFrame:
    """Papers with a PubMed number as articles: labelled abstract, collective author, headings and keywords, free-form dates."""
    rows = table(spark, d, "papers").where("pmid IS NOT NULL")
    authors = F.concat(_tag("Author", F.concat(_tag("LastName", F.lit("One")), _tag("ForeName", F.lit("Ann")))), F.lit("<Author><LastName>Two</LastName><Initials>B</Initials></Author><Author><CollectiveName>The Group</CollectiveName></Author>"))
    date = F.when(F.col("ord") % 2 == 0, _tag("Year", F.col("year").cast("string"))).otherwise(_tag("MedlineDate", F.concat(F.col("year").cast("string"), F.lit(" Spring"))))
    article = F.concat(
        F.lit("<PubmedArticle><MedlineCitation>"), _tag("PMID", _xml(F.col("pmid"))), F.lit("<Article>"), _tag("ArticleTitle", F.concat(F.lit("Title "), F.col("ord").cast("string"))),
        F.lit('<Abstract><AbstractText Label="AIM">First.</AbstractText><AbstractText>Second.</AbstractText></Abstract>'), _tag("AuthorList", authors), _tag("Journal", F.concat(_tag("JournalIssue", _tag("PubDate", date)), _tag("ISOAbbreviation", F.lit("J Test")))),
        _tag("ELocationID", _xml(F.col("doi")), ' EIdType="doi"'), F.lit("</Article><MeshHeadingList><MeshHeading><DescriptorName>Rivers</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword>Rivers</Keyword><Keyword>Lakes</Keyword></KeywordList></MedlineCitation></PubmedArticle>"),
    )
    got = articles.pubmed_articles(rows.select("ord", article.alias("payload")), "payload")
    return got.select("ord", "pmid", "title", "abstract", "year", "venue", "doi", _names(), F.array_join("keywords", GAP).alias("keywords"))


def ieee_articles(spark: SparkSession, d: str) -> DataFrame:
    """Papers as engineering articles: bylines in a block (even deliveries) or as one text, terms in two places."""
    block = F.struct(F.transform("authors", lambda a: F.struct(a["name"].alias("full_name"))).alias("authors"))
    body = F.struct(
        F.nullif("title", F.lit("")).alias("title"), F.when(F.col("ord") % 2 == 0, block).alias("authors"), F.when(F.col("ord") % 2 == 1, F.lit("A. One; B. Two")).alias("author_names"), F.col("year").cast("string").alias("publication_year"), F.col("venue").alias("conference_name"), "doi",
        F.col("ord").cast("string").alias("article_number"), F.lit("//example.org/p.pdf").alias("pdf_url"), F.col("citations").alias("citing_paper_count"), F.struct(F.struct(F.array(F.lit("rivers"), F.lit("lakes")).alias("terms")).alias("ieee_terms")).alias("index_terms"), F.array(F.lit("lakes"), F.lit("seas")).alias("author_terms"),
    )
    got = articles.ieee_articles(_papers(spark, d, body), "payload")
    return got.select("ord", "title", "year", "venue", "doi", "url", "pdf_url", "citations", _names(), F.array_join("keywords", GAP).alias("keywords"))


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Papers as hits of a web search in its three layouts."""
    year = F.col("year").cast("string")
    summary = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("A One, B Two - Some Journal, "), year, F.lit(" - Press"))).when(F.col("ord") % 3 == 1, F.concat(F.lit("A One - "), year, F.lit(" - Press"))).otherwise(F.concat(F.lit("Conference on Rivers, "), year, F.lit(" - Press")))
    body = F.struct(F.col("ord").cast("string").alias("result_id"), F.concat(F.lit("Title "), F.col("ord").cast("string")).alias("title"), F.struct(summary.alias("summary")).alias("publication_info"), F.struct(F.struct(F.col("citations").alias("total")).alias("cited_by")).alias("inline_links"))
    got = articles.search_hits(_papers(spark, d, body, "year").where("year BETWEEN 1900 AND 2099").drop("year"), "payload")
    return got.select("ord", "id", "title", "year", "venue", "citations", _names())


def publishers(spark: SparkSession, d: str) -> DataFrame:
    """The publisher that a DOI made of each paper's number tells (the DOIs of papers have no registrants of the table)."""
    doi = F.concat(F.lit("10."), (F.col("ord") % 600 + 1000).cast("string"), F.lit("/"), F.col("ord").cast("string"))
    return table(spark, d, "papers").select("ord", articles.publisher_of(doi).alias("publisher")).where("publisher IS NOT NULL")


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """A manifest with one entry a month of loaded works, read again."""
    parts = table(spark, d, "snapshot_works").groupBy(F.date_format("loaded_at", "yyyy-MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.concat(F.lit("s3://bucket/data/works/updated_date="), "m", F.lit("-01/part_000.gz")).alias("url"), F.struct(F.col("n").alias("content_length"), F.col("n").alias("record_count")).alias("meta"))
    made = parts.groupBy().agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("entries"))).alias("payload"))
    return payloads.manifest_files(made, "payload").select("at", "url", "records", "part")


def openalex_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors as entries of the open catalogue, institutions in one of three shapes."""
    place = F.array(F.struct(F.col("affiliation").alias("display_name")))
    body = F.struct(
        F.concat(F.lit("https://openalex.org/"), "id").alias("id"), F.nullif("name", F.lit("")).alias("display_name"), F.when(F.col("ord") % 2 == 0, F.struct("h_index")).alias("summary_stats"), F.when(F.col("ord") % 2 == 1, F.col("h_index")).alias("h_index"), F.col("citations").alias("cited_by_count"),
        F.when(F.col("ord") % 3 == 0, place).alias("last_known_institutions"), F.when(F.col("ord") % 3 == 1, F.array(F.struct(F.struct(F.col("affiliation").alias("display_name")).alias("institution")))).alias("affiliations"), F.when(F.col("ord") % 3 == 2, place).alias("institutions"),
        F.transform("interests", lambda i: F.struct(i.alias("display_name"))).alias("topics"),
    )
    rows = table(spark, d, "authors").select("ord", F.to_json(body).alias("payload"))
    return people.openalex_authors(rows, "payload").select("ord", "name", "affiliation", "h_index", "citations", F.array_join("topics", GAP).alias("topics"))


def s2_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors as entries of the other catalogue, affiliations as texts (even rows) or objects."""
    common = [F.col("semantic_scholar_id").alias("authorId"), F.col("name"), F.col("h_index").alias("hIndex"), F.col("citations").alias("citationCount"), F.col("homepage")]
    body = F.when(F.col("ord") % 2 == 0, F.to_json(F.struct(*common, F.array_compact(F.array("affiliation")).alias("affiliations")))).otherwise(F.to_json(F.struct(*common, F.array(F.struct(F.col("affiliation").alias("name"))).alias("affiliations"))))
    return people.s2_authors(table(spark, d, "authors").select("ord", body.alias("payload")), "payload").select("ord", "id", "name", "affiliation", "h_index", "citations", "profile_url")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the snapshot as answers: works in order of delivery."""
    rows = table(spark, d, "snapshot_citations").select("ord", F.col("cited_id"), F.col("citing_id"), F.year("recorded_at").alias("year"))
    return rows.where("cited_id IS NOT NULL AND citing_id IS NOT NULL")


def citing_page(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery as an answer that gives its citing work twice: the later title counts."""
    work = lambda t: F.struct(F.col("citing_id").alias("id"), t.alias("title"), F.col("year").alias("publication_year"))
    n = F.col("ord").cast("string")
    rows = _answers(spark, d).select("ord", F.col("cited_id").alias("cited"), F.to_json(F.struct(F.array(work(F.concat(F.lit("a"), n)), work(F.concat(F.lit("b"), n))).alias("results"))).alias("payload"))
    return people.citing_page(rows, "payload", "ord").select("cited", "citing", "title", "year")


def citing_list(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery as an answer with a nameless work and the citing one, at its second place."""
    paper = F.struct(F.struct(F.col("citing_id").alias("paperId"), F.col("year")).alias("citingPaper"))
    nobody = F.struct(F.struct(F.lit("").alias("paperId"), F.lit(None).cast("int").alias("year")).alias("citingPaper"))
    rows = _answers(spark, d).select(F.col("cited_id").alias("cited"), F.to_json(F.struct(F.array(nobody, paper, paper).alias("data"))).alias("payload"))
    return people.citing_list(rows, "payload").select("cited", "citing", "place")


def citation_answer(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty citations of each work in order of delivery; self-citations are skipped."""
    return people.citation_answer(_answers(spark, d), "cited_id", "citing_id", "ord")


def cited_in_links(spark: SparkSession, d: str) -> DataFrame:
    """Link sets between PubMed numbers: each paper is cited by the number after its own, and by itself (which is dropped)."""
    next_ = (F.col("pmid").try_cast("bigint") + 1).cast("string")
    sets = F.struct(F.array(F.struct(F.array("pmid").alias("ids"), F.array(F.struct(F.lit("pubmed_pubmed_citedin").alias("linkname"), F.array(next_, F.col("pmid")).alias("links"))).alias("linksetdbs"))).alias("linksets"))
    rows = table(spark, d, "papers").where(F.col("pmid").rlike("^[1-9][0-9]{0,7}$")).select(F.col("pmid").alias("cited"), F.to_json(sets).alias("payload"))
    return people.cited_in_links(rows, "payload")


def source_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """What each source can be asked for."""
    return spark.createDataFrame(people.capability_rows(), "source string, operation string")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Authors written as a spreadsheet-safe CSV and read again: nested cells as JSON, formula cells guarded."""
    path = _folder(spark)
    rows = table(spark, d, "authors").select("ord", F.concat(F.when(F.col("ord") % 5 == 0, "=").otherwise(""), "name").alias("name"), "aliases", F.array_join("venues", ";").alias("venues"), "h_index")
    sinks.export(rows, path, "csv", excel_safe=True, order="ord")
    back = sinks.read_csv(spark, path, ["ord", "name"], ("venues",))
    return back.select(F.col("ord").cast("bigint").alias("ord"), "name", F.size(F.from_json("aliases", "array<string>")).alias("n_aliases"), F.size("venues").alias("n_venues"), F.col("h_index").try_cast("int").alias("h_index"))


def json_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot works written as JSON lines and read as work lines."""
    path = _folder(spark)
    rows = table(spark, d, "snapshot_works").select("id", "title", F.col("year").alias("publication_year"), "doi", "cited_by_count", F.array("id").alias("referenced_works"))
    sinks.export(rows, path, "json")
    return sinks.work_lines(spark, path).select("id", "title", F.col("publication_year").alias("year"), "doi", "cited_by_count", F.explode("referenced_works").alias("cited"))


def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Papers exported as Parquet in the order of their id and read again."""
    path = _folder(spark)
    sinks.export(table(spark, d, "papers").select("id", "ord", "title", "keywords"), path, "parquet", order="id")
    return spark.read.parquet(path).select("id", "ord", "title", F.size("keywords").alias("n_keywords"))


QUERIES = {
    f.__name__: f
    for f in (
        openalex_works, crossref_items, europe_pmc_results, core_works, byline_texts, unpaywall_locations, coci_edges, atom_entries, pubmed_articles, ieee_articles, search_hits, publishers, manifest_files, openalex_authors, s2_authors,
        citing_page, citing_list, citation_answer, cited_in_links, source_capabilities, csv_round_trip, json_lines_round_trip, parquet_round_trip,
    )
}

_N = "array_to_string(list_filter(list_transform({0}, lambda a: a.name), lambda x: x IS NOT NULL{1}), '; ')"
_ALL, _SOME = _N.format("coalesce(authors, [])", ""), _N.format("coalesce(authors, [])", " AND x <> ''")
_PUB = "CASE split_part(trim(doi), '/', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in articles.PUBLISHERS.items()) + " END"
_CAPS = "('arxiv','arxiv'),('arxiv','author_papers'),('arxiv','doi'),('arxiv','search'),('core','doi'),('core','full_text'),('core','search'),('core','work'),('crossref','doi'),('crossref','search'),('europe_pmc','doi'),('europe_pmc','full_text'),('europe_pmc','pmid'),('europe_pmc','search'),('google_scholar','author_papers'),('google_scholar','citations'),('google_scholar','doi'),('google_scholar','search'),('ieee','author_papers'),('ieee','doi'),('ieee','search'),('openalex','author_papers'),('openalex','citations'),('openalex','citing_papers'),('openalex','doi'),('openalex','search'),('openalex','work'),('opencitations','citations'),('pubmed','author_papers'),('pubmed','citations'),('pubmed','doi'),('pubmed','search'),('semantic_scholar','author_papers'),('semantic_scholar','citations'),('semantic_scholar','doi'),('semantic_scholar','search'),('unpaywall','doi'),('unpaywall','full_text')"
ORACLES = {
    "openalex_works": f"""SELECT ord, 'W' || ord AS id, title, year, {_DOI.format("'https://doi.org/' || doi")} AS doi, citations, venue, pdf_url, nullif(CASE WHEN venue = publisher THEN venue ELSE concat_ws(' ', venue, publisher) END, '') AS abstract, {_ALL} AS names, coalesce('W' || citations, '') AS refs FROM papers""",
    "crossref_items": f"""SELECT ord, {_DOI.format('doi')} AS doi, title, CASE WHEN ord % 3 = 0 AND year IS NOT NULL THEN year ELSE year + 1 END AS year, venue, coalesce(CASE WHEN ord % 2 = 0 THEN publisher END, {_PUB}) AS publisher, citations,
        array_to_string(list_transform(coalesce(authors, []), lambda a: trim(concat_ws(' ', 'Dr', a.name))), '; ') AS names, array_to_string(list_filter(list_transform(coalesce(authors, []), lambda a: a.affiliation), lambda x: x IS NOT NULL), '; ') AS places FROM papers""",
    "europe_pmc_results": rf"""SELECT ord, CASE WHEN regexp_matches(trim(pmid), '^[0-9]{{1,8}}$') THEN trim(pmid) END AS pmid, {_DOI.format('doi')} AS doi, CASE WHEN year BETWEEN 1800 AND 2100 THEN year END AS year, venue, CASE WHEN ord % 2 = 0 THEN pdf_url END AS pdf_url,
        CAST(length(trim(regexp_replace(regexp_replace(title, '[<>]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS INT) AS n_title FROM papers""",
    "core_works": f"SELECT ord, substr(title, 1, 500) AS title, {_DOI.format('doi')} AS doi, year, substr(coalesce(CASE WHEN ord % 2 = 0 THEN nullif(publisher, '') END, venue), 1, 300) AS venue, pdf_url, {_ALL} AS names FROM papers",
    "byline_texts": f"SELECT ord, {_SOME} AS names FROM papers",
    "unpaywall_locations": r"""WITH l AS (SELECT ord, 0 AS r, pdf_url AS url, 'publisher' AS host_type FROM papers WHERE regexp_matches(pdf_url, '^https?://') UNION ALL SELECT ord, 1, url, 'repository' FROM papers WHERE regexp_matches(url, '^https?://') AND url IS DISTINCT FROM pdf_url)
        SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY r) - 1 AS INT) AS rank, url, host_type FROM l""",
    "coci_edges": f"SELECT citing, cited FROM (SELECT DISTINCT {_DOI.format('''string_split(trim('coci => ' || doi), ' ')[-1]''')} AS citing, '10.5072/n' || ord AS cited FROM papers) WHERE citing IS NOT NULL AND lower(citing) <> lower(cited)",
    "atom_entries": f"SELECT ord, 'No. ' || ord AS title, CAST(substr(year || '-05', 1, 4) AS INT) AS year, {_DOI.format('doi')} AS doi, CASE WHEN ord % 2 = 0 THEN 'J. Test' ELSE 'arXiv:cs.DB' END AS venue, 'A. One; B. Two' AS names, regexp_matches(lower('http://arxiv.org/abs/' || arxiv_id), '(^|[^0-9.])[0-9]{{4}}\\.[0-9]{{4,5}}(v[0-9]+)?(\\.pdf)?/?\\s*$|(^|[/:\\s])[a-z\\-]+(\\.[a-z]{{2}})?/[0-9]{{7}}(v[0-9]+)?(\\.pdf)?/?\\s*$') AS named FROM papers WHERE arxiv_id IS NOT NULL AND year IS NOT NULL",
    "pubmed_articles": rf"""SELECT ord, CASE WHEN regexp_matches(trim(pmid), '^[0-9]{{1,8}}$') THEN trim(pmid) END AS pmid, 'Title ' || ord AS title, 'AIM: First. Second.' AS abstract, CASE WHEN ord % 2 = 0 THEN CASE WHEN year >= 0 THEN year END WHEN regexp_matches(substr(year || ' Spring', 1, 4), '^[0-9]+$') THEN CAST(substr(year || ' Spring', 1, 4) AS INT) END AS year,
        'J Test' AS venue, {_DOI.format('trim(doi)')} AS doi, 'Ann One; B Two; The Group' AS names, 'Rivers; Lakes' AS keywords FROM papers WHERE pmid IS NOT NULL""",
    "ieee_articles": f"""SELECT ord, coalesce(nullif(trim(title), ''), 'Untitled') AS title, TRY_CAST(substr(CAST(year AS VARCHAR), 1, 4) AS INT) AS year, nullif(trim(venue), '') AS venue, {_DOI.format('doi')} AS doi, 'https://ieeexplore.ieee.org/document/' || ord AS url, 'https://example.org/p.pdf' AS pdf_url, citations,
        CASE WHEN ord % 2 = 0 THEN {_SOME} ELSE 'A. One; B. Two' END AS names, 'rivers; lakes; seas' AS keywords FROM papers""",
    "search_hits": "SELECT ord, CAST(ord AS VARCHAR) AS id, 'Title ' || ord AS title, year, CASE ord % 3 WHEN 0 THEN 'Some Journal' WHEN 1 THEN 'Press' ELSE 'Conference on Rivers, ' || year END AS venue, citations, CASE ord % 3 WHEN 0 THEN 'A One; B Two' WHEN 1 THEN 'A One' ELSE 'Conference on Rivers; ' || year END AS names FROM papers WHERE year BETWEEN 1900 AND 2099",
    "publishers": f"SELECT * FROM (SELECT ord, {_PUB} AS publisher FROM (SELECT ord, '10.' || (ord % 600 + 1000) || '/' || ord AS doi FROM papers)) WHERE publisher IS NOT NULL",
    "manifest_files": "WITH m AS (SELECT strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS m, count(*) AS n FROM snapshot_works GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INT) AS at, 'https://bucket.s3.amazonaws.com/data/works/updated_date=' || m || '-01/part_000.gz' AS url, n AS records, m || '-01' AS part FROM m",
    "openalex_authors": "SELECT ord, coalesce(nullif(name, ''), 'Unknown') AS name, nullif(affiliation, '') AS affiliation, h_index, citations, array_to_string(list_filter(coalesce(interests, []), lambda x: x <> ''), '; ') AS topics FROM authors",
    "s2_authors": "SELECT ord, semantic_scholar_id AS id, coalesce(nullif(name, ''), 'Unknown') AS name, nullif(affiliation, '') AS affiliation, h_index, citations, 'https://www.semanticscholar.org/author/' || semantic_scholar_id AS profile_url FROM authors",
    "citing_page": f"WITH r AS (SELECT ord, cited_id AS cited, {_WORK.format('citing_id')} AS citing, CAST(year(recorded_at AT TIME ZONE 'UTC') AS INT) AS year FROM snapshot_citations WHERE cited_id IS NOT NULL) SELECT cited, citing, 'b' || max(ord) AS title, arg_max(year, ord) AS year FROM r WHERE citing IS NOT NULL GROUP BY cited, citing",
    "citing_list": "SELECT DISTINCT cited_id AS cited, citing_id AS citing, 1 AS place FROM snapshot_citations WHERE cited_id IS NOT NULL AND citing_id <> ''",
    "citation_answer": "SELECT cited_id, citing_id FROM snapshot_citations WHERE citing_id <> cited_id QUALIFY row_number() OVER (PARTITION BY cited_id ORDER BY ord) <= 50",
    "cited_in_links": "SELECT DISTINCT pmid AS cited, CAST(CAST(pmid AS BIGINT) + 1 AS VARCHAR) AS citing FROM papers WHERE regexp_matches(pmid, '^[1-9][0-9]{0,7}$')",
    "source_capabilities": f"SELECT * FROM (VALUES {_CAPS}) v(source, operation)",
    "csv_round_trip": r"""SELECT ord, CASE WHEN regexp_matches(n, '^[=+\-@\t\r]') THEN '''' || n ELSE n END AS name, CAST(len(aliases) AS INT) AS n_aliases, CAST(len(list_filter(list_transform(string_split(array_to_string(venues, ';'), ';'), lambda x: trim(x)), lambda x: x <> '')) AS INT) AS n_venues, h_index FROM (SELECT *, CASE WHEN ord % 5 = 0 THEN '=' ELSE '' END || name AS n FROM authors)""",
    "json_lines_round_trip": "SELECT id, title, year, doi, cited_by_count, id AS cited FROM snapshot_works",
    "parquet_round_trip": "SELECT id, ord, title, CAST(len(keywords) AS INT) AS n_keywords FROM papers",
}
