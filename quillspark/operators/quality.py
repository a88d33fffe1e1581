"""Validity, warnings, completeness, confidence and enrichment of records."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.text import squeezed_blanks, url_ok

# Trust in a record that one source alone reports, by source (alphabetical).
BASELINE = {
    "arxiv": 0.95, "core": 0.85, "crossref": 0.90, "europe_pmc": 0.90, "google_scholar": 0.75, "ieee": 0.85, "openalex": 0.90,
    "opencitations": 0.85, "pubmed": 0.92, "semantic_scholar": 0.88, "unpaywall": 0.85,
}
DEFAULT_BASELINE = 0.50
MULTI_SOURCE, DOI_BONUS, PDF_BONUS, STALE_PENALTY, STALE_DAYS = 0.05, 0.05, 0.03, 0.10, 730
EVIDENCE_CAP = 500
LEAST_CONFIDENCE = 0.5
# The DOI prefix of polluted records, and the formats of DOIs and e-mail addresses.
SUSPICIOUS_PREFIX = "10.65215"
DOI_TEXT = r"^(?i)10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+$"
EMAIL_TEXT = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def _given(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def paper_errors(now: datetime) -> Column:
    """Names of the fields that make a paper invalid, in a fixed order."""
    year = F.col("year")
    bad_evidence = lambda e: ~F.coalesce((e["confidence"] >= 0) & (e["confidence"] <= 1), F.lit(False))
    tests = [
        ("title", ~_given(F.col("title"))),
        ("year", F.coalesce((year < 1800) | (year > now.year + 1), F.lit(False))),
        ("doi", F.coalesce(_given(F.col("doi")) & ~F.col("doi").rlike(DOI_TEXT), F.lit(False))),
        ("citations", F.coalesce(F.col("citations") < 0, F.lit(False))),
        ("evidence", F.coalesce(F.size("evidence_list"), F.lit(0)) <= 0),
        ("evidence.source_url", F.coalesce(F.exists("evidence_list", lambda e: ~_given(e["source_url"])), F.lit(False))),
        ("evidence.confidence", F.coalesce(F.exists("evidence_list", bad_evidence), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))


def paper_warnings(now: datetime, columns: dict[str, str] | None = None, least: float = LEAST_CONFIDENCE) -> Column:
    """Names of doubtful fields; warnings never make a record invalid. With ``columns`` (name to type) also 'confidence' for records
    whose confidence is below ``least``."""
    tests = [
        ("title", F.coalesce(F.length("title") > 500, F.lit(False))),
        ("authors", F.coalesce(F.size("authors"), F.lit(0)) <= 0),
        ("url", _given(F.col("url")) & ~url_ok(F.col("url"))),
        ("pdf_url", _given(F.col("pdf_url")) & ~url_ok(F.col("pdf_url"))),
        ("future_year", F.coalesce(F.col("year") > now.year, F.lit(False))),
        ("doi_prefix", F.coalesce(F.lower(F.trim("doi")).startswith(SUSPICIOUS_PREFIX), F.lit(False))),
    ]
    if columns is not None:
        tests.append(("confidence", record_confidence(now, columns) < least))
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))


def author_errors() -> Column:
    tests = [
        ("name", ~_given(F.col("name"))),
        ("email", F.coalesce(_given(F.col("email")) & ~F.col("email").rlike(EMAIL_TEXT), F.lit(False))),
        ("h_index", F.coalesce(F.col("h_index") < 0, F.lit(False))),
        ("citations", F.coalesce(F.col("citations") < 0, F.lit(False))),
        ("evidence", F.coalesce(F.size("evidence_list"), F.lit(0)) <= 0),
    ]
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))


COMPLETENESS = ("title", "authors", "year", "venue", "abstract", "doi", "url", "citations")


def completeness(columns: dict[str, str]) -> Column:
    """The share of the fields of ``COMPLETENESS`` that are filled (``columns``: name to type)."""
    filled = []
    for c in COMPLETENESS:
        kind = columns[c]
        ok = F.coalesce(F.size(c), F.lit(0)) > 0 if kind.startswith("array") else F.coalesce(F.col(c) != "", F.lit(False)) if kind == "string" else F.col(c).isNotNull()
        filled.append(ok.cast("int"))
    total = filled[0]
    for f in filled[1:]:
        total = total + f
    return total.cast("double") / F.lit(float(len(filled)))


def valid_evidence(c: str) -> Column:
    """Entries with a confidence within 0..1."""
    return F.filter(F.coalesce(F.col(c), F.array()), lambda e: (e["confidence"] >= 0) & (e["confidence"] <= 1))


def primary_evidence(c: str) -> Column:
    """The entry with the highest confidence; the first of equals."""
    entries = valid_evidence(c)
    ranked = F.transform(entries, lambda e, i: F.struct(e["confidence"].alias("confidence"), (-i).alias("back"), e["source"].alias("source"), e["collected_at"].alias("collected_at"), e["raw_data"].alias("raw_data")))
    return F.array_max(ranked)


def record_confidence(now: datetime, columns: dict[str, str]) -> Column:
    """0.7 of the evidence score plus 0.3 of the completeness, within 0..1.

    The evidence score is the primary entry's confidence, +.02 with raw data, +.01 if at most 30 days old.
    """
    p = primary_evidence("evidence_list")
    days = F.floor((F.unix_micros(F.lit(now)) - F.unix_micros(p["collected_at"])) / F.lit(86_400_000_000))
    score = F.least(F.lit(1.0), p["confidence"] + F.when(F.coalesce(F.length(p["raw_data"]) > 0, F.lit(False)), 0.02).otherwise(0.0))
    score = F.least(F.lit(1.0), score + F.when(F.coalesce(days <= 30, F.lit(False)), 0.01).otherwise(0.0))
    score = F.when(p.isNotNull(), score).otherwise(0.0)  # least() skips nulls, so a record without evidence is set apart
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.7) * score + F.lit(0.3) * completeness(columns)))


def composite_confidence(sources: Column) -> Column:
    """Highest baseline of the sources plus .05 for each further one, at most 1; null without sources."""
    base = F.array_max(F.transform(F.array_distinct(sources), lambda s: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in BASELINE.items() for x in (F.lit(k), F.lit(v))]), s), F.lit(DEFAULT_BASELINE))))
    n = F.size(F.array_distinct(sources))
    return F.when(n > 0, F.least(F.lit(1.0), base + F.lit(MULTI_SOURCE) * (n - 1)))


def adjusted_confidence(conf: Column, now: datetime, doi: str, pdf: str, evidence: str) -> Column:
    """+.05 with a DOI, +.03 with a PDF link, -.10 if no entry is newer than 730 days; within 0..1, null for a null ``conf``."""
    newest = F.array_max(F.transform(F.coalesce(F.col(evidence), F.array()), lambda e: e["collected_at"]))
    days = F.floor((F.unix_micros(F.lit(now)) - F.unix_micros(newest)) / F.lit(86_400_000_000))
    c = F.least(F.lit(1.0), conf + F.when(_given(F.col(doi)), DOI_BONUS).otherwise(0.0))
    c = F.least(F.lit(1.0), c + F.when(_given(F.col(pdf)), PDF_BONUS).otherwise(0.0))
    return F.when(conf.isNotNull(), F.greatest(F.lit(0.0), c - F.when(days > STALE_DAYS, STALE_PENALTY).otherwise(0.0)))


def evidence_union(rows: DataFrame, key: str, order: str, evidence: str, best: bool = False, cap: int = EVIDENCE_CAP) -> DataFrame:
    """``key, source, source_id, confidence, collected_at, rank``: the entries of all rows of a key.

    One entry for each (source, source_id): the first in the order of ``order`` and place, or the one with the
    highest confidence if ``best``. At most ``cap`` a key are kept, those with the highest confidence (then the
    first); the cap is the feature. Null confidences rank last.
    """
    each = rows.where(F.col(key).isNotNull()).select(key, order, F.posexplode(evidence).alias("at", "e"))
    entry = F.struct(F.col("e.confidence").alias("confidence"), F.col("e.collected_at").alias("collected_at"), F.col(order).alias("o"), F.col("at").alias("at"))
    place = F.struct(F.col(order), F.col("at"))
    rank = F.struct(F.coalesce(-F.col("e.confidence"), F.lit(float("inf"))), F.col(order), F.col("at")) if best else place
    one = each.groupBy(key, F.col("e.source").alias("source"), F.col("e.source_id").alias("source_id")).agg(F.min_by(entry, rank).alias("x"))
    # Spark keeps at most cap rows of a key in each task before the shuffle (window group limit).
    w = Window.partitionBy(key).orderBy(F.coalesce(-F.col("x.confidence"), F.lit(float("inf"))), "x.o", "x.at", "source", "source_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select(key, "source", "source_id", "x.confidence", "x.collected_at", "rank")


Strategy = Callable[[DataFrame], DataFrame]


class Enrichment:
    """A chain of named strategies (DataFrame to DataFrame), applied in the order of priority, then of registration."""

    def __init__(self) -> None:
        self._steps: dict[str, tuple[int, int, Strategy]] = {}

    def register(self, name: str, priority: int, step: Strategy) -> Enrichment:
        self._steps[name] = (priority, len(self._steps), step)
        return self

    def unregister(self, name: str) -> None:
        self._steps.pop(name, None)

    def __call__(self, papers: DataFrame) -> DataFrame:
        for _, _, step in sorted(self._steps.values(), key=lambda s: s[:2]):
            papers = papers.transform(step)
        return papers


def _byline(papers: DataFrame) -> DataFrame:
    named = F.filter(F.transform("authors", lambda a: squeezed_blanks(a["name"])), lambda n: F.coalesce(F.length(n) > 0, F.lit(False)))
    firsts = F.transform(named, lambda n, i: F.struct(n.alias("name"), F.array_position(F.transform(named, F.lower), F.lower(n)).alias("first"), (i + 1).alias("at")))
    return papers.withColumn("names", F.transform(F.filter(firsts, lambda x: x["first"] == x["at"]), lambda x: x["name"]))


def standard_enrichment() -> Enrichment:
    """Titles, venues, DOIs named in texts, PDF links and bylines in the usual order; bylines come out as ``names``."""
    year_end = r",\s*(19|20)[0-9]{2}\s*$"
    texts = F.array_join(F.array_compact(F.array(F.col("url"), F.col("pdf_url"), F.col("abstract"))), " ")
    found = F.nullif(F.regexp_extract(texts, r"(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)", 1), F.lit(""))
    chain = Enrichment()
    chain.register("title", 4, lambda d: d.withColumn("title", squeezed_blanks(F.col("title"))))
    chain.register("venue", 5, lambda d: d.withColumn("venue", F.trim(F.regexp_replace(squeezed_blanks(F.col("venue")), year_end, ""))))
    chain.register("doi", 6, lambda d: d.withColumn("doi", F.when(_given(F.col("doi")), F.col("doi")).otherwise(F.coalesce(found, F.col("doi")))))
    pdf = F.when(F.lower("url").endswith(".pdf"), F.col("url")).when(F.col("url").contains("/abs/"), F.concat(F.replace(F.col("url"), F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf")))
    chain.register("pdf", 7, lambda d: d.withColumn("pdf_url", F.when(_given(F.col("pdf_url")), F.col("pdf_url")).otherwise(F.coalesce(pdf, F.col("pdf_url")))))
    chain.register("byline", 8, _byline)
    return chain
