"""Queries on quotas, page lines, fetched pages and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators import quota, segments
from quillspark.sources import payloads
from quillspark.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def quota_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Use per event type and six-hour bucket."""
    rows = quota.usage(_events(spark, d), "event_type", "ts", "value", 6 * 3600)
    return rows.select("source", F.unix_seconds("bucket").alias("bucket"), F.round("used", 4).alias("used"), "n_events")


def quota_gate(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty events of each type and day."""
    return quota.gate(_events(spark, d), "event_type", "ts", "event_id", 20, None).select("event_id", "event_type", "place")


def breaker_state(spark: SparkSession, d: str) -> DataFrame:
    """Events denied because an earlier one of the day tripped the breaker."""
    rows = _events(spark, d).withColumn("trips", F.coalesce(F.col("value") > 150, F.lit(False)))
    return quota.breaker(rows, "event_type", "ts", "event_id", "trips", None).where("denied").select("event_id", "event_type")


def segment_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents taken as page lines: short lines without a full stop are set larger."""
    text = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    heading = (F.length("text") < 40) & ~F.col("text").rlike("[.!?。]\\s*$")
    lines = text.where(F.length(F.trim("text")) > 0).select(
        "doc", F.lit(1).alias("page"), "line", (F.col("line") * 12.0).alias("top"), F.when(heading, 14.0).otherwise(10.0).alias("size"), F.lit("serif").alias("font"), "text"
    )
    return segments.segment_lines(lines)


def page_checks(spark: SparkSession, d: str) -> DataFrame:
    """Web pages among the documents: status, title and text, with the document wrapped as a page."""
    page = F.concat(F.lit("<html><head><title> Page "), F.col("doc_id").cast("string"), F.lit(" </title></head><body>"), F.when(F.col("doc_id") % 7 == 0, '<div id="app"></div>').otherwise(""), F.coalesce("text", F.lit("")), F.lit("</body></html>"))
    status = F.when(F.col("doc_id") % 11 == 0, 403).when(F.col("doc_id") % 13 == 0, 500).otherwise(200)
    rows = table(spark, d, "documents").where("section = 'webpage'").select("doc_id", page.alias("page"), status.alias("status"))
    return rows.select("doc_id", segments.page_status(F.col("status"), F.col("page")).alias("status"), segments.page_title(F.col("page")).alias("title"), F.length(segments.page_text(F.col("page"))).alias("n_text"), segments.needs_script(F.col("page")).alias("needs_script"))


def payload_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Search results written as the source's JSON and parsed again."""
    rows = table(spark, d, "s2_papers")
    body = F.struct(F.col("paperid").alias("paperId"), "title", "year", "venue", "abstract", F.col("citationcount").alias("citationCount"), F.col("externalids").alias("externalIds"), F.col("openaccesspdf").alias("openAccessPdf"), F.transform("authors", lambda a: F.struct(a["authorid"].alias("authorId"), a["name"].alias("name"))).alias("authors"))
    parsed = payloads.s2_papers(rows.select(F.to_json(body).alias("payload")), "payload")
    return parsed.select("id", "title", "year", "venue", "citations", F.array_join("names", "; ").alias("names"))


QUERIES = {f.__name__: f for f in (quota_buckets, quota_gate, breaker_state, segment_paragraphs, page_checks, payload_round_trip)}
ORACLES = {
    "quota_buckets": "SELECT event_type AS source, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS bucket, round(sum(coalesce(CAST(value AS DOUBLE), 0)), 4) AS used, count(*) AS n_events FROM events GROUP BY 1, 2",
    "quota_gate": "SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS INT) AS place FROM events QUALIFY place <= 20",
    "breaker_state": "WITH f AS (SELECT event_type, date_trunc('day', ts) AS b, min((ts, event_id)) AS f FROM events WHERE value > 150 GROUP BY 1, 2) SELECT event_id, e.event_type FROM events e JOIN f ON f.event_type = e.event_type AND f.b = date_trunc('day', ts) WHERE (ts, event_id) > f.f",
    "page_checks": r"""WITH p AS (SELECT doc_id, '<html><head><title> Page ' || doc_id || ' </title></head><body>' || CASE WHEN doc_id % 7 = 0 THEN '<div id="app"></div>' ELSE '' END || coalesce(text, '') || '</body></html>' AS page, CASE WHEN doc_id % 11 = 0 THEN 403 WHEN doc_id % 13 = 0 THEN 500 ELSE 200 END AS status FROM documents WHERE section = 'webpage'),
        q AS (SELECT *, lower(substr(page, 1, 65536)) AS h, lower(substr(page, 1, 20000)) AS k, trim(regexp_replace(replace(replace(regexp_replace(page, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM p)
        SELECT doc_id, CASE WHEN status IN (401, 403, 429) OR regexp_matches(h, '(cf-challenge|__cf_chl_|cf-browser-verification|just a moment|checking your browser|verify you are human|verify you''re human|verify your identity|captcha|recaptcha|hcaptcha|access denied|attention required|request blocked|unusual traffic|you have been blocked|enable javascript and cookies to continue|please enable javascript and cookies)') THEN 'blocked' WHEN status >= 400 THEN 'failed' ELSE 'ok' END AS status,
        'Page ' || doc_id AS title, length(t) AS n_text, regexp_matches(k, '<div id="(app|root|__next|__nuxt|main-container|application)"') AND length(trim(regexp_replace(k, '<[^>]+>', ' ', 'g'))) < 200 AS needs_script FROM q""",
    "payload_round_trip": "SELECT paperid AS id, title, year, nullif(venue, '') AS venue, citationcount AS citations, array_to_string(list_filter(list_transform(authors, lambda a: a.name), lambda x: x IS NOT NULL), '; ') AS names FROM s2_papers",
}
