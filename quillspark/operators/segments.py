"""Paragraph segments of page lines, and classification of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# How much larger a heading is set, and gaps that end a paragraph, in parts of the line height.
HEADING_FACTOR, HEADING_DELTA, GAP_FACTOR, SPACING, TIGHT, FALLBACK_HEIGHT = 1.15, 0.5, 1.5, 1.2, 1.5, 12.0
# Marks of a challenge page, in the order in which they are looked for.
CHALLENGES = (
    "cf-challenge", "__cf_chl_", "cf-browser-verification", "just a moment", "checking your browser", "verify you are human", "verify you're human", "verify your identity", "captcha",
    "recaptcha", "hcaptcha", "access denied", "attention required", "request blocked", "unusual traffic", "you have been blocked", "enable javascript and cookies to continue",
    "please enable javascript and cookies",
)
# Root containers of pages that a client renders, and the notice that they need it.
ROOTS = ('<div id="app"', '<div id="root"', '<div id="__next"', '<div id="__nuxt"', '<div id="main-container"', '<div id="application"')
NOTICE = r"(?s)<noscript[^>]*>.*?(enable javascript|javascript is required|please enable javascript|javascript must be enabled).*?</noscript>"


def segment_lines(lines: DataFrame) -> DataFrame:
    """``doc, segment, heading, page, text``: paragraphs of the lines (doc, page, top, size, font, text).

    A heading (bold, or clearly larger than the median size) ends a paragraph and names those after it; so do a new page and a
    gap above the threshold. A null top is the line's place on its page (column ``line``). Documents without lines give nothing;
    a document is sorted as a whole, so its number of lines bounds a group.
    """
    placed = lines.withColumn("top", F.coalesce("top", F.col("line").cast("double")))
    order = Window.partitionBy("doc").orderBy("page", "top", "line")
    sizes = placed.groupBy("doc").agg(F.median("size").alias("body"))
    gaps = placed.withColumn("gap", F.when(F.lag("page").over(order) == F.col("page"), F.col("top") - F.lag("top").over(order)))
    rows = gaps.join(sizes, "doc")
    font = F.coalesce(F.col("body") * SPACING, F.lit(FALLBACK_HEIGHT))
    tight = rows.where((F.col("gap") > 0) & (F.col("gap") <= font * TIGHT)).groupBy("doc").agg(F.median("gap").alias("tight"))
    height = F.coalesce("tight", font)
    threshold = F.greatest(F.lit(GAP_FACTOR) * height, F.coalesce(F.col("body") * HEADING_FACTOR, F.lit(0.0)))
    heading = F.coalesce(F.lower("font").contains("bold"), F.lit(False)) | F.coalesce((F.col("size") > F.col("body") * HEADING_FACTOR) & (F.col("size") - F.col("body") >= HEADING_DELTA), F.lit(False))
    marked = rows.join(tight, "doc", "left").withColumn("is_heading", heading).withColumn("threshold", threshold)
    after = F.coalesce(F.lag("is_heading").over(order), F.lit(True))
    breaks = (F.col("is_heading") | after | (F.lag("page").over(order) != F.col("page")) | (F.col("gap") > F.col("threshold"))).cast("int")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    named = marked.withColumn("break", F.coalesce(breaks, F.lit(1))).withColumn("part", F.sum("break").over(running)).withColumn("heading", F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(running))
    body = named.where(~F.col("is_heading")).groupBy("doc", "part").agg(
        F.min("heading").alias("heading"), F.min("page").alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "top", "line", "text"))), lambda x: x["text"]), " ").alias("text")
    )
    return body.withColumn("segment", F.row_number().over(Window.partitionBy("doc").orderBy("part"))).drop("part")


def challenge_mark(page: Column) -> Column:
    """The first of ``CHALLENGES`` in the first 64 KiB or the title of a page; null if there is none."""
    sample = F.concat(F.lower(F.substring(page, 1, 65536)), F.lit("\n"), F.lower(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.coalesce(*[F.when(sample.contains(mark), mark) for mark in CHALLENGES])


def page_status(status: Column, page: Column) -> Column:
    """blocked (401, 403, 429 or a challenge mark), failed (400 and above) or ok."""
    return F.when(status.isin(401, 403, 429) | challenge_mark(page).isNotNull(), "blocked").when(status >= 400, "failed").otherwise("ok")


def page_title(page: Column) -> Column:
    """The text of the first title element, entities and blanks resolved; null where there is none."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def page_text(page: Column) -> Column:
    """A page without scripts, styles and tags, with single blanks."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.replace(F.replace(bare, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def needs_script(page: Column) -> Column:
    """Whether a page seems to be rendered by the client: a root container and the notice, or hardly any text, in its first 20,000 characters."""
    head = F.lower(F.substring(page, 1, 20000))
    root = F.lit(False)
    for mark in ROOTS:
        root = root | head.contains(mark)
    return F.coalesce(root & (head.rlike(NOTICE) | (F.length(F.trim(F.regexp_replace(head, r"<[^>]+>", " "))) < 200)), F.lit(False))


def page_links(page: Column) -> Column:
    """Absolute http(s) links of a page, first occurrences only."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r"(?i)href=[\"'](https?://[^\"'\s>]+)"), F.lit(1)))
