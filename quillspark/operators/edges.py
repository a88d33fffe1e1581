"""Edge tables: authorships, co-authorships, citations, byline resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.ids import record_key
from quillspark.functions.text import title_key, work_key
from quillspark.session import lookup


def authorships(papers: DataFrame) -> DataFrame:
    """``paper, author, position, year``: one row per paper and author; names without an id are ``~<name key>``.

    Papers without an id use ``ord:<ord>``. An author named twice in a byline keeps the first position.
    """
    each = papers.select(F.coalesce("id", F.concat(F.lit("ord:"), F.col("ord").cast("string"))).alias("paper"), "year", F.explode("authors").alias("a"))
    author = F.coalesce(record_key(F.col("a.author_id")), F.concat(F.lit("~"), title_key(F.col("a.name"))))
    return each.groupBy("paper", author.alias("author")).agg(F.min("a.position").alias("position"), F.min("year").alias("year"))


def coauthor_pairs(rows: DataFrame) -> DataFrame:
    """``a, b, papers, first_year, last_year`` for authors (a < b) that share papers; ``~`` names are left out.

    The pairs of a byline are made inside its row (a byline is a bounded list), so there is no self join on the paper.
    """
    known = rows.where(~F.col("author").startswith("~"))
    bylines = known.groupBy("paper").agg(F.array_sort(F.collect_set("author")).alias("s"), F.min("year").alias("year"))
    pairs = bylines.select("paper", "year", F.posexplode("s").alias("i", "a"), "s").select("paper", "year", "a", F.explode(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.countDistinct("paper").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def citation_edges(citations: DataFrame) -> DataFrame:
    """``citing, cited``: distinct normalised citations without self-citations and missing ends."""
    return citations.select(work_key(F.col("citing_id")).alias("citing"), work_key(F.col("cited_id")).alias("cited")).where("citing IS NOT NULL AND cited IS NOT NULL AND citing <> cited").distinct()


def resolve_names(entries: DataFrame, authors: DataFrame) -> DataFrame:
    """Adds ``resolved``: the id of the author with the same name (case aside), else ``~<name>``; ids given stay.

    A name that several authors have takes the smallest id. The author side has one row a name; frequent names are looked up where they are.
    """
    known = authors.where("name IS NOT NULL").groupBy(F.lower(F.trim("name")).alias("_n")).agg(F.min("id").alias("_id"))
    keyed = entries.withColumn("_n", F.lower(F.trim("name")))
    given = record_key(F.col("author_id"))
    return lookup(keyed, known, "_n").withColumn("resolved", F.coalesce(given, F.col("_id"), F.concat(F.lit("~"), F.col("_n")))).drop("_n", "_id")
