"""Citing works: snapshot index, merging of sources, flattened authors, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.functions.ids import record_key
from quillspark.functions.text import work_key
from quillspark.session import lookup


def load_works(works: DataFrame) -> DataFrame:
    """One row a work: the first load wins (time, then title), ids in one notation; rows without id are left out."""
    keyed = works.withColumn("id", work_key(F.col("id"))).where("id IS NOT NULL")
    order = F.struct("loaded_at", F.coalesce("title", F.lit("")), F.coalesce("year", F.lit(0)), F.coalesce("cited_by_count", F.lit(0)))
    return keyed.groupBy("id").agg(F.min_by(F.struct("title", "year", "doi", "cited_by_count"), order).alias("w")).select("id", "w.*")


def inverted_edges(citations: DataFrame) -> DataFrame:
    """``cited, citing``: distinct edges as loaded; a work may cite itself."""
    return citations.select(work_key(F.col("cited_id")).alias("cited"), work_key(F.col("citing_id")).alias("citing")).where("cited IS NOT NULL AND citing IS NOT NULL").distinct()


def citing_works(edges: DataFrame, works: DataFrame) -> DataFrame:
    """Each edge with its citing work; edges whose citing work isn't stored drop out."""
    return lookup(edges.withColumn("id", F.col("citing")), works, "id", "inner").drop("id")


def top_citing(edges: DataFrame, works: DataFrame, n: int) -> DataFrame:
    """For each cited work its ``n`` most-cited citing works (then smallest id). Top n is the feature.

    Spark keeps only n rows of a group before the shuffle (window group limit), so a much-cited work is no hot spot.
    """
    w = Window.partitionBy("cited").orderBy(F.desc_nulls_last("cited_by_count"), "citing")
    return citing_works(edges, works).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def merge_sources(rows: DataFrame, key: str, rank: str, position: str, prefer_titled: bool = False) -> DataFrame:
    """One row a key over several sources: the first by source rank and position; with ``prefer_titled`` a titled row
    replaces an untitled one. Rows with a null key are left out."""
    order = F.struct(*([F.col("title").isNull()] if prefer_titled else []), F.col(rank), F.col(position))
    others = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def flatten_authors(papers: DataFrame, affiliation: str | None = None) -> DataFrame:
    """One row an author (key: id, else exact name) with first-seen name and affiliation and the papers they appear on.

    ``affiliation`` keeps only byline entries whose affiliation contains it (case-sensitive), before merging.
    """
    each = papers.select("ord", F.posexplode("authors").alias("at", "a")).where("a.name IS NOT NULL")
    if affiliation:
        each = each.where(F.col("a.affiliation").contains(affiliation))
    rows = each.select("ord", "at", F.col("a.name").alias("name"), F.col("a.affiliation").alias("affiliation"), record_key(F.col("a.author_id")).alias("id"))
    key = F.when(F.col("id").isNotNull(), F.concat(F.lit("id:"), "id")).otherwise(F.concat(F.lit("name:"), "name"))
    return rows.groupBy(key.alias("author")).agg(F.min_by(F.struct("name", "affiliation"), F.struct("ord", "at")).alias("f"), F.countDistinct("ord").alias("n_papers"), F.min("ord").alias("first_ord")).select("author", "f.name", "f.affiliation", "n_papers", "first_ord")


def top_works(papers: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most-cited papers of each author with an id, ties by ord; top n is the feature."""
    rows = papers.select("ord", "citations", F.explode("authors").alias("a")).select("ord", "citations", record_key(F.col("a.author_id")).alias("author")).where("author IS NOT NULL").distinct()
    w = Window.partitionBy("author").orderBy(F.desc_nulls_last("citations"), "ord")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def join_profiles(authors: DataFrame, profiles: DataFrame) -> DataFrame:
    """Flattened authors with the profile of their id, else of their exact name if just one profile has it."""
    by_id = profiles.groupBy(F.concat(F.lit("id:"), "id").alias("author")).agg(F.min(F.struct("id", "h_index", "citations")).alias("p"))
    by_name = profiles.groupBy(F.concat(F.lit("name:"), "name").alias("author")).agg(F.min(F.struct("id", "h_index", "citations")).alias("p"), F.countDistinct("id").alias("n")).where("n = 1").drop("n")
    return authors.join(by_id.unionByName(by_name), "author", "left").select("author", "n_papers", F.col("p.id").alias("profile"), F.col("p.h_index").alias("h_index"), F.col("author").startswith("name:").alias("by_name"))


def author_profiles(papers: DataFrame, most: int = 15) -> DataFrame:
    """Profile of each author id from its papers: sum of citations, papers, and its first ``most`` distinct keywords (by ord)."""
    rows = papers.select("ord", "citations", "keywords", F.explode("authors").alias("a")).select("ord", "citations", "keywords", record_key(F.col("a.author_id")).alias("author")).where("author IS NOT NULL").dropDuplicates(["author", "ord"])
    words = rows.select("author", "ord", F.posexplode("keywords").alias("at", "k")).groupBy("author", F.lower("k").alias("k")).agg(F.min(F.struct("ord", "at")).alias("o"))
    w = Window.partitionBy("author").orderBy("o")
    kept = words.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("author").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "k"))), lambda x: x["k"]), "; ").alias("keywords"))
    sums = rows.groupBy("author").agg(F.sum("citations").alias("citations"), F.count(F.lit(1)).alias("n_papers"))
    return sums.join(kept, "author", "left")
