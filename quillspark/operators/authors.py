"""Authors as clusters: scored pairs closed transitively, ambiguous clusters, and greedy deduplication by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import jaccard, squeezed_blanks, title_key, tokens
from quillspark.operators.changes import AMBIGUOUS, SAME, author_key, author_pairs, author_scores
from quillspark.operators.components import connected_components
from quillspark.operators.fusion import similar_titles
from quillspark.operators.identity import fuse_authors
from quillspark.session import cut, lookup

NAME_SHARE = 0.80
MOST_ROUNDS = 200


def author_clusters(authors: DataFrame) -> DataFrame:
    """``ord, cluster`` (smallest ord), ``ambiguous``: authors whose pairs score as the same person, closed transitively.

    Rows that say the same in all compared fields are one from the start, so copies cost nothing. A cluster is ambiguous if one of
    its rows and a row of another cluster score between the two bands.
    """
    keyed = cut(authors.select("ord", author_key().alias("k")))
    firsts = keyed.groupBy("k").agg(F.min("ord").alias("first"))
    member = cut(lookup(keyed, firsts, "k", "inner").select("ord", "first"))
    scores = cut(author_scores(author_pairs(authors), AMBIGUOUS))
    found = connected_components(scores.where(F.col("total") >= SAME).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b")))
    placed = member.join(found.withColumnRenamed("vertex", "first"), "first", "left").withColumn("cluster", F.coalesce("component", "first")).select("ord", "first", "cluster")
    of = placed.where("ord = first").select("first", "cluster")
    near = scores.where((F.col("total") >= AMBIGUOUS) & (F.col("total") < SAME)).join(of.toDF("a_ord", "ca"), "a_ord").join(of.toDF("b_ord", "cb"), "b_ord").where("ca <> cb")
    doubtful = near.select(F.explode(F.array("ca", "cb")).alias("cluster")).distinct().withColumn("ambiguous", F.lit(True))
    return placed.join(doubtful, "cluster", "left").select("ord", "cluster", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def disambiguated(authors: DataFrame) -> DataFrame:
    """One author a cluster of :func:`author_clusters` with the union of coauthors, venues and years (sorted); the status stays confirmed
    if any row is, is ambiguous for ambiguous clusters, else auto."""
    placed = cut(author_clusters(authors))
    rows = authors.join(placed, "ord")
    fused = fuse_authors(rows.drop("ambiguous"), "cluster")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    more = rows.groupBy("cluster").agg(union("coauthors"), union("venues"), union("active_years"), F.max("ambiguous").alias("ambiguous"))
    status = F.when(F.col("confirmed") == 1, "confirmed").when(F.col("ambiguous"), "ambiguous").otherwise("auto")
    return fused.join(more, "cluster").withColumn("status", status).drop("confirmed", "ambiguous")


def seed_clusters(authors: DataFrame, share: float = NAME_SHARE) -> DataFrame:
    """``ord, cluster``: each author in the order of ``ord`` is a seed that takes all later free ones with the same name key or a word
    Jaccard of ``share`` or more.

    The greedy pass has one result that doesn't need an order of work: a name is a seed just if no earlier similar name is one, and
    belongs to the first seed it is similar to. Rounds settle all names whose earlier neighbours are settled. Equal names are one node.
    """
    named = authors.select("ord", title_key(F.coalesce("name", F.lit(""))).alias("title"))
    nodes = cut(named.groupBy("title").agg(F.min("ord").alias("n")).withColumn("words", tokens(F.col("title"))))
    pairs = similar_titles(nodes.where(F.size("words") > 0).select("title", "words"), share)
    one = nodes.select(F.col("title").alias("t1"), F.col("n").alias("x"))
    edges = cut(pairs.join(one, "t1").join(one.toDF("t2", "y"), "t2").select(F.least("x", "y").alias("early"), F.greatest("x", "y").alias("late")))
    settled = cut(nodes.join(edges.select(F.col("late").alias("n")).distinct(), "n", "left_anti").select("n", F.col("n").alias("seed")))
    left = cut(nodes.select("n").join(settled.select("n"), "n", "left_anti"))
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        known = settled.select(F.col("n").alias("early"), "seed", F.lit(True).alias("known"))
        seen = edges.join(left.withColumnRenamed("n", "late"), "late").join(known, "early", "left")
        state = seen.groupBy("late").agg(F.min(F.when(F.col("seed") == F.col("early"), F.col("early"))).alias("first"), F.min(F.when(F.col("known").isNull(), F.col("early"))).alias("open"))
        # A seed that is earlier than all open neighbours is the first one for good.
        done = state.where(F.col("open").isNull() | (F.col("first") < F.col("open"))).select(F.col("late").alias("n"), F.coalesce("first", "late").alias("seed"))
        done = cut(done)
        settled = cut(settled.unionByName(done))
        left = cut(left.join(done.select("n"), "n", "left_anti"))
    else:
        raise RuntimeError(f"names remain after {MOST_ROUNDS} rounds")
    placed = nodes.select("title", "n").join(settled, "n").select("title", F.col("seed").alias("cluster"))
    return lookup(named, placed, "title", "inner").select("ord", "cluster")


def enriched_authors(authors: DataFrame) -> DataFrame:
    """Names, affiliations and interests with single blanks; interests without repeats (case aside, the first spelling stays) or blanks."""
    clean = F.filter(F.transform(F.coalesce("interests", F.array().cast("array<string>")), squeezed_blanks), lambda i: i != "")
    firsts = F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)
    return authors.withColumns({"name": squeezed_blanks(F.col("name")), "affiliation": squeezed_blanks(F.col("affiliation")), "interests": firsts})


def shares_identity(a: str, b: str) -> Column:
    """Whether two papers (structs) share an exact identifier: DOI, arXiv id, PMID, link or internal id, in normal form."""
    test = F.lit(False)
    for f in ("doi", "arxiv", "pmid", "url", "id"):
        test = test | F.coalesce(F.col(f"{a}.{f}") == F.col(f"{b}.{f}"), F.lit(False))
    return test


def titles_conflict(a: str, b: str) -> Column:
    """Whether two papers have different title keys, neither empty."""
    x, y = F.col(f"{a}.title"), F.col(f"{b}.title")
    return F.coalesce((x != "") & (y != "") & (x != y), F.lit(False))


def same_names(a: Column, b: Column, share: float = NAME_SHARE) -> Column:
    """The test of :func:`seed_clusters` on two names."""
    x, y = title_key(a), title_key(b)
    return (x == y) | (jaccard(tokens(x), tokens(y)) >= share)
