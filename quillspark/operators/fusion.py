"""Candidate pairs, match rules, clusters and their fusion into one record."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import jaccard, strict_arxiv, title_key, tokens, venues_equivalent
from quillspark.operators.components import connected_components
from quillspark.operators.quality import primary_evidence
from quillspark.session import block_join, cut, lookup, stored

# Kinds of venue that can't be the same publication as each other (alphabetical).
BOOKS = ("book", "book-chapter", "book-set", "book_chapter", "book_set", "chapter", "edited-book", "edited_book", "monograph", "reference-book", "reference-entry", "reference_book", "reference_entry")
PERIODICALS = ("article", "conference", "conference-paper", "conference-proceedings", "conference_paper", "conference_proceedings", "journal", "journal-article", "journal_article", "proceedings", "proceedings-article", "proceedings_article", "review")
SEQUENCE, GUARD, FUZZY = 0.92, 0.75, 0.85
RANKED = 20_000
ID_FIELDS = ("doi", "arxiv", "pmid", "url", "id")


def match_features(papers: DataFrame) -> DataFrame:
    """The normalised fields that the match rules compare; one row per paper."""
    return papers.select(
        "ord", F.nullif(F.lower("doi"), F.lit("")).alias("doi"), strict_arxiv(F.col("arxiv_id")).alias("arxiv"), F.nullif(F.trim("pmid"), F.lit("")).alias("pmid"), F.nullif(F.lower(F.regexp_replace("url", "/+$", "")), F.lit("")).alias("url"), F.nullif("id", F.lit("")).alias("id"),
        title_key(F.col("title")).alias("title"), tokens(title_key(F.col("title"))).alias("words"), F.array_distinct(F.transform(F.coalesce("authors", F.array()), lambda a: title_key(a["name"]))).alias("names"), "year", F.lower(F.trim("venue_type")).alias("kind"),
    )


def id_edges(features: DataFrame) -> DataFrame:
    """Edges ``a, b`` (ord) from each paper to the first paper with the same identifier: a star for each value, not all pairs."""
    ids = features.select("ord", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in ID_FIELDS])).alias("i")).where("i.v IS NOT NULL AND i.v <> ''")
    firsts = ids.groupBy("i").agg(F.min("ord").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = lookup(ids.withColumn("k", F.xxhash64("i")), firsts.withColumn("k", F.xxhash64("i")).withColumnRenamed("i", "same"), "k", "inner")
    return met.where("i = same").select(F.col("ord").alias("a"), "b")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts, vectorised; the first argument is the first operand."""

    def call(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, s, t).ratio() if s is not None and t is not None else None for s, t in zip(x, y, strict=True)], dtype="float64")

    call.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, "double")(a, b)


def similar_titles(titles: DataFrame, share: float = GUARD) -> DataFrame:
    """Pairs ``t1, t2`` (t1 < t2) of distinct titles (columns title, words) with a Jaccard similarity of ``share`` or more.

    Prefix filtering by two words: words are ordered by rarity over all titles; two sets that similar have ceil(share*n) words or
    more in common, the first two of which lie among the first n - ceil(share*n) + 2 words of either. Titles meet by such pairs of
    words, so no pair is lost, and common words make no block (sets of one word meet by it). Of those that meet, the words
    left after the place of the second one and the bits of maps of the words that only one side has bound what they can have in
    common; the words themselves are compared once for each pair that is left.
    """
    if not 0.5 < share <= 1:
        raise ValueError("titles are compared from more than half of their words on")
    words = titles.select(F.xxhash64("title").alias("t"), F.explode("words").alias("w")).select("t", F.xxhash64("w").alias("w"))
    # Words of more than one title in RANKED are ranked by a table of a few hundred thousand rows at most, which is broadcast;
    # the others count as equally rare. Any order that is the same on both sides loses no pair.
    floor = max(1, titles.count() // RANKED)
    ranks = words.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > floor)
    ordered = words.join(F.broadcast(ranks), "w", "left").groupBy("t").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(floor)).alias("df"), "w"))).alias("ws"))
    n = F.size("ws")
    half = lambda k: F.aggregate("ws", F.lit(0).cast("long"), lambda m, x: F.when(F.pmod(x["w"], F.lit(2)) == k, m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x["w"], 1), F.lit(64)).cast("int")))).otherwise(m))
    first = F.transform(F.slice("ws", F.lit(1), (n - F.greatest(F.ceil(n * F.lit(share) - F.lit(1e-9)), F.lit(2)) + 2).cast("int")), lambda x: x["w"])
    kept = stored(ordered.select("t", n.alias("n"), half(0).alias("even"), half(1).alias("odd"), first.alias("first")))
    two = F.flatten(F.transform("first", lambda x, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda y, j: F.struct(F.xxhash64(x, y).alias("k"), (i + j + 2).alias("p")))))
    keys = F.when(F.size("first") > 1, two).otherwise(F.array(F.struct(F.element_at("first", 1).alias("k"), F.lit(1).alias("p"))))
    heads = kept.select("t", F.col("n").cast("short").alias("n"), "even", "odd", F.explode(keys).alias("e")).select("t", "n", "even", "odd", "e.k", F.col("e.p").cast("short").alias("p"))
    other = heads.toDF("u", "m", "even2", "odd2", "k", "q")
    both = F.col("n") + F.col("m")
    common = F.ceil(both * F.lit(share / (1 + share)) - F.lit(1e-9))
    only = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    bounds = (F.least("n", "m") >= F.greatest("n", "m") * share - 1e-9) & (F.least("n", "m") >= common) & (F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) + 2 >= common)
    bounds = bounds & (only("even", "even2") + only("odd", "odd2") <= F.col("n") - common) & (only("even2", "even") + only("odd2", "odd") <= F.col("m") - common)
    met = block_join(heads, other, "k", "t").where((F.col("t") < F.col("u")) & bounds).select("t", "u").distinct()
    text = titles.select(F.xxhash64("title").alias("t"), "title", "words")
    pairs = met.join(text.toDF("t", "ta", "wa"), "t").join(text.toDF("u", "tb", "wb"), "u")
    return pairs.where(jaccard(F.col("wa"), F.col("wb")) >= share).select(F.least("ta", "tb").alias("t1"), F.greatest("ta", "tb").alias("t2"))


def crossing_titles(titles: DataFrame, share: float = SEQUENCE) -> DataFrame:
    """Pairs ``t1, t2`` (t1 < t2) of distinct titles (columns title, arxiv, doi: whether a record of it bears one) with a
    sequence ratio of ``share`` or more, one with an arXiv id and the other with a DOI; words in common are not needed.

    Prefix filtering on character trigrams with their places: a ratio of r means at least M = r(n+m)/2 equal characters in
    order, so n-M characters are dropped and m-M put in, and a dropped one destroys three trigrams, an inserted one two.
    More trigrams than that in the order of rarity hold one that is kept, at a place shifted by no more than was dropped
    or put in. The same count for bigrams bounds the bits of their maps that only one title has, and the edit distance the
    ratio before it is computed. Below six characters only equal titles reach .92.
    """
    half, q = share / 2, 3
    lost = lambda n, m, q=q: F.floor(q * F.col(n) + (q - 1) * F.col(m) - (2 * q - 1) * half * (F.col(n) + F.col(m)) + 1e-9)
    least = half / (1 - half)
    at = F.transform(F.sequence(F.lit(1), F.length("title") - q + 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("title"), i, F.lit(q)).alias("g")))
    grams = titles.where((F.col("arxiv") | F.col("doi")) & (F.length("title") >= 6)).select("title", "arxiv", "doi", F.explode(at).alias("e")).select("title", "arxiv", "doi", "e.i", "e.g")
    meets = grams.groupBy("g").agg((F.sum(F.col("arxiv").cast("long")) * F.sum(F.col("doi").cast("long"))).alias("df"))
    ordered = grams.join(meets, "g").groupBy("title", "arxiv", "doi").agg(F.array_sort(F.collect_list(F.struct("df", "g", "i"))).alias("gs"))
    n = F.length("title")
    heads = ordered.select(F.xxhash64("title").alias("t"), "arxiv", "doi", n.alias("n"), F.posexplode(F.slice("gs", F.lit(1), (F.floor(n * (q * (1 - least)) + 1e-9) + 1).cast("int"))).alias("r", "h"))
    bits = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.pmod(F.xxhash64(F.substring(F.col("title"), i, F.lit(2))), F.lit(256)))
    word = lambda k: F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: F.when(F.floor(b / 64) == k, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int")))).otherwise(a))
    maps = ordered.select(F.xxhash64("title").alias("t"), bits.alias("bits")).select("t", F.struct(*[word(k).alias(f"w{k}") for k in range(4)]).alias("map"))
    heads = cut(heads.where("h.df > 0").select("t", "arxiv", "doi", "n", "r", "h.g", "h.i").join(maps, "t"))
    x = heads.where("arxiv").select(F.col("t").alias("tx"), "n", "r", "i", "g", F.col("map").alias("u"))
    y = heads.where("doi").select(F.col("t").alias("ty"), F.col("n").alias("m"), F.col("r").alias("s"), F.col("i").alias("j"), "g", F.col("map").alias("v"))
    only = lambda a, b: sum(F.bit_count(F.col(f"{a}.w{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}.w{k}")))) for k in range(4))
    longer = F.greatest("n", "m")
    met = x.join(y, "g").where((F.col("tx") != F.col("ty")) & (F.least("n", "m") >= longer * least - 1e-9) & (F.abs(F.col("i") - F.col("j")) <= longer - half * (F.col("n") + F.col("m")) + 1e-9) & (F.col("r") <= lost("n", "m")) & (F.col("s") <= lost("m", "n")) & (only("u", "v") <= lost("n", "m", 2)) & (only("v", "u") <= lost("m", "n", 2)))
    text = titles.select(F.xxhash64("title").alias("t"), "title")
    pairs = met.select(F.least("tx", "ty").alias("a"), F.greatest("tx", "ty").alias("b")).distinct().join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b")
    pairs = pairs.select(F.least("ta", "tb").alias("t1"), F.greatest("ta", "tb").alias("t2"))
    close = F.levenshtein("t1", "t2") <= F.floor((1 - share) * (F.length("t1") + F.length("t2")) + 1e-9)
    return cut(pairs.where(close)).where(sequence_ratio(F.col("t1"), F.col("t2")) >= share)


def matches(x: str = "x", y: str = "y") -> Column:
    """The title rules for a pair without a shared identifier: no conflicting identifiers, years or kinds of venue, and
    either nearly equal titles or a weighted score of title, names and year of .85 or more. An arXiv-only and a
    DOI-only record match on nearly equal titles whatever else differs.
    """
    c = lambda s, f: F.col(f"{s}.{f}")
    ratio = sequence_ratio(c(x, "title"), c(y, "title"))
    both = lambda f: c(x, f).isNotNull() & c(y, f).isNotNull()
    conflict = F.lit(False)
    for f in ("doi", "pmid", "arxiv"):
        conflict = conflict | (both(f) & (c(x, f) != c(y, f)))
    cross = (c(x, "arxiv").isNotNull() & c(y, "doi").isNotNull()) | (c(x, "doi").isNotNull() & c(y, "arxiv").isNotNull())
    gap = F.coalesce(F.abs(c(x, "year") - c(y, "year")), F.lit(0))
    kinds = F.coalesce((c(x, "kind").isin(*BOOKS) & c(y, "kind").isin(*PERIODICALS)) | (c(x, "kind").isin(*PERIODICALS) & c(y, "kind").isin(*BOOKS)), F.lit(False))
    title, names = jaccard(c(x, "words"), c(y, "words")), jaccard(c(x, "names"), c(y, "names"))
    no_names = (F.size(c(x, "names")) == 0) & (F.size(c(y, "names")) == 0)
    score = F.lit(0.6) * title + F.lit(0.25) * F.when(no_names, 0.5).otherwise(names) + F.lit(0.15) * F.when(gap > 1, 0.0).when(gap == 1, 0.8).otherwise(1.0)
    near = (title >= GUARD) & (ratio >= SEQUENCE)
    return (cross & (ratio >= SEQUENCE)) | (~conflict & (gap <= 1) & ~kinds & ((score >= FUZZY) | near))


def _crossing(a: str, b: str) -> Column:
    """Whether one of two states has an arXiv id and the other a DOI."""
    has = lambda s, bit: F.col(f"{s}.mask").bitwiseAND(bit) > 0
    return (has(a, 2) & has(b, 1)) | (has(a, 1) & has(b, 2))


def _compatible(a: str, b: str) -> Column:
    """Whether records of two states with nearly equal titles match: disjoint kinds of identifier, close years and kinds of
    venue that go together; an arXiv id against a DOI settles it alone. Equal identifiers are linked elsewhere."""
    c = lambda s, f: F.col(f"{s}.{f}")
    apart = c(a, "mask").bitwiseAND(c(b, "mask")) == 0
    close = F.coalesce(F.abs(c(a, "year") - c(b, "year")) <= 1, F.lit(True))
    kinds = ~F.concat(c(a, "kind"), c(b, "kind")).isin("bp", "pb")
    return _crossing(a, b) | (apart & close & kinds)


def dedup_clusters(papers: DataFrame) -> DataFrame:
    """``ord, cluster`` (smallest ord) of every paper under the match rules, closed transitively.

    Nearly equal titles match whatever their bylines, so their records are compared as states (title, kinds of identifier,
    year, kind of venue): a handful a title, however many records it has, and records hang on their state like spokes. Only
    titles that are similar without being nearly equal are compared record by record, after equal records were combined.
    Identifiers link each record to the first one with the same value. Titles are compared from the guard similarity on, and
    those of an arXiv id against a DOI from the sequence ratio alone. Null titles match by identifier only; every paper comes out.
    """
    features = cut(match_features(papers).dropDuplicates(["ord"]))
    given = lambda f, bit: F.when(F.col(f).isNotNull(), bit).otherwise(0)
    kind = F.when(F.col("kind").isin(*BOOKS), "b").when(F.col("kind").isin(*PERIODICALS), "p").otherwise("")
    stated = features.where("title IS NOT NULL").select("ord", "title", F.struct((given("doi", 1) + given("arxiv", 2) + given("pmid", 4)).alias("mask"), "year", kind.alias("kind")).alias("s"))
    stated = stated.withColumn("node", F.xxhash64(F.lit("state"), "title", "s.mask", F.coalesce("s.year", F.lit(-(1 << 31))), "s.kind"))
    states = cut(stated.select("title", "s", "node").distinct())
    titles = features.where(F.size("words") > 0).groupBy("title").agg(F.first("words").alias("words"))
    pairs = cut(similar_titles(titles).withColumn("ratio", sequence_ratio(F.col("t1"), F.col("t2"))))
    near = pairs.where(F.col("ratio") >= SEQUENCE).select("t1", "t2")
    left = states.select(F.col("title").alias("t1"), F.col("s").alias("x"), F.col("node").alias("a"))
    right = states.select(F.col("title").alias("t2"), F.col("s").alias("y"), F.col("node").alias("b"))
    same = left.join(right, F.col("t1") == F.col("t2")).where("a <= b")
    bears = lambda bit, name: F.max(F.col("s.mask").bitwiseAND(bit) > 0).alias(name)
    crossing = crossing_titles(states.groupBy("title").agg(bears(2, "arxiv"), bears(1, "doi")))
    crossed = crossing.join(left, "t1").join(right, "t2").where(_crossing("x", "y"))
    links = same.unionByName(near.join(left, "t1").join(right, "t2").select(*same.columns)).where(_compatible("x", "y")).select("a", "b")
    links = cut(links.unionByName(crossed.select("a", "b")).distinct())
    spokes = stated.join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    mark = lambda c: F.xxhash64(F.lit("paper"), c)

    alike = features.withColumn("k", F.xxhash64(*[c for c in features.columns if c not in ("ord", "url", "id")]))
    firsts = alike.groupBy("k").agg(F.min("ord").alias("b"))
    one = features.join(firsts.select(F.col("b").alias("ord")), "ord")
    far = pairs.where(F.col("ratio") < SEQUENCE).select("t1", "t2")
    x = one.select(F.col("title").alias("t1"), F.struct(*one.columns).alias("x"))
    y = one.select(F.col("title").alias("t2"), F.struct(*one.columns).alias("y"))
    fuzzy = far.join(x, "t1").join(y, "t2").where(matches())
    # A record equal to x in all compared fields matches whatever x matches; both sides hang on a node of their own.
    twin = lambda s: F.xxhash64(F.lit("twin"), *[F.col(f"{s}.{c}") for c in one.columns if c not in ("ord", "url", "id")])
    fuzzy_edges = cut(fuzzy.select(twin("x").alias("a"), twin("y").alias("b")).distinct())
    twins = features.withColumn("t", F.xxhash64(F.lit("twin"), *[c for c in features.columns if c not in ("ord", "url", "id")]))
    hung = twins.join(fuzzy_edges.select(F.explode(F.array("a", "b")).alias("t")).distinct(), "t").select(mark("ord").alias("a"), F.col("t").alias("b"))
    edges = (
        id_edges(features).select(mark("a").alias("a"), mark("b").alias("b"))
        .unionByName(links).unionByName(spokes.select(mark("ord").alias("a"), F.col("node").alias("b")))
    )
    edges = edges.unionByName(fuzzy_edges).unionByName(hung)
    found = connected_components(edges)
    placed = papers.select("ord").withColumn("vertex", mark("ord")).join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    least = placed.groupBy("component").agg(F.min("ord").alias("cluster"))
    return placed.join(least, "component").select("ord", "cluster")


def fuse(records: DataFrame, cluster: str) -> DataFrame:
    """One record a cluster: strings are the first non-empty and numbers the first non-null in the order of confidence
    (then ord), citations the largest; keywords and fields of study are united, first spelling wins (sorted by their key).

    Confidence is that of the primary evidence, 0 without any. Rows with a null cluster are left out. All picks are
    map-side combined aggregates, so the size of a cluster doesn't matter.
    """
    conf = F.coalesce(primary_evidence("evidence_list")["confidence"], F.lit(0.0))
    rank = F.struct((-conf).alias("c"), F.col("ord").alias("o"))
    rows = records.where(F.col(cluster).isNotNull()).withColumn("_rank", rank)

    def first(c: str, given: Column) -> Column:
        return F.min_by(F.when(given, F.col(c)), F.when(given, F.col("_rank"))).alias(c)

    texts = [first(c, F.coalesce(F.col(c) != "", F.lit(False))) for c in ("id", "venue", "venue_type", "abstract", "doi", "arxiv_id", "pmid", "url", "pdf_url")]
    numbers = [first(c, F.col(c).isNotNull()) for c in ("year", "reference_count")]
    return rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_records"), F.min_by("title", "_rank").alias("title"), *texts, *numbers, F.max("citations").alias("citations"))


def united_lists(records: DataFrame, cluster: str, column: str) -> DataFrame:
    """``cluster, key, value``: the values of an array column over a cluster; the spelling of the most trusted record is kept."""
    conf = F.coalesce(primary_evidence("evidence_list")["confidence"], F.lit(0.0))
    each = records.where(F.col(cluster).isNotNull()).select(cluster, (-conf).alias("c"), "ord", F.posexplode(column).alias("at", "value"))
    return each.groupBy(cluster, F.lower("value").alias("key")).agg(F.min_by("value", F.struct("c", "ord", "at")).alias("value"))


def field_conflicts(records: DataFrame, cluster: str) -> DataFrame:
    """``cluster, ord, field`` where a record disagrees with the most trusted one of its cluster (year by more than one,
    venue not equivalent, title key different)."""
    conf = F.coalesce(primary_evidence("evidence_list")["confidence"], F.lit(0.0))
    rows = records.where(F.col(cluster).isNotNull()).select(cluster, "ord", "year", "venue", "title", F.struct((-conf).alias("c"), F.col("ord").alias("o")).alias("r"))
    base = rows.groupBy(cluster).agg(F.min_by(F.struct("ord", "year", "venue", "title"), "r").alias("w"))
    pairs = rows.join(base, cluster).where("ord <> w.ord")
    tests = F.array_compact(F.array(
        F.when(F.abs(F.col("year") - F.col("w.year")) > 1, "year"),
        F.when((F.col("venue") != "") & (F.col("w.venue") != "") & ~venues_equivalent(F.col("w.venue"), F.col("venue")), "venue"),
        F.when(title_key(F.col("title")) != title_key(F.col("w.title")), "title"),
    ))
    return pairs.select(cluster, "ord", F.explode(tests).alias("field"))
