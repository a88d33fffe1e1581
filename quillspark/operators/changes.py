"""Change detection between a stored and a new collection, and pairs of authors that may be one person."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import ascii_cjk_key, content_hash, folded, jaccard, title_key, tokens
from quillspark.session import block_join, cut, lookup

TRACKED = ("title", "year", "venue", "abstract", "doi", "url", "pdf_url", "citations")
WEIGHTS = (0.35, 0.25, 0.15, 0.10, 0.075, 0.075)
SAME, AMBIGUOUS = 0.85, 0.60
# Words that say nothing about which organisation is meant (alphabetical).
GENERIC = ("and", "at", "center", "centre", "college", "department", "dept", "faculty", "institute", "institutes", "lab", "laboratory", "of", "research", "school", "the", "universities", "university")


def changed_lists(old: str, new: str) -> Column:
    """Which of keywords and bylines differ, case and blanks at the ends aside, in order; null equals an empty list."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    names = lambda s: F.transform(F.col(f"{s}.authors"), lambda a: a["name"])
    return F.array_compact(F.array(F.when(low(F.col(f"{old}.keywords")) != low(F.col(f"{new}.keywords")), "keywords"), F.when(low(names(old)) != low(names(new)), "authors")))


def changed_fields(old: str, new: str, kinds: dict[str, str]) -> Column:
    """Names of the tracked fields that differ; texts are compared trimmed, null equals null only."""
    def side(s: str, c: str) -> Column:
        return F.trim(F.col(f"{s}.{c}")) if kinds[c] == "string" else F.col(f"{s}.{c}")

    return F.array_compact(F.array(*[F.when(~side(old, c).eqNullSafe(side(new, c)), c) for c in TRACKED]))


def detect_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """``ord, change, old_ord, changed`` for each new record: new, updated or unchanged against the stored ones.

    Records match by id, then DOI (case aside), then link, then, where both sides hold authors, by the content hash of
    title, byline, year and venue (none without a title); of several stored rows with a key the last counts. Keys are
    reduced to one row before the joins. Rows without any key are new. A stored record may match several new ones.
    """
    kinds = dict(old.dtypes)
    whole = F.struct("ord", *TRACKED)
    keys = {"id": lambda: F.nullif("id", F.lit("")), "doi": lambda: F.nullif(F.lower("doi"), F.lit("")), "url": lambda: F.nullif(F.lower(F.regexp_replace("url", "/+$", "")), F.lit(""))}
    if "authors" in new.columns and "authors" in old.columns:
        keys["hash"] = lambda: F.when(F.col("title").isNotNull(), content_hash(F.col("title"), F.transform("authors", lambda a: a["name"]), F.col("year"), F.col("venue")))
    rows = new.select("ord", whole.alias("n"), *[k().alias(f"_{name}") for name, k in keys.items()])
    for name, k in keys.items():
        side = old.select(k().alias(f"_{name}"), whole.alias("o")).where(f"_{name} IS NOT NULL").groupBy(f"_{name}").agg(F.max_by("o", F.col("o.ord")).alias(f"o_{name}"))
        rows = rows.join(side, f"_{name}", "left")
    rows = rows.withColumn("o", F.coalesce(*[F.col(f"o_{name}") for name in keys]))
    changed = changed_fields("o", "n", kinds)
    change = F.when(F.col("o").isNull(), "new").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    return rows.select("ord", change.alias("change"), F.col("o.ord").alias("old_ord"), F.when(F.col("o").isNotNull(), F.array_join(changed, ",")).alias("changed"))


def stale(requested: DataFrame, synced: DataFrame, now: Column, days: int) -> DataFrame:
    """``entity, stale``: whether any requested (entity, source) was never synchronised or longer ago than ``days``."""
    last = synced.groupBy("entity", "source").agg(F.max("at").alias("at"))
    old = F.col("at").isNull() | (F.col("at") < now - F.make_dt_interval(F.lit(days))) | F.lit(days <= 0)
    return requested.select("entity", "source").distinct().join(last, ["entity", "source"], "left").groupBy("entity").agg(F.max(old).alias("stale"))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal keys or the same tokens in another order, else the sequence ratio, +.15 with equal surnames."""

    def call(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y, strict=True):
            p, q = s.split(), t.split()
            if not s and not t:
                out.append(0.5)
            elif s == t or (set(p) == set(q) and p):
                out.append(1.0)
            else:
                r = SequenceMatcher(None, s, t).ratio()
                out.append(min(1.0, r + 0.15) if p and q and p[-1] == q[-1] else r)
        return pd.Series(out, dtype="float64")

    call.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, "double")(ascii_cjk_key(F.coalesce(a, F.lit(""))), ascii_cjk_key(F.coalesce(b, F.lit(""))))


def _sets(a: Column, b: Column) -> Column:
    """Jaccard with the neutral .5 where both are empty and 0 where one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.5).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard(a, b))


def author_features(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds affiliation, topic, coauthor, year and venue overlap of two author structs."""
    c = lambda s, f: F.col(f"{s}.{f}")
    keys = lambda col: F.array_distinct(F.transform(F.coalesce(col, F.array().cast("array<string>")), ascii_cjk_key))
    words = lambda col: tokens(ascii_cjk_key(F.coalesce(col, F.lit(""))))
    x, y = c(a, "affiliation"), c(b, "affiliation")
    nx, ny = ascii_cjk_key(x), ascii_cjk_key(y)
    generic = F.array(*map(F.lit, GENERIC))
    gx, gy = F.array_except(words(x), generic), F.array_except(words(y), generic)
    none_x, none_y = F.coalesce(x == "", F.lit(True)), F.coalesce(y == "", F.lit(True))
    affiliation = F.when(none_x & none_y, 0.5).when(none_x | none_y, 0.0).when(nx == ny, 1.0).when(nx.contains(ny) | ny.contains(nx), 0.9).otherwise(jaccard(gx, gy))
    topic = _sets(words(F.array_join(c(a, "interests"), " ")), words(F.array_join(c(b, "interests"), " ")))
    ya, yb = F.coalesce(c(a, "active_years"), F.array().cast("array<int>")), F.coalesce(c(b, "active_years"), F.array().cast("array<int>"))
    inter = F.greatest(F.lit(0), F.least(F.array_max(ya), F.array_max(yb)) - F.greatest(F.array_min(ya), F.array_min(yb)) + 1)
    span = F.greatest(F.array_max(ya), F.array_max(yb)) - F.least(F.array_min(ya), F.array_min(yb)) + 1
    years = F.when((F.size(ya) == 0) & (F.size(yb) == 0), 0.5).when((F.size(ya) == 0) | (F.size(yb) == 0), 0.0).otherwise(inter.cast("double") / span.cast("double"))
    return pairs.withColumns({"affiliation": affiliation, "topic": topic, "coauthor": _sets(keys(c(a, "coauthors")), keys(c(b, "coauthors"))), "years": years, "venue": _sets(keys(c(a, "venues")), keys(c(b, "venues")))})


def ids_linked(a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """Whether two author structs share an authority id, and whether they have different ones of the same kind."""
    ids = ("orcid", "semantic_scholar_id", "openalex_id")
    linked = conflict = F.lit(False)
    for i in ids:
        linked = linked | F.coalesce(F.col(f"{a}.{i}") == F.col(f"{b}.{i}"), F.lit(False))
        conflict = conflict | F.coalesce(F.col(f"{a}.{i}") != F.col(f"{b}.{i}"), F.lit(False))
    return linked, conflict


COMPARED = ("name", "affiliation", "interests", "coauthors", "active_years", "venues", "orcid", "semantic_scholar_id", "openalex_id")


def author_key() -> Column:
    """128 bits of hash of the fields that pairs of authors are compared in: rows with the same are one."""
    each = [F.to_json(F.struct(*COMPARED))]
    return F.struct(F.xxhash64(F.lit(1), *each).alias("h"), F.xxhash64(F.lit(2), *each).alias("g"))


def author_pairs(authors: DataFrame) -> DataFrame:
    """Pairs ``a, b`` (structs, a.ord < b.ord) of authors with a common authority id, the same words in their names, or the same
    surname and given initial, whichever word comes first; accents don't count.

    Rows that say the same in all compared fields are paired through their first one only (:func:`author_key` tells which those
    are). Large blocks are split among tasks.
    """
    one = authors.groupBy(author_key().alias("_k")).agg(F.min_by(F.struct("ord", *COMPARED), "ord").alias("a")).select("a")
    words = F.filter(F.split(title_key(folded(F.coalesce("a.name", F.lit("")))), " "), lambda t: t != "")
    keyed = one.withColumn("_w", words).withColumn("_n", F.size("_w"))
    ends = F.when(F.col("_n") > 1, F.array(F.concat(F.lit("n:"), F.element_at("_w", -1), F.lit("|"), F.substring(F.element_at("_w", 1), 1, 1)), F.concat(F.lit("n:"), F.element_at("_w", 1), F.lit("|"), F.substring(F.element_at("_w", -1), 1, 1)))).otherwise(F.array().cast("array<string>"))
    blocks = F.concat(ends, F.array(F.concat(F.lit("w:"), F.array_join(F.array_sort(F.array_distinct("_w")), " ")), *[F.concat(F.lit(f"{i}:"), F.col(f"a.{i}")) for i in ("orcid", "semantic_scholar_id", "openalex_id")]))
    keys = cut(keyed.select(F.col("a.ord").alias("x"), F.explode(F.array_distinct(F.array_compact(blocks))).alias("_b")))
    met = block_join(keys, keys.withColumnRenamed("x", "y"), "_b", "x").where("x < y").select("x", "y").distinct()
    return met.join(one.select(F.col("a.ord").alias("x"), "a"), "x").join(one.select(F.col("a.ord").alias("y"), F.col("a").alias("b")), "y").select("a", "b")


def author_members(authors: DataFrame) -> DataFrame:
    """``ord, representative``: the first of the rows that agree in all compared fields, through which :func:`author_pairs` pairs a row."""
    keyed = authors.select("ord", author_key().alias("k"))
    return lookup(keyed, keyed.groupBy("k").agg(F.min("ord").alias("representative")), "k", "inner").select("ord", "representative")


def author_scores(pairs: DataFrame, least: float | None = None) -> DataFrame:
    """``a_ord, b_ord, total, verdict``: weighted score of all features; ids decide before it (conflict 0, link 1).

    With ``least``, pairs that score less may be missing: those that equal names couldn't bring there aren't compared by name.
    """
    linked, conflict = ids_linked()
    rows = author_features(pairs)
    weights = dict(zip(("name", "affiliation", "topic", "coauthor", "years", "venue"), WEIGHTS, strict=True))
    if least is not None:
        most = F.lit(weights["name"] + 0.05)
        for f in ("affiliation", "topic", "coauthor", "years", "venue"):
            most = most + F.lit(weights[f]) * F.col(f)
        rows = rows.where(~conflict & (linked | (most >= least - 1e-6)))
    rows = rows.withColumn("name", name_similarity(F.col("a.name"), F.col("b.name")))
    total = None
    for f, w in weights.items():
        total = F.lit(w) * F.col(f) if total is None else total + F.lit(w) * F.col(f)
    bonus = (F.col("name") == 1.0) & (F.col("affiliation") >= 0.9) & (F.col("topic") >= 0.5)
    total = F.when(bonus, F.least(F.lit(1.0), total + 0.05)).otherwise(total)
    total = F.when(conflict, 0.0).when(linked, 1.0).otherwise(total)
    verdict = F.when(F.col("total") >= SAME, "same").when(F.col("total") >= AMBIGUOUS, "ambiguous").otherwise("different")
    return rows.select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), F.round(total, 9).alias("total")).withColumn("verdict", verdict)
