"""Incremental refresh: new records matched with stored ones in five tiers, each stored one once; merged and applied."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import content_hash, jaccard, title_key, tokens
from quillspark.operators.changes import TRACKED, changed_fields
from quillspark.operators.components import connected_components
from quillspark.operators.fusion import similar_titles
from quillspark.operators.quality import primary_evidence
from quillspark.operators.upserts import last_wins, upsert
from quillspark.session import cut, lookup

TITLE_SHARE, NEAR_SHARE, ENOUGH, MARGIN = 0.80, 0.95, 0.85, 0.10


def _keys() -> dict[str, Column]:
    names = F.transform(F.coalesce("authors", F.array()), lambda a: a["name"])
    return {
        "id": F.nullif("id", F.lit("")), "doi": F.nullif(F.lower("doi"), F.lit("")), "url": F.nullif(F.lower(F.regexp_replace("url", "/+$", "")), F.lit("")),
        "hash": content_hash(F.col("title"), names, F.col("year"), F.col("venue")),
    }


def _owner() -> Column:
    """What a stored record is known by once it is taken: its id, else its row."""
    return F.coalesce(F.concat(F.lit("id:"), F.nullif("id", F.lit(""))), F.concat(F.lit("row:"), F.col("ord").cast("string")))


def keyed_choices(new: DataFrame, old: DataFrame) -> DataFrame:
    """``n, o, owner, rank``: for each new record the stored one with its id, DOI, link and content hash (the last of several), in this order."""
    keys = [key.alias(f"_{name}") for name, key in _keys().items()]
    asked, known = cut(new.select("ord", *keys)), cut(old.select("ord", _owner().alias("owner"), *keys))
    out = None
    for i, name in enumerate(_keys()):
        side = known.select(F.col(f"_{name}").alias("_k"), F.struct("ord", "owner").alias("_o")).where("_k IS NOT NULL").groupBy("_k").agg(F.max_by("_o", F.col("_o.ord")).alias("_o"))
        met = lookup(asked.select("ord", F.col(f"_{name}").alias("_k")), side, "_k", "inner").select(F.col("ord").alias("n"), F.col("_o.ord").alias("o"), F.col("_o.owner").alias("owner"), F.struct(F.lit(i).alias("tier"), F.lit(0.0).alias("less")).alias("rank"))
        out = met if out is None else out.unionByName(met)
    return out


def similar_choices(new: DataFrame, old: DataFrame) -> DataFrame:
    """The fuzzy tier: stored records with a word Jaccard of titles of .80 or more, years at most one apart and a weighted score of title and
    names of .85 or more, best first. Titles are compared once however many records have them."""
    names = F.array_distinct(F.transform(F.coalesce("authors", F.array()), lambda a: title_key(a["name"])))
    side = lambda d: d.select("ord", title_key(F.col("title")).alias("title"), tokens(title_key(F.col("title"))).alias("words"), names.alias("names"), "year", _owner().alias("owner"))
    a, b = cut(side(new)), cut(side(old))
    titles = cut(a.select("title", "words").unionByName(b.select("title", "words")).where(F.size("words") > 0).groupBy("title").agg(F.first("words").alias("words")))
    near = similar_titles(titles, TITLE_SHARE)
    pairs = near.unionByName(near.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"))).unionByName(titles.select(F.col("title").alias("t1"), F.col("title").alias("t2")))
    met = pairs.join(a.select(F.col("title").alias("t1"), F.struct("*").alias("x")), "t1").join(b.select(F.col("title").alias("t2"), F.struct("*").alias("y")), "t2")
    share = jaccard(F.col("x.words"), F.col("y.words"))
    none = (F.size("x.names") == 0) & (F.size("y.names") == 0)
    people = F.when(none, 0.5).otherwise(jaccard(F.col("x.names"), F.col("y.names")))
    score = F.when(share >= NEAR_SHARE, F.lit(0.9) * share + F.lit(0.1) * people).otherwise(F.lit(0.7) * share + F.lit(0.3) * people)
    close = F.coalesce(F.abs(F.col("x.year") - F.col("y.year")) <= 1, F.lit(True))
    return met.where(close).withColumn("score", score).where(F.col("score") >= ENOUGH).select(F.col("x.ord").alias("n"), F.col("y.ord").alias("o"), F.col("y.owner").alias("owner"), F.struct(F.lit(4).alias("tier"), (-F.col("score")).alias("less")).alias("rank"))


def assigned(choices: DataFrame) -> DataFrame:
    """``n, o``: each new record takes, in the order of ``n``, the first of its choices (by rank, then o) whose owner nobody before it took.

    Records compete only within a connected component of records and owners. Components are spread over the tasks and each is gone through once
    in that order, so any number of records may want the same owners; what is kept in memory are the owners taken in one component.
    """
    kept = cut(choices.groupBy("n", "owner").agg(F.min(F.struct("rank", "o")).alias("c")))
    node = lambda c: F.xxhash64(F.lit(c), c)  # noqa: E731 - equal hashes only make a component larger
    found = connected_components(kept.select(node("n").alias("a"), node("owner").alias("b")))
    rows = kept.withColumn("vertex", node("n")).join(found, "vertex").select("component", "n", "c.rank.tier", "c.rank.less", "c.o", "owner")
    ordered = rows.repartition("component").sortWithinPartitions("component", "n", "tier", "less", "o", "owner").select("component", "n", "o", "owner")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, inside, placed = set(), None, None
        for batch in batches:
            out = []
            for component, n, o, owner in zip(batch["component"].tolist(), batch["n"].tolist(), batch["o"].tolist(), batch["owner"].tolist(), strict=True):
                if component != inside:
                    taken, inside, placed = set(), component, None
                if n != placed and owner not in taken:
                    taken.add(owner)
                    placed = n
                    out.append((n, o))
            yield pd.DataFrame(out, columns=["n", "o"]).astype({"n": "int64", "o": "int64"})

    kinds = dict(rows.dtypes)
    return ordered.mapInPandas(take, f"n {kinds['n']}, o {kinds['o']}")


def detect(new: DataFrame, old: DataFrame) -> DataFrame:
    """``ord, change, old_ord, changed``: new, updated or unchanged, matched by id, DOI, link, content hash, then fuzzy title; a
    stored record answers one new one, the earliest. Rows need ord, id, doi, url, title, authors, year, venue and the tracked fields."""
    # All choices are found beforehand: a record takes a similar title only if its keys are all taken, which shows when records are gone through
    # in order, and one record that does may displace any number of others.
    found = assigned(keyed_choices(new, old).unionByName(similar_choices(new, old)))
    kinds = dict(old.dtypes)
    whole = lambda d, name: d.select(F.col("ord").alias(f"{name}_ord"), F.struct(*TRACKED).alias(name))
    rows = whole(new, "n").join(found.toDF("n_ord", "o_ord"), "n_ord", "left").join(whole(old, "o"), "o_ord", "left")
    changed = changed_fields("o", "n", kinds)
    change = F.when(F.col("o").isNull(), "new").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    return rows.select(F.col("n_ord").alias("ord"), change.alias("change"), F.col("o_ord").alias("old_ord"), F.when(F.col("o").isNotNull(), F.array_join(changed, ",")).alias("changed"))


def merged(pairs: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """One record for each pair ``ord, old_ord``: the new state wins field by field unless it is trusted less by more than the margin; citations are
    the larger, keywords united (case aside), the stored id stays."""
    fields = ["title", "year", "venue", "abstract", "doi", "url", "pdf_url"]
    conf = F.coalesce(primary_evidence("evidence_list")["confidence"], F.lit(0.0))
    side = lambda d, k, name: d.select(F.col("ord").alias(k), F.struct("id", *fields, "citations", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), conf.alias("conf")).alias(name))
    rows = pairs.select("ord", "old_ord").join(side(new, "ord", "n"), "ord").join(side(old, "old_ord", "o"), "old_ord")
    fresh = F.col("n.conf") >= F.col("o.conf") - MARGIN
    rows = rows.withColumn("p", F.when(fresh, F.struct("n.*")).otherwise(F.struct("o.*"))).withColumn("s", F.when(fresh, F.struct("o.*")).otherwise(F.struct("n.*")))
    kinds = dict(new.dtypes)
    pick = lambda f: F.coalesce(F.nullif(F.col(f"p.{f}"), F.lit("")) if kinds[f] == "string" else F.col(f"p.{f}"), F.col(f"s.{f}")).alias(f)
    words = F.concat("p.keywords", "s.keywords")
    united = F.filter(words, lambda w, i: F.array_position(F.transform(words, F.lower), F.lower(w)) == i + 1)
    return rows.select("ord", "old_ord", F.coalesce(F.nullif("o.id", F.lit("")), "n.id").alias("id"), *[pick(f) for f in fields], F.greatest("o.citations", "n.citations").alias("citations"), united.alias("keywords"))


def applied(changes: DataFrame, new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored table (id and the merged fields) after the changes, and ``change, n``: new records are inserted, updated ones merged;
    of several with an id the last one stays."""
    columns = ["id", "title", "year", "venue", "abstract", "doi", "url", "pdf_url", "citations", "keywords"]
    changes = cut(changes)
    update = last_wins(merged(changes.where("change = 'updated'"), new, old).select("ord", *columns), ["id"], "ord")
    insert = last_wins(new.join(changes.where("change = 'new'").select("ord"), "ord", "left_semi").select("ord", *columns), ["id"], "ord")
    stored = upsert(old.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*columns[1:]), "ord").alias("r")).select("id", "r.*"), insert, ["id"])
    return upsert(stored, update.select(*columns), ["id"]), changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def gate(entities: DataFrame, stale: DataFrame) -> DataFrame:
    """Entities (column entity) that are due for a refresh: those marked stale, and those never synchronised."""
    return entities.join(stale, "entity", "left").where(F.coalesce("stale", F.lit(True))).select(entities.columns)
