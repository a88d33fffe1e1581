"""A store of tables: batches of records, updates and deletions with what hangs on them, key reads, state, indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import ascii_cjk_key, title_key, tokens
from quillspark.operators.edges import authorships, coauthor_pairs
from quillspark.operators.upserts import delete_keys, last_wins, replace_children, upsert
from quillspark.session import BUCKETS, cut, stored

#: Deepest nesting kept of raw JSON, and what stands for what lies deeper.
MOST_DEPTH = 99
TRUNCATED = "<truncated: nesting too deep>"
#: Length of the pieces names and texts are indexed by.
PIECE = 3


def save_batch(store: dict[str, DataFrame], papers: DataFrame, order: str) -> dict[str, DataFrame]:
    """The tables ``papers``, ``authorships`` and ``coauthors`` after a batch: the last row of an id counts, the bylines of its papers are
    replaced and co-authorships follow from all bylines. Rows without id are left out."""
    batch = last_wins(papers, ["id"], order)
    stored = upsert(store["papers"], batch, ["id"])
    fresh = authorships(batch)
    ships = replace_children(store["authorships"], "paper", fresh, batch.select(F.col("id").alias("paper")))
    return {"papers": stored, "authorships": ships, "coauthors": coauthor_pairs(ships)}


def delete_papers(store: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after papers (one column id) are deleted with their bylines; co-authorships are made anew."""
    ships = delete_keys(store["authorships"], gone, ["paper"])
    return {"papers": delete_keys(store["papers"], gone, ["id"]), "authorships": ships, "coauthors": coauthor_pairs(ships)}


def update_rows(stored: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``stored`` with the rows of ``changes`` (one a key) in place of those with the same key, and ``key, updated`` for each change:
    false where the key isn't stored, and then nothing is written."""
    known = changes.join(stored.select(key).distinct(), key, "left_semi")
    done = changes.select(key).join(stored.select(key).distinct().withColumn("_k", F.lit(True)), key, "left").select(key, F.coalesce("_k", F.lit(False)).alias("updated"))
    return upsert(stored, known, [key]), done


def keyed_upsert(stored: DataFrame, writes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A small state table (page cache, quota use, hashes, synchronisation times) after writes: the last write of a key counts."""
    return upsert(stored, last_wins(writes, keys, order).select(*stored.columns), keys)


def confirm_identities(identities: DataFrame, links: DataFrame, confirmations: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Identities (``name, author, status``) and their papers (``paper, name, author``) after confirmations ``paper, name, author``.

    The identity is written before the link to a paper; a link whose identity isn't there is refused.
    """
    given = last_wins(confirmations.where("author IS NOT NULL"), ["paper", "name"], order)
    fresh = given.select("name", "author").distinct().withColumn("status", F.lit("confirmed"))
    known = upsert(identities, fresh, ["name", "author"])
    allowed = given.join(known.select("name", "author").distinct(), ["name", "author"], "left_semi").select("paper", "name", "author")
    return known, upsert(links, allowed, ["paper", "name"])


def evidence_read(records: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``key, evidence``: entries of the evidence table in their order (column at), those of the record's own column where the table has none."""
    listed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("_rows"))
    return records.select(key, "evidence_list").join(listed, key, "left").select(key, F.coalesce("_rows", "evidence_list").alias("evidence"))


def latest(rows: DataFrame, by: str, *ties: str) -> DataFrame:
    """The row with the largest ``by`` (then the smallest ``ties``)."""
    return rows.orderBy(F.desc(by), *ties).limit(1)


def references_of(edges: DataFrame, records: DataFrame, column: str) -> DataFrame:
    """``id, ref``: references from the edge table and from the record's own list, each once."""
    own = records.select("id", F.explode(column).alias("ref"))
    return edges.select("id", "ref").unionByName(own).where("id IS NOT NULL AND ref IS NOT NULL").distinct()


def pieces(text: Column) -> Column:
    """Distinct runs of three characters of a folded text."""
    low = F.lower(text)
    return F.when(F.length(low) >= PIECE, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - PIECE + 1), lambda i: F.substring(low, i, F.lit(PIECE))))).otherwise(F.array().cast("array<string>"))


def name_tokens_index(papers: DataFrame) -> DataFrame:
    """``ord, at, token``: tokens (two characters or more) of each byline name."""
    each = papers.select("ord", F.posexplode("authors").alias("at", "a"))
    return each.select("ord", "at", F.explode(F.filter(tokens(title_key(F.col("a.name"))), lambda t: F.length(t) > 1)).alias("token"))


def text_pieces_index(papers: DataFrame) -> DataFrame:
    """``ord, piece``: runs of three characters of each title."""
    return papers.select("ord", F.explode(pieces(F.col("title"))).alias("piece"))


def _spelled(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ord, name``: bylines as single names, and the stored distinct names."""
    names = papers.select("ord", F.explode("authors.name").alias("name")).where("name IS NOT NULL")
    return names, stored(names.select("name").distinct())


def _met_names(spelled: DataFrame, queries: DataFrame, keys: Callable[[Column], Column], holds: Column) -> DataFrame:
    """``query, name`` where the name has all keys of the query and ``holds`` (a test of ``name``, ``keys``, ``query`` and ``q``).

    A query meets names by the rarest of its keys only. Keys whose bucket no query is looked up by don't leave their task; at most
    ``BUCKETS`` numbers are broadcast for that.
    """
    each = spelled.select("name", keys(F.col("name")).alias("keys"))
    asked = queries.select("query", keys(F.col("query")).alias("q")).distinct().where(F.size("q") > 0)
    counts = each.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    sized = asked.select("query", F.explode("q").alias("key")).join(counts, "key", "left")
    rarest = cut(sized.groupBy("query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("r")).where("r.df > 0").select("query", "r.key"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    near = each.select("name", F.explode("keys").alias("key")).withColumn("bucket", bucket).join(F.broadcast(rarest.select(bucket).distinct()), "bucket", "left_semi").select("key", "name")
    met = near.join(rarest, "key").select("query", "name", keys(F.col("name")).alias("keys"), keys(F.col("query")).alias("q"))
    return met.where(holds).select("query", "name")


def _name_tokens(name: Column) -> Column:
    return F.filter(tokens(title_key(name)), lambda t: F.length(t) > 1)


def _token_names(spelled: DataFrame, queries: DataFrame) -> DataFrame:
    return _met_names(spelled, queries, _name_tokens, F.size(F.array_intersect("keys", "q")) == F.size("q"))


def _substring_names(spelled: DataFrame, queries: DataFrame) -> DataFrame:
    return _met_names(spelled, queries, pieces, F.contains(F.lower("name"), F.lower("query")))


def by_tokens(papers: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, ord``: papers with a byline name that holds all tokens of the query."""
    names, spelled = _spelled(papers)
    return _token_names(spelled, queries).join(names, "name").select("query", "ord").distinct()


def by_name(papers: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, ord``: papers with a byline name that holds all tokens of the query or contains it as a text (case aside)."""
    names, spelled = _spelled(papers)
    met = _token_names(spelled, queries).unionByName(_substring_names(spelled, queries)).distinct()
    return met.join(names, "name").select("query", "ord").distinct()


def capped_depth(text: Column, most: int = MOST_DEPTH) -> Column:
    """Raw JSON text whose nesting is at most ``most`` deep; deeper texts are replaced by a mark. Strings aren't counted."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    marks = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    deepest = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), lambda a, c: F.struct(
        F.when(c.isin("[", "{"), a["now"] + 1).otherwise(a["now"] - 1).alias("now"), F.when(c.isin("[", "{"), F.greatest(a["top"], a["now"] + 1)).otherwise(a["top"]).alias("top")), lambda a: a["top"])
    return F.when(deepest > most, F.lit(TRUNCATED)).otherwise(text)


def topic_key(c: Column) -> Column:
    return ascii_cjk_key(c)
