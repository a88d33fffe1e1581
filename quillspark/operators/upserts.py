"""Upserts, replacements and deletions as joins of an old and a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def last_wins(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key in a batch (rows with a null key are left out); other columns come from that row."""
    others = [c for c in batch.columns if c not in key]
    whole = batch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
    picked = whole.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in others]).select(*batch.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new`` (one row a key); the columns of ``old``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def upsert_keep(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """Like :func:`upsert`, but the columns ``keep`` stay as they are in ``old`` where the key was there."""
    kept = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    return (
        old.join(new.select(*key).distinct(), key, "left_anti")
        .unionByName(new.join(kept, key, "left").select(*[F.coalesce(F.col(f"_old_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns]))
    )


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` and, of the keys it lacks, the first row of ``new``."""
    others = [c for c in new.columns if c not in key]
    firsts = new.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r")).select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in others])
    return old.unionByName(firsts.join(old.select(*key).distinct(), key, "left_anti").select(*old.columns))


def replace_children(children: DataFrame, parent: str, fresh: DataFrame, parents: DataFrame) -> DataFrame:
    """The children of all other parents, and ``fresh`` for those in ``parents`` (one column ``parent``)."""
    return children.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(fresh.join(parents.select(parent).distinct(), parent, "left_semi").select(*children.columns))


def delete_keys(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` without those whose value in any of ``columns`` is among ``keys`` (one column)."""
    k = keys.columns[0]
    for c in columns:
        rows = rows.join(keys.select(F.col(k).alias(c)).where(F.col(c).isNotNull()).distinct(), c, "left_anti").select(*rows.columns)
    return rows
