"""References to records that do not exist, are deleted, or arrive later."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import lookup

MATCHES = ("simple", "full", "partial")


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    keys: list[tuple[str, str]],
    match: str = "simple",
    deleted: Column | None = None,
    loaded: Column | None = None,
    at: str | None = None,
) -> DataFrame:
    """Rows of ``refs`` whose (composite) reference leads nowhere, with a column ``reason``.

    ``keys`` pairs each reference column with a column of ``targets``. References are grouped by
    their null mask, and each mask is anti-joined on its non-null columns only:

    * ``simple``  - a reference with any null refers to nothing and is fine;
    * ``full``    - all null is fine, some null is an orphan ('partial_null');
    * ``partial`` - the non-null columns must match some target; all null is fine.

    ``reason`` is the first that holds: 'partial_null', 'missing' (no target row), 'deleted' (``deleted``
    holds for every target row of the key) or 'late' (the earliest ``loaded`` is after ``refs[at]``).
    Targets with a null in a column used for the match are never matched. Equal reference rows each
    give their own row; empty inputs give an empty result (with no targets every reference is missing).

    Targets are first reduced to one row a key. A key that holds a large part of all references is
    matched against a broadcast of at most ``HOT_KEYS`` target rows where it is. Targets are joined once: the reason follows from the joined row.
    """
    refs = refs.drop("reason", "_key", "_known", "_gone", "_first")
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if not keys:
        raise ValueError("keys must not be empty")
    out: list[DataFrame] = []
    for mask in product((True, False), repeat=len(keys)):  # True: the column is given
        given = [k for k, there in zip(keys, mask, strict=True) if there]
        if not given or (match == "simple" and len(given) < len(keys)):
            continue
        rows = refs.where(reduce(lambda a, b: a & b, (F.col(r).isNotNull() if there else F.col(r).isNull() for (r, _), there in zip(keys, mask, strict=True))))
        if match == "full" and len(given) < len(keys):
            out.append(rows.withColumn("reason", F.lit("partial_null")))
            continue
        out.append(_of_mask(rows, targets, given, deleted, loaded, at))
    return reduce(DataFrame.unionByName, out)


def _of_mask(rows: DataFrame, targets: DataFrame, keys: list[tuple[str, str]], deleted: Column | None, loaded: Column | None, at: str | None) -> DataFrame:
    names = rows.columns
    whole = reduce(lambda a, b: a & b, (F.col(t).isNotNull() for _, t in keys))
    known = targets.where(whole).groupBy(_joined([t for _, t in keys]).alias("_key")).agg(
        F.min((deleted if deleted is not None else F.lit(False)).cast("int")).alias("_gone"),
        (F.min(loaded) if loaded is not None else F.lit(None).cast("timestamp")).alias("_first"),
    )
    rows = lookup(rows.withColumn("_key", _joined([r for r, _ in keys])), known.withColumn("_known", F.lit(True)), "_key")
    late = F.col("_first") > F.col(at) if at is not None and loaded is not None else F.lit(False)
    reason = F.when(F.col("_known").isNull(), "missing").when(F.col("_gone") == 1, "deleted").when(late, "late")
    return rows.select(*names, reason.alias("reason")).where("reason IS NOT NULL")


def _joined(cols: list[str]) -> Column:
    """One string for a composite key; lengths keep ('a', 'bc') and ('ab', 'c') apart."""
    if len(cols) == 1:
        return F.col(cols[0]).cast("string")
    texts = [F.col(c).cast("string") for c in cols]
    return F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])


def orphan_report(orphans: DataFrame, by: list[str]) -> DataFrame:
    """Counts of orphan references for each combination of ``by`` (table, field, period, reason)."""
    return orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"))
