"""Filters and pages over papers and authors."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import nfc_all, title_key, tokens


def name_matches(query: str, stored: Column) -> Column:
    """Folded substring, or all tokens (of two characters or more) of the query among the stored name's tokens.

    The query is brought to NFC here; stored names are expected in NFC (``functions.text.nfc`` and ``nfc_all``). An empty
    query matches nothing.
    """
    asked = unicodedata.normalize("NFC", query).lower().strip()
    longer = lambda key: F.filter(tokens(key), lambda t: F.length(t) > 1)
    wanted, have = longer(title_key(F.lit(asked))), longer(title_key(stored))
    return F.lit(asked != "") & (F.lower(stored).contains(asked) | ((F.size(wanted) > 0) & (F.size(F.array_except(wanted, have)) == 0)))


def checked(text: str) -> str:
    """A text to search for, folded; a NUL in it is refused."""
    if "\x00" in text:
        raise ValueError("a text to search for must not contain NUL")
    return text.casefold()


def query_papers(
    papers: DataFrame, author: str | None = None, year: int | None = None, year_from: int | None = None, year_to: int | None = None,
    venue: str | None = None, keyword: str | None = None,
) -> DataFrame:
    """Papers for which all given conditions hold; None or an empty text is no condition. Nulls match no condition."""
    tests: list[Column] = []
    if author:
        checked(author)
        tests.append(F.exists(nfc_all(F.transform("authors", lambda a: a["name"])), lambda n: name_matches(author, n)))
    if year is not None:
        tests.append(F.col("year") == year)
    if year_from is not None:
        tests.append(F.col("year") >= year_from)
    if year_to is not None:
        tests.append(F.col("year") <= year_to)
    if venue:
        tests.append(F.lower("venue").contains(checked(venue)))
    if keyword:
        k = checked(keyword)
        tests.append(
            F.coalesce(F.lower("title").contains(k), F.lit(False)) | F.coalesce(F.lower("abstract").contains(k), F.lit(False)) | F.coalesce(F.exists("keywords", lambda w: F.lower(w).contains(k)), F.lit(False))
        )
    return papers.where(reduce(lambda a, b: a & b, tests)) if tests else papers


def query_authors(authors: DataFrame, name: str | None = None, affiliation: str | None = None, interest: str | None = None) -> DataFrame:
    """Authors by name (see :func:`name_matches`), affiliation substring and interest substring."""
    tests: list[Column] = []
    if name:
        tests.append(name_matches(name, F.col("name")))
    if affiliation:
        tests.append(F.lower("affiliation").contains(affiliation.lower()))
    if interest:
        tests.append(F.exists("interests", lambda i: F.lower(i).contains(interest.lower())))
    return authors.where(reduce(lambda a, b: a & b, tests)) if tests else authors


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows after the cursor ``after`` (values of ``order``) in ascending order, nulls first.

    The order must be unique, or rows equal to the cursor are skipped. Only the top rows of each partition
    are kept on the way (a bounded sort), so no full sort takes place.
    """
    if size < 1:
        raise ValueError("size must be positive")
    if after is not None:
        greater: Column = F.lit(False)
        for i, (c, v) in enumerate(zip(order, after, strict=True)):
            same = reduce(lambda a, b: a & b, [F.col(order[j]).eqNullSafe(F.lit(after[j])) for j in range(i)], F.lit(True))
            above = F.col(c).isNotNull() if v is None else F.col(c) > F.lit(v)
            greater = greater | (same & F.coalesce(above, F.lit(False)))
        rows = rows.where(greater)
    return rows.orderBy(*[F.asc_nulls_first(c) for c in order]).limit(size)


def offset_page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size``; negative numbers are refused."""
    if offset < 0 or size < 0:
        raise ValueError("offset and size must not be negative")
    return rows.orderBy(*[F.asc_nulls_first(c) for c in order]).offset(offset).limit(size)
