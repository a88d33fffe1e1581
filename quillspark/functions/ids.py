"""Identifier normal forms as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What deliverers write where they have no identifier.
NO_IDENTIFIER = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "tbd", "tba", "unknown", "undefined", "missing")

INVISIBLE = "[\\u00AD\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\uFEFF]"
BLANKS = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def squeezed(c: Column) -> Column:
    """Without invisible characters, with single plain blanks, without blanks at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), BLANKS, " "))


def record_key(c: Column) -> Column:
    """A catalogue id such as W123 or A123 in one notation: bare, upper case, without a URL. Blank gives null."""
    bare = F.upper(F.regexp_replace(squeezed(c), r"^.*[/:#=]\s*(?=[^/:#=]+/?$)|/$", ""))
    return F.nullif(F.trim(bare), F.lit(""))


def doi_key(c: Column) -> Column:
    """The DOI named in ``c`` (prefix/suffix, lower case) or null where it holds none."""
    text = F.lower(F.regexp_replace(squeezed(c), "(?i)%2f", "/"))
    found = F.regexp_extract(text, r"(10\.[0-9]{4,9}/[^\s\"<>]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;:)\]}'\"/]+$", ""), F.lit(""))


def arxiv_key(c: Column) -> Column:
    """The arXiv id named in ``c`` without version (new and old style), or null."""
    text = F.lower(squeezed(c))
    new = F.regexp_extract(text, r"(?:^|[^0-9.])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:\.pdf)?/?$", 1)
    old = F.regexp_extract(text, r"(?:^|[/:\s])([a-z\-]+(?:\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?(?:\.pdf)?/?$", 1)
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def pmid_key(c: Column) -> Column:
    """The PubMed number named in ``c`` without leading zeros, or null."""
    text = F.lower(squeezed(c))
    found = F.regexp_extract(text, r"^(?:.*[/:\s]|pmid)?\s*0*([1-9][0-9]{0,8})(?:\.0+)?/?$", 1)
    return F.nullif(found, F.lit(""))


def is_identifier(c: Column) -> Column:
    """Whether ``c`` holds something else than a stand-in for a missing identifier."""
    return c.isNotNull() & ~F.lower(squeezed(c)).isin(*NO_IDENTIFIER)
