"""Text keys and identifier checks as column expressions (JVM-side, except NFC)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

NOT_WORD = r"[^\p{L}\p{N}_\s]"
SPACE = r"[\s\p{Z}]+"
# Prefixes that are cut off a DOI, and its format.
DOI_PREFIX = r"^(?i:https?://doi\.org/|doi:)"
DOI_FORMAT = r"^10\.[0-9]{4,9}/\S+$"


def nfc(c: Column) -> Column:
    """NFC form; plain ASCII texts are passed through inside the JVM."""

    def call(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        forms = [unicodedata.normalize("NFC", v) for v in distinct] + [None]
        return pd.Series([forms[i] for i in codes], dtype=object)

    call.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.pandas_udf(call, "string")(c))


def folded(c: Column) -> Column:
    """Without accents; plain ASCII texts are passed through inside the JVM."""

    def call(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        forms = ["".join(x for x in unicodedata.normalize("NFKD", v) if not unicodedata.combining(x)) for v in distinct] + [None]
        return pd.Series([forms[i] for i in codes], dtype=object)

    call.__annotations__ = {"values": pd.Series, "return": pd.Series}
    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, c).otherwise(F.pandas_udf(call, "string")(F.when(~plain, c)))


def nfc_all(c: Column) -> Column:
    """NFC form of the texts of an array; arrays of plain ASCII texts are passed through inside the JVM."""

    def call(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [None if t is None else unicodedata.normalize("NFC", t) for t in v] for v in values], dtype=object)

    call.__annotations__ = {"values": pd.Series, "return": pd.Series}
    other = F.exists(c, lambda t: ~t.rlike(r"^[\x00-\x7F]*$"))
    return F.when(other, F.pandas_udf(call, "array<string>")(F.when(other, c))).otherwise(c)


def title_key(c: Column) -> Column:
    """Lower case, without punctuation, with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), NOT_WORD, " "), SPACE, " "))


def ascii_cjk_key(c: Column) -> Column:
    """The narrower key of people and topics: a-z, 0-9 and CJK ideographs only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9一-鿿 ]", " "), " +", " "))


def tokens(key: Column) -> Column:
    """Distinct non-empty tokens of a key, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda t: t != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection by size of the union of two arrays of distinct values; two empty ones give 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union.cast("double"))


def strict_doi(c: Column) -> Column:
    """The DOI without its usual prefixes, or null where the rest isn't one; case is kept."""
    bare = F.trim(F.regexp_replace(F.trim(c), DOI_PREFIX, ""))
    return F.when(bare.rlike(DOI_FORMAT), bare)


def strict_pmid(c: Column) -> Column:
    """One to eight digits, or null."""
    bare = F.trim(c)
    return F.when(bare.rlike(r"^[0-9]{1,8}$"), bare)


def strict_arxiv(c: Column) -> Column:
    """An arXiv id in either canonical form without its version, or null."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv:)\s*", ""))
    return F.when(bare.rlike(r"^(?:[0-9]{4}\.[0-9]{4,5}|[a-z.\-]+/[0-9]{7})(?:v[0-9]+)?$"), F.regexp_replace(bare, r"v[0-9]+$", ""))


def orcid_ok(c: Column) -> Column:
    """Whether an ORCID has its format and the right MOD 11-2 check digit."""
    digits = F.regexp_replace(c, "-", "")
    total = F.aggregate(F.split(F.substring(digits, 1, 15), ""), F.lit(0), lambda a, d: (a + d.cast("int")) * 2)
    check = (12 - total % 11) % 11
    shown = F.when(check == 10, "X").otherwise(check.cast("string"))
    return F.coalesce(F.when(c.rlike(r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$"), F.substring(digits, 16, 1) == shown), F.lit(False))


def work_key(c: Column) -> Column:
    """W-id, bare or as the last part of a URL, upper case; null where there is none."""
    return F.nullif(F.upper(F.regexp_extract(F.trim(c), r"(?i)^(?:https?://[^/\s]+/)?(W[0-9]+)/?$", 1)), F.lit(""))


def url_ok(c: Column) -> Column:
    """Whether a text is an http(s) URL with a host."""
    return F.coalesce(c.rlike(r"^(?i:https?)://[^/\s?#]+\S*$"), F.lit(False))


def venue_tokens(c: Column) -> Column:
    """Tokens of a venue name in order, without punctuation, articles and conjunctions."""
    key = title_key(F.replace(c, F.lit("&"), F.lit(" and ")))
    return F.filter(F.split(key, " "), lambda t: (t != "") & ~t.isin("the", "of", "and"))


def venues_equivalent(a: Column, b: Column) -> Column:
    """Same number of tokens, each a prefix of the other's (so abbreviations match); equal token lists always match."""
    x, y = venue_tokens(a), venue_tokens(b)
    pairwise = F.forall(F.zip_with(x, y, lambda s, t: s.startswith(t) | t.startswith(s)), lambda ok: ok)
    return (x == y) | ((F.size(x) > 0) & (F.size(x) == F.size(y)) & F.coalesce(pairwise, F.lit(False)))


def squeezed_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def content_hash(title: Column, names: Column, year: Column, venue: Column) -> Column:
    """First 16 hex digits of SHA-256 over title, names, year and venue, all joined by bars; nulls are empty."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(F.array_join(names, "|"), F.lit("")), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")), F.lit("|"), F.coalesce(venue, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 16)


def redacted(c: Column) -> Column:
    """URLs without the values of secret query parameters and without passwords."""
    hidden = F.regexp_replace(c, r"(?i)([?&](?:api_?key|key|token|access_token|mailto|email|secret|password)=)[^&#\s]*", "$1***")
    return F.regexp_replace(hidden, r"(://[^:/@\s]+:)[^@/\s]+@", "$1***@")


def safe_stem(c: Column) -> Column:
    """A file name made of harmless characters."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def list_cell(c: Column) -> Column:
    """A semicolon-separated cell as an array of trimmed non-empty texts."""
    return F.filter(F.transform(F.split(c, ";"), lambda t: F.trim(t)), lambda t: t != "")


def formula_safe(c: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def id_kind(c: Column) -> Column:
    """Which kind of identifier a query text is: doi, work, arxiv, or free text."""
    return F.when(strict_doi(c).isNotNull(), "doi").when(work_key(c).isNotNull(), "work").when(strict_arxiv(c).isNotNull(), "arxiv").otherwise("text")


def period_start(ts: Column, seconds: int | None = None) -> Column:
    """Start of the UTC day, or of the aligned bucket of ``seconds``."""
    return F.date_trunc("day", ts) if seconds is None else F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def cache_key(*columns: Column) -> Column:
    """SHA-256 of the columns as one JSON text, in the order given; nulls count as null."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("null")) for c in columns])), 256)


def year_range(text: str | None) -> tuple[int | None, int | None]:
    """The bounds of a year argument: 'YYYY', 'YYYY-YYYY', or None for no bounds."""
    if not text:
        return None, None
    if (m := re.fullmatch(r"\s*(\d{4})(?:\s*-\s*(\d{4}))?\s*", text)) is None or (m[2] and m[2] < m[1]):
        raise ValueError(f"not a year or a range of years: {text}")
    return int(m[1]), int(m[2] or m[1])


def surname(c: Column) -> Column:
    """The last token of a name in the narrower key of people, or null."""
    key = ascii_cjk_key(c)
    return F.nullif(F.element_at(F.split(key, " "), -1), F.lit(""))


def significant_tokens(c: Column) -> Column:
    """Distinct tokens of a name that have two characters or more, sorted."""
    return F.filter(tokens(title_key(c)), lambda t: F.length(t) > 1)


def index_keys(c: Column) -> Column:
    """What a name is indexed by: its significant tokens, and all runs of two characters of those with three or four."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(significant_tokens(c), lambda t: F.concat(F.array(t), F.when(F.length(t).isin(3, 4), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))))))


def arxiv_of_doi(c: Column) -> Column:
    """The preprint id that a DOI of the preprint server names, without version, or null."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(F.trim(c)), r"10\.48550/arxiv\.((?:[0-9]{4}\.[0-9]{4,5}|[a-z\-.]+/[0-9]{7})(?:v[0-9]+)?)$", 1), r"v[0-9]+$", ""), F.lit(""))


def sorted_json(columns: dict[str, Column]) -> Column:
    """Compact JSON text of named columns in the order of their names; nulls are written."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})
