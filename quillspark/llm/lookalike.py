"""One form for text that looks the same but is made of different characters.

Two results are made for a value:

* the *plain form*: the value as it looks, written in plain characters - composed letters, ordinary
  width, blanks and hyphens, nothing invisible, no joined letter forms, and every letter from the
  script of the word (or, for names, of the whole name) it stands in. Case, spelling and characters
  that visibly differ from plain ones (raised digits, circled numbers) stay;
* the *comparison form*: NFKC of the plain form, full case folding, NFKC again, single blanks.

Work is done once per distinct value of an Arrow batch, so repeated values cost one dictionary look-up and
no shuffle is needed; a value that fills a third of all rows is no hot spot.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Letters of Cyrillic, Greek and Armenian that look like a Latin letter, in alphabetical order of the
# script. Greek small alpha and the like are left out: they differ visibly in print and are common symbols.
CYRILLIC_LATIN = dict(zip("АВЕЅІЇЈКМНОРСТУХҮԌԚԜаеѕіїјорсухһԁԛԝѵӏ", "ABESIÏJKMHOPCTYXYGQWaesiïjopcyxhdqwvl", strict=True))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο", "ABEZHIKMNOPTYXvo", strict=True))
ARMENIAN_LATIN = dict(zip("ՕՍօսցհո", "OUoughn", strict=True))

#: Letters of other scripts that form a symbol of their own beside Latin words, upper case being the same symbol.
WHOLE_WORD_MOST = 3

_IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]")
_SPACES = regex.compile(r"[\p{Zs}\t\n\r\v\f\x85  ]")
_NARROW = regex.compile(r"[！-￮　ﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳ]")
_HYPHENS = regex.compile(r"[‐‑﹣]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_SCRIPTS = {"Latin": regex.compile(r"\p{Script=Latin}"), "Cyrillic": regex.compile(r"\p{Script=Cyrillic}"), "Greek": regex.compile(r"\p{Script=Greek}"), "Armenian": regex.compile(r"\p{Script=Armenian}")}


def _to_script() -> dict[str, dict[str, str]]:
    """For each script, the look-alikes of other scripts and the letter of that script they look like."""
    to: dict[str, dict[str, str]] = {"Latin": {}}
    for name, table in (("Cyrillic", CYRILLIC_LATIN), ("Greek", GREEK_LATIN), ("Armenian", ARMENIAN_LATIN)):
        to["Latin"].update(table)
        to[name] = {latin: own for own, latin in table.items()}
    for name, table in (("Cyrillic", CYRILLIC_LATIN), ("Greek", GREEK_LATIN)):
        other = GREEK_LATIN if name == "Cyrillic" else CYRILLIC_LATIN
        for letter, latin in other.items():
            if latin in to[name]:
                to[name][letter] = to[name][latin]
    return to


_TO = _to_script()


_OTHER_SCRIPT = regex.compile(r"[\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Armenian}]")


@lru_cache(maxsize=100_000)
def script_of(letter: str) -> str | None:
    return next((name for name, pattern in _SCRIPTS.items() if pattern.match(letter)), None)


@lru_cache(maxsize=100_000)
def _letter(ch: str) -> tuple[str, int] | None:
    """A letter's script and weight: 1 if it looks like another script's, else 3."""
    name = script_of(ch)
    return None if name is None else (name, 1 if any(ch in _TO[o] for o in _TO if o != name) else 3)


def _counts(text: str) -> dict[str, int]:
    """How many letters each script surely has in ``text``: letters that look like another script's count least."""
    counts: dict[str, int] = {}
    for ch, n in Counter(text).items():
        if (got := _letter(ch)) is not None:
            counts[got[0]] = counts.get(got[0], 0) + got[1] * n
    return counts


def _sure(word: str, scripts: dict[str, int]) -> list[int]:
    """For each letter 3 if only its own script has that shape, else 1."""
    return [1 if any(ch in _TO[o] for o in scripts if o != s) else 3 for ch in word if (s := script_of(ch)) is not None]


def _leading(counts: dict[str, int]) -> str | None:
    return max(sorted(counts), key=lambda k: (counts[k], k == "Latin")) if counts else None


def _settle(word: str, script: str) -> str:
    table = _TO.get(script, {})
    return "".join(table.get(ch, ch) if script_of(ch) not in (script, None) else ch for ch in word)


def unmixed(text: str, whole: bool = False) -> str:
    """``text`` with each look-alike letter replaced by the letter of the script it stands in.

    The unit is the word, or the whole text if ``whole`` (names of people). A word of one script that
    differs from the script of the text around it is left alone, unless all of its at most
    ``WHOLE_WORD_MOST`` letters look like letters of that script (a Cyrillic T in 'naive T cells').
    A single Greek letter joined to a word by a hyphen stays a symbol.
    """
    if _OTHER_SCRIPT.search(text) is None:
        return text
    overall = _leading(_counts(text))
    if overall is None:
        return text

    def one(m: regex.Match) -> str:
        word = m.group()
        counts = _counts(word)
        if not counts:
            return word
        if whole:
            return _settle(word, overall)
        if len(counts) > 1:
            if all(n < 3 for n in _sure(word, counts)):
                return _settle(word, overall)
            best, top = _leading(counts), max(counts.values())
            return _settle(word, overall if counts.get(overall) == top else best)
        (script,) = counts
        letters = [ch for ch in word if script_of(ch)]
        if script != overall and len(letters) <= WHOLE_WORD_MOST and all(ch in _TO.get(overall, {}) for ch in letters):
            if script == "Greek" and len(letters) == 1 and text[m.end() : m.end() + 1] == "-":
                return word
            return _settle(word, overall)
        return word

    return _WORD.sub(one, text)


def visible_form(text: str) -> str:
    """Composed letters, ordinary width, blanks and hyphens, nothing invisible; scripts are left as they are."""
    if text.isascii():
        return _SPACES.sub(" ", text) if any(c in text for c in "\t\n\r\v\f") else text
    out = _IGNORABLE.sub("", text)
    out = _SPACES.sub(" ", out)
    out = _HYPHENS.sub("-", out)
    out = _NARROW.sub(lambda m: unicodedata.normalize("NFKC", m.group()), out)
    return unicodedata.normalize("NFC", out)


def plain_form(text: str, whole: bool = False) -> str:
    """The value as it looks in plain characters; see the module's description."""
    out = visible_form(text)
    return out if out.isascii() else unicodedata.normalize("NFC", unmixed(out, whole))


def comparison_form(text: str, whole: bool = False) -> str:
    """Equal for all texts that look the same, whatever their case."""
    out = plain_form(text, whole)
    if out.isascii():
        return " ".join(out.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", out).casefold()).split())


def _per_distinct(values: pd.Series, f: Callable[[str], object]) -> pd.Series:
    codes, distinct = pd.factorize(values)
    results = [f(v) for v in distinct] + [None]  # code -1: null
    return pd.Series([results[c] for c in codes], index=values.index, dtype=object)


def _udf(f: Callable[[str], object], kind: T.DataType) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def call(values: pd.Series) -> pd.Series:
        return _per_distinct(values, f)

    return call


def plain_text(c: Column, whole: bool = False) -> Column:
    """Column form of :func:`plain_form`; null gives null, an empty text stays empty."""
    return _udf(lambda v: plain_form(v, whole), T.StringType())(c)


def comparable(c: Column, whole: bool = False) -> Column:
    """Column form of :func:`comparison_form`; null gives null, an empty text stays empty."""
    return _udf(lambda v: comparison_form(v, whole), T.StringType())(c)


def normalise_values(values: DataFrame, value: str, whole: str) -> DataFrame:
    """Adds ``plain``, ``comparison`` and ``altered`` (whether the value isn't its own plain form) to each row.

    ``value`` names the text column, ``whole`` a boolean column that says whether the text is one name.
    All other columns stay; columns named plain, comparison or altered are replaced. Null texts give
    nulls and ``altered`` false; repeated rows stay repeated; an empty table stays empty.
    """
    result = T.StructType([T.StructField("plain", T.StringType()), T.StructField("comparison", T.StringType()), T.StructField("altered", T.BooleanType())])

    @F.pandas_udf(result)
    def call(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(pd.Series(list(zip(texts, names.fillna(False), strict=True)), dtype=object))
        rows = [(p := plain_form(t, bool(n)), comparison_form(t, bool(n)), p != t) if t is not None and t == t else (None, None, False) for t, n in distinct]
        return pd.DataFrame([rows[c] for c in codes], columns=["plain", "comparison", "altered"])

    kept = [c for c in values.columns if c not in ("plain", "comparison", "altered")]
    return values.withColumn("_forms", call(F.col(value), F.col(whole))).select(*[F.col(f"`{c}`") for c in kept], "_forms.plain", "_forms.comparison", "_forms.altered")
