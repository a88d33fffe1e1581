"""Declared extraction of fields from fetched pages, and a page's way from fetch result to record."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.segments import challenge_mark, needs_script, page_status, page_text, page_title

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Rule:
    """One field: a CSS selector (``tag``, ``.class``, ``#id``, ``[attribute]`` or ``[attribute=value]`` joined, parts in descent order with blanks), the
    attribute to take (else the text), whether all hits are wanted, and what stands in for none."""

    select: str
    attribute: str | None = None
    many: bool = False
    default: str | None = None


@dataclass(frozen=True)
class Spec:
    """A named set of rules: the declared program of an extraction."""

    name: str
    rules: dict[str, Rule] = field(default_factory=dict)


class _Tree(HTMLParser):
    """Elements of a page in document order: tag, attributes, the chain of parents and the text inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, dict, int, list[str]]] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.elements.append((tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else -1, []))
        if tag not in _VOID:
            self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.elements.append((tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else -1, []))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[i]][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        for i in self.open:
            self.elements[i][3].append(data)


def _simple(part: str) -> tuple[str, str, list[str], list[tuple[str, str | None]]]:
    """Tag, id, classes and attribute tests of one part of a selector."""
    tag = ident = ""
    classes, tests = [], []
    at = 0
    while at < len(part):
        kind = part[at] if part[at] in ".#[" else ""
        end = part.find("]", at) if kind == "[" else min([i for c in ".#[" if (i := part.find(c, at + 1)) > 0] or [len(part)])
        if end < 0:
            raise ValueError(f"selector part without ]: {part}")
        body = part[at + 1 if kind else at : end]
        if kind == ".":
            classes.append(body)
        elif kind == "#":
            ident = body
        elif kind == "[":
            name, _, value = body.partition("=")
            tests.append((name, value.strip("\"'") if "=" in body else None))
            end += 1
        else:
            tag = body
        at = end
    return tag, ident, classes, tests


def _fits(element: tuple, part: tuple) -> bool:
    tag, ident, classes, tests = part
    own = element[1]
    return (tag in ("", "*", element[0])) and (not ident or own.get("id") == ident) and set(classes) <= set(own.get("class", "").split()) and all(n in own and (v is None or own[n] == v) for n, v in tests)


def _hits(tree: _Tree, select: str) -> list[int]:
    parts = [_simple(p) for p in select.split()]
    out = []
    for i, e in enumerate(tree.elements):
        if not parts or not _fits(e, parts[-1]):
            continue
        left, up = len(parts) - 2, e[2]
        while left >= 0 and up >= 0:
            if _fits(tree.elements[up], parts[left]):
                left -= 1
            up = tree.elements[up][2]
        if left < 0:
            out.append(i)
    return out


def evaluate(page: str, spec: Spec) -> dict[str, list[str]]:
    """The values of each rule in a page, in document order; an unreadable page gives the defaults."""
    tree = _Tree()
    tree.feed(page)
    out = {}
    for name, rule in spec.rules.items():
        values = []
        for i in _hits(tree, rule.select):
            e = tree.elements[i]
            v = e[1].get(rule.attribute) if rule.attribute else " ".join("".join(e[3]).split())
            if v:
                values.append(v)
        values = values if rule.many else values[:1]
        out[name] = values or ([rule.default] if rule.default is not None else [])
    return out


def extracted(page: Column, spec: Spec) -> Column:
    """``map<string,array<string>>`` of a page's fields; a null page gives null. Equal pages of a batch are read once."""

    def call(pages: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(pages)
        values = [evaluate(p, spec) for p in distinct] + [None]
        return pd.Series([values[c] for c in codes], dtype=object)

    call.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, "map<string,array<string>>")(page)


def absolute_links(page: Column, base: Column) -> Column:
    """http(s) links of a page's anchors, relative ones resolved against ``base`` and without fragments; first occurrences only."""

    def call(pages: pd.Series, bases: pd.Series) -> pd.Series:
        out = []
        for p, b in zip(pages, bases, strict=True):
            links: dict[str, None] = {}
            if p is not None:
                tree = _Tree()
                tree.feed(p)
                for tag, own, _, _ in tree.elements:
                    if tag == "a" and own.get("href"):
                        link = urljoin(b or "", own["href"].strip()).split("#")[0]
                        if link.startswith(("http://", "https://")):
                            links[link] = None
            out.append(list(links))
        return pd.Series(out, dtype=object)

    call.__annotations__ = {"pages": pd.Series, "bases": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, "array<string>")(page, base)


def crawled(pages: DataFrame, spec: Spec) -> DataFrame:
    """``url, status, mark, title, text, fields, needs_script`` of fetched pages (url, status, page): only readable ones are extracted from."""
    state = page_status(F.col("status"), F.col("page"))
    rows = pages.select("url", state.alias("state"), challenge_mark(F.col("page")).alias("mark"), "page")
    ok = F.when(F.col("state") == "ok", F.col("page"))
    return rows.withColumn("fields", extracted(ok, spec)).select(
        "url", F.col("state").alias("status"), F.when(F.col("state") == "blocked", F.col("mark")).alias("mark"), page_title(ok).alias("title"), page_text(ok).alias("text"), "fields", F.coalesce(needs_script(ok), F.lit(False)).alias("needs_script")
    )
