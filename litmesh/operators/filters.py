"""The filter language: `field: a, "b", ~c, >2010`, compiled to one Column that Catalyst optimises."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "author", "year", "publication", "type", "tag", "collection", "cluster")
YEAR = r"\d{4}"


@dataclass(frozen=True)
class Term:
    op: str  # is, contains, range
    value: str = ""
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Filter:
    field: str | None
    terms: tuple[Term, ...]


def _pieces(text: str) -> list[tuple[str, bool, bool]]:
    """The comma-separated terms as (text, quoted, tilde); a doubled quote within quotes is a quote."""
    out, at = [], 0
    for m in re.finditer(r'\s*(~?)\s*(?:"((?:[^"]|"")*)"?|([^,"]*))\s*(?:,|$)', text):
        if m.end() == m.start() and at:
            continue
        at = 1
        quoted = m[2] is not None
        value = m[2].replace('""', '"') if quoted else (m[3] or "").strip()
        if value.strip():
            out.append((value if quoted else value.strip(), quoted, bool(m[1])))
    return out


def _years(text: str) -> Term | None:
    if m := re.fullmatch(rf"({YEAR})\s*(?:-|\.\.|–)\s*({YEAR})", text):
        a, b = sorted((int(m[1]), int(m[2])))
        return Term("range", low=a, high=b)
    if m := re.fullmatch(rf"(>=|<=|>|<|=)?\s*({YEAR})", text):
        y = int(m[2])
        return {">": Term("range", low=y + 1), ">=": Term("range", low=y), "<": Term("range", high=y - 1), "<=": Term("range", high=y)}.get(m[1] or "=", Term("range", low=y, high=y))
    return None


def parse(text: str) -> Filter:
    """One filter: the field before the first colon if there is such a field, and its terms, each once."""
    head, colon, rest = text.partition(":")
    field = head.strip().lower() if colon and head.strip().lower() in FIELDS else None
    terms: dict[Term, None] = {}
    for value, quoted, tilde in _pieces(rest if field else text):
        ranged = _years(value) if field == "year" and not quoted and not tilde else None
        terms[ranged or Term("is" if quoted and not tilde else "contains", value.lower())] = None
    return Filter(field, tuple(terms))


def show(f: Filter) -> str:
    """The text of a filter; parsing it gives the filter again."""
    quote = lambda v: '"' + v.replace('"', '""') + '"'

    def one(t: Term) -> str:
        if t.op == "range":
            if t.low == t.high:
                return str(t.low)
            return f">={t.low}" if t.high is None else f"<={t.high}" if t.low is None else f"{t.low}-{t.high}"
        return quote(t.value) if t.op == "is" else f"~{quote(t.value)}"

    return (f"{f.field}: " if f.field else "") + ", ".join(map(one, f.terms))


def _term(field: str, t: Term) -> Column:
    if t.op == "range":
        if field != "year":
            return F.lit(False)
        y = lambda x: x.cast("int")
        return F.exists(field, lambda x: (y(x) >= t.low if t.low is not None else F.lit(True)) & (y(x) <= t.high if t.high is not None else F.lit(True)))
    return F.exists(field, (lambda x: F.lower(x) == t.value) if t.op == "is" else (lambda x: F.lower(x).contains(t.value)))


def predicate(f: Filter) -> Column:
    """Any of the terms; without a field, in any facet. No term lets everything pass."""
    if not f.terms:
        return F.lit(True)
    return F.coalesce(reduce(lambda a, b: a | b, (_term(field, t) for t in f.terms for field in ([f.field] if f.field else FIELDS))), F.lit(False))


def matching(facets: DataFrame, filters: list[Filter], skip: int | None = None) -> DataFrame:
    """Rows that every filter lets pass, the one at `skip` left out."""
    return facets.where(reduce(lambda a, b: a & b, (predicate(f) for i, f in enumerate(filters) if i != skip), F.lit(True)))


def needs_clusters(filters: list[Filter]) -> bool:
    """Whether the costly cluster facet is asked for."""
    return any(f.field in (None, "cluster") and f.terms for f in filters)


def completions(facet_counts: DataFrame, typed: str, *, field: str | None = None, limit: int = 12, chosen: tuple[str, ...] = ()) -> DataFrame:
    """(field, value, items): values that hold what is typed, most common first; the last place is left for the free text."""
    c = facet_counts.where(F.lower("value").contains(typed.lower()) & ~F.col("value").isin(*chosen) if chosen else F.lower("value").contains(typed.lower()))
    c = c.where(F.col("field") == field) if field else c.where("field <> 'title'")
    return c.orderBy(F.desc("items"), "value", "field").limit(limit - 1)


def search(nodes: DataFrame, text: str, columns: tuple[str, ...], limit: int = 10) -> DataFrame:
    """Nodes that hold every word and quoted phrase of the text, in order of key."""
    wanted = [a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', text.lower())]
    hay = F.lower(F.concat_ws(" ", *columns))
    return nodes.where(reduce(lambda a, b: a & b, (hay.contains(w) for w in wanted), F.lit(True))).orderBy("key").limit(limit)
