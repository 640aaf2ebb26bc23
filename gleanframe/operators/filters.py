"""Composable content filters: two-valued Column predicates, false where the field is missing.

A filter maps the names of the columns at hand to a Column; ``keep`` applies one to a DataFrame. Every leaf is made
two-valued before it is negated, so ``NOT`` admits rows whose field is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cosine_to

Filter = Callable[[Sequence[str]], Column]

# The columns that hold a record's text, date and address, in order of preference.
TEXT_FIELDS = ("text", "content", "title")
DATE_FIELDS = ("date", "filedate")
URL_FIELD = "url"

# Extensions by kind of file.
FILE_TYPES = {"pdf": (".pdf",), "docx": (".docx",), "image": (".png", ".jpg", ".jpeg", ".webp", ".gif"), "text": (".txt", ".md")}


def resolve_field(columns: Sequence[str], fields: str | Sequence[str]) -> Column:
    """The first of ``fields`` that is there and neither null nor empty; white space is content."""
    names = [fields] if isinstance(fields, str) else list(fields)
    found = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def closed(predicate: Column) -> Column:
    """Two-valued: null is false."""
    return F.coalesce(predicate, F.lit(False))


def _bound(value: str | date | None) -> date | None:
    return datetime.strptime(value, "%Y-%m-%d").date() if isinstance(value, str) else value


def by_date(start: str | date | None = None, end: str | date | None = None, fields: str | Sequence[str] = DATE_FIELDS) -> Filter:
    """The first filled date field is a whole ``YYYY-MM-DD`` within the bounds, inclusive.

    A bound that isn't a date raises here. A filled field that isn't a date is false; later fields aren't asked.
    """
    low, high = _bound(start), _bound(end)

    def build(columns: Sequence[str]) -> Column:
        raw = resolve_field(columns, fields)
        day = F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z"), F.try_to_date(raw, "yyyy-M-d"))
        ok = day.isNotNull() & (F.year(day) >= 1)
        if low is not None:
            ok = ok & (day >= F.lit(low))
        if high is not None:
            ok = ok & (day <= F.lit(high))
        return closed(ok)

    return build


def by_keywords(keywords: str | Sequence[str], field: str | Sequence[str] = "text") -> Filter:
    """Any of the keywords occurs in the field, letter case aside; no keywords, no rows."""
    words = [w.lower() for w in ([keywords] if isinstance(keywords, str) else keywords)]

    def build(columns: Sequence[str]) -> Column:
        text = F.lower(resolve_field(columns, field))
        return closed(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])) if words else F.lit(False)

    return build


def by_extension(extensions: str | Sequence[str], field: str | Sequence[str] = URL_FIELD) -> Filter:
    """The address ends in one of the extensions (with or without a dot), letter case aside; a query hides it."""
    ends = [e.lower() if e.startswith(".") else "." + e.lower() for e in ([extensions] if isinstance(extensions, str) else extensions)]

    def build(columns: Sequence[str]) -> Column:
        url = F.lower(resolve_field(columns, field))
        return closed(reduce(lambda a, b: a | b, [url.endswith(e) for e in ends])) if ends else F.lit(False)

    return build


def by_files(types: str | Sequence[str], field: str | Sequence[str] = URL_FIELD) -> Filter:
    """``by_extension`` by kinds of files; an unknown kind is taken as an extension behind a dot of its own."""
    ends = [e for t in ([types] if isinstance(types, str) else types) for e in FILE_TYPES.get(t.lower(), ("." + t.lower(),))]
    return by_extension(ends, field)


def by_cosine_similarity(query: str, threshold: float = 0.25, fields: str | Sequence[str] = TEXT_FIELDS) -> Filter:
    """Bag-of-words cosine of the query and the first filled field is at least the threshold."""

    def build(columns: Sequence[str]) -> Column:
        return closed(cosine_to(resolve_field(columns, fields), query) >= F.lit(threshold))

    return build


def by_column(predicate: Column) -> Filter:
    return lambda columns: closed(predicate)


def by_function(predicate: Callable[[dict], bool], fields: Sequence[str]) -> Filter:
    """Any Python predicate over the given fields, in Arrow batches; use the others where they can say it."""

    def build(columns: Sequence[str]) -> Column:
        names = [f for f in fields if f in columns]

        @F.pandas_udf(T.BooleanType())
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([bool(predicate(r)) for r in rows.to_dict("records")], dtype=bool)

        return closed(run(F.struct(*names)))

    return build


class FilterChain:
    """Filters in sequence; ``mode`` AND or OR. An empty chain accepts, an unknown mode raises when used with filters."""

    def __init__(self, *filters: Filter, mode: str = "AND"):
        self.filters, self.mode = list(filters), mode.upper()

    def add(self, f: Filter) -> FilterChain:
        self.filters.append(f)
        return self

    def __call__(self, columns: Sequence[str]) -> Column:
        parts = [f(columns) for f in self.filters]
        if not parts:
            return F.lit(True)
        if self.mode not in ("AND", "OR"):
            raise ValueError(f"mode must be AND or OR, not {self.mode}")
        return reduce((lambda a, b: a & b) if self.mode == "AND" else (lambda a, b: a | b), parts)


def AND(*filters: Filter) -> FilterChain:
    return FilterChain(*filters, mode="AND")


def OR(*filters: Filter) -> FilterChain:
    return FilterChain(*filters, mode="OR")


def NOT(f: Filter) -> Filter:
    return lambda columns: ~closed(f(columns))


def keep(df: DataFrame, f: Filter | None) -> DataFrame:
    return df if f is None else df.where(f(df.columns))


