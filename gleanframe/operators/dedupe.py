"""Distinct addresses in order of discovery, and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``, unchanged. Null keys form one group.

    The winner is picked by partial aggregation, so a key that most rows share is reduced before it moves. ``order``
    must tell the rows of a key apart for the choice to be certain; rows equal in it may tie.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(key.alias("_key")).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def dedupe_by_url(df: DataFrame, order: list[str], url_col: str = "url") -> DataFrame:
    """The first record of each normalised address, with its address as written."""
    return first_wins(df, urls.normalize(F.col(url_col)), order)


def dedupe_exact(df: DataFrame, order: list[str], url_col: str = "url") -> DataFrame:
    """The first record of each address after its fragment is dropped; a trailing slash makes another address."""
    return first_wins(df, urls.defrag(F.col(url_col)), order)


def limit_in_order(df: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first ``n`` rows in order; all where ``n`` is None."""
    return df if n is None else df.orderBy(*order).limit(max(0, n))
