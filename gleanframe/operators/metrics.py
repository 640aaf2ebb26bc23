"""Figures of extraction runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters below which a result has likely failed.
MIN_CHARS = 80


def strategy_stats(results: DataFrame, strategy_col: str = "strategy", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per strategy: pages, successes (some text), likely failures (shorter than ``min_chars``), mean and median length.

    Null and empty texts are no successes; means and medians are over successes, null without any. The median is
    exact; lengths are counted by value first, so its state is bounded by the longest text.
    """
    n = F.length(F.coalesce(text_col, F.lit("")))
    ok = n > 0
    return results.groupBy(F.col(strategy_col).alias("strategy")).agg(
        F.count("*").alias("pages"), F.count_if(ok).alias("succeeded"), F.count_if(ok & (n < min_chars)).alias("likely_failed"),
        F.avg(F.when(ok, n)).alias("avg_length"), F.median(F.when(ok, n)).alias("median_length"),
    ).withColumn("success_rate", F.col("succeeded") / F.col("pages")).withColumn("likely_failed_rate", F.col("likely_failed") / F.col("pages"))


def navigations_per_page(navigations: DataFrame, url_col: str = "url") -> DataFrame:
    """One row: navigations, different pages, and their ratio (null without pages)."""
    return navigations.agg(F.count(url_col).alias("navigations"), F.countDistinct(url_col).alias("pages")).withColumn("per_page", F.col("navigations") / F.nullif(F.col("pages"), F.lit(0)))


def round_robin(rows: DataFrame, choices: list[str], position_col: str = "pos") -> DataFrame:
    """``rows`` with ``choice``: the choices in turn by position (from 0); null where there are none."""
    if not choices:
        return rows.withColumn("choice", F.lit(None).cast("string"))
    return rows.withColumn("choice", F.element_at(F.array(*map(F.lit, choices)), (F.pmod(F.col(position_col), F.lit(len(choices))) + 1).cast("int")))


def random_choice(rows: DataFrame, choices: list[str], seed: int = 0, position_col: str = "pos") -> DataFrame:
    """``rows`` with ``choice``: one of the choices at random, the same for a position and seed; null where there are none."""
    if not choices:
        return rows.withColumn("choice", F.lit(None).cast("string"))
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(position_col)), F.lit(len(choices)))
    return rows.withColumn("choice", F.element_at(F.array(*map(F.lit, choices)), (at + 1).cast("int")))


def requested_stats(requested: DataFrame, results: DataFrame, url_col: str = "url", text_col: str = "text", seconds: float | None = None) -> DataFrame:
    """One row: different addresses asked for, those with some text among the results, their share, and pages a second.

    Addresses without a result, and those whose results have no text, count as failures; repeated ones count once, null
    ones not at all. ``pages_per_second`` is null without ``seconds``, the share is null if nothing was asked for.
    """
    asked = requested.select(F.col(url_col).alias("url")).dropna().distinct()
    good = results.where(F.length(text_col) > 0).select(F.col(url_col).alias("_url")).distinct()
    out = asked.join(good, F.col("url") == F.col("_url"), "left").agg(F.count("url").alias("requested"), F.count("_url").alias("succeeded"))
    rate = F.lit(None).cast("double") if not seconds else F.col("succeeded") / F.lit(float(seconds))
    return out.withColumn("success_rate", F.col("succeeded") / F.nullif(F.col("requested"), F.lit(0))).withColumn("pages_per_second", rate)
