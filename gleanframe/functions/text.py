"""Bag-of-words columns: tokens, term counts and cosine similarity."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what a token is, after lower-casing.
TOKEN = "[a-z0-9]+"


def tokens(text: Column) -> Column:
    """ASCII letters and digits in lower case, in order; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def term_frequency(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) in long form; counted with partial aggregation."""
    return df.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def cosine_to(text: Column, query: str) -> Column:
    """Cosine of the text's and the query's term counts, on the row: no join, no shuffle. 0 where either has no term,
    null for null. Counting needs state a row, which the JVM's array functions only have interpreted; Arrow batches
    are an order of magnitude faster.
    """
    terms = Counter(re.findall(TOKEN, query.lower()))
    norm = math.sqrt(sum(v * v for v in terms.values()))
    token = re.compile(TOKEN)

    def one(s: str | None) -> float | None:
        if s is None:
            return None
        own = Counter(token.findall(s.lower()))
        dot = sum(own[t] * n for t, n in terms.items())
        return dot / (math.sqrt(sum(n * n for n in own.values())) * norm) if dot else 0.0

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(s) for s in texts], dtype="float64")

    return F.when(text.isNotNull(), run(text))


def extract_text(text: Column, raw_text: Column) -> Column:
    """The text of a result, else its raw text, else nothing."""
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(raw_text, F.lit("")), F.lit(""))
