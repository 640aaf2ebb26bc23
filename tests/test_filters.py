from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanframe.functions.text import cosine_to, term_frequency
from gleanframe.operators import filters as fl

ITEMS = [
    (1, "http://a.example/x.PDF", "The red fox", None, "t", "2024-01-05", None),
    (2, "http://a.example/x.pdf?y=1", "", "Body with a Fox", None, "", "2024-1-6"),
    (3, None, None, "", "Only title fox", "not-a-date", "2024-01-05"),
    (4, "http://a.example/x.c", " ", None, None, None, None),
    (5, "http://a.example/p.webp", "nothing", None, None, "2024-02-30", None),
]
SCHEMA = "id int, url string, text string, content string, title string, date string, filedate string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, SCHEMA)


def ids(df, f):
    return sorted(r.id for r in fl.keep(df, f).select("id").collect())


def test_resolve_takes_the_first_filled_field(items):
    got = {r.id: r.f for r in items.select("id", fl.resolve_field(items.columns, fl.TEXT_FIELDS).alias("f")).collect()}
    assert got == {1: "The red fox", 2: "Body with a Fox", 3: "Only title fox", 4: " ", 5: "nothing"}
    assert items.select(fl.resolve_field(items.columns, "absent")).first()[0] is None


def test_date(items):
    assert ids(items, fl.by_date("2024-01-01", "2024-01-31")) == [1, 2]
    assert ids(items, fl.by_date()) == [1, 2]
    assert ids(items, fl.by_date("2024-01-06")) == [2]
    with pytest.raises(ValueError):
        fl.by_date("2024/01/01")


def test_keywords(items):
    assert ids(items, fl.by_keywords(["FOX"])) == [1]
    assert ids(items, fl.by_keywords(["fox"], fl.TEXT_FIELDS)) == [1, 2, 3]
    assert ids(items, fl.by_keywords([])) == []
    assert ids(items, fl.by_keywords("%")) == []


def test_files(items):
    assert ids(items, fl.by_extension("pdf")) == [1]
    assert ids(items, fl.by_files(["pdf", "image"])) == [1, 5]
    assert ids(items, fl.by_files(["c"])) == [4]
    assert ids(items, fl.by_files([".c"])) == []


def test_not_admits_missing_fields(items):
    assert ids(items, fl.NOT(fl.by_keywords("fox"))) == [2, 3, 4, 5]
    assert ids(items, fl.NOT(fl.NOT(fl.by_keywords("fox")))) == [1]


def test_chains(items):
    assert ids(items, fl.AND()) == ids(items, fl.OR()) == ids(items, fl.FilterChain(mode="xor")) == [1, 2, 3, 4, 5]
    assert ids(items, fl.OR(fl.by_keywords("fox"), fl.by_extension("webp"))) == [1, 5]
    assert ids(items, fl.FilterChain().add(fl.by_date()).add(fl.by_extension("pdf"))) == [1]
    with pytest.raises(ValueError):
        fl.keep(items, fl.FilterChain(fl.by_date(), mode="xor"))


def test_own_filters(items):
    assert ids(items, fl.by_column(F.col("id") > 3)) == [4, 5]
    assert ids(items, fl.by_function(lambda r: bool(r["title"]), ["title"])) == [1, 3]


def test_cosine(spark, items):
    assert ids(items, fl.by_cosine_similarity("red fox", 0.5)) == [1]
    df = spark.createDataFrame([("a a b",), ("",), (None,), ("Ärger c",)], "t string")
    got = [r[0] for r in df.select(cosine_to(F.col("t"), "a b b")).collect()]
    assert got[0] == pytest.approx((2 * 1 + 1 * 2) / (5**0.5 * 5**0.5)) and got[1] == 0 and got[2] is None and got[3] == 0
    assert df.select(cosine_to(F.col("t"), "")).first()[0] == 0
    tf = {(r.t, r.term): r.tf for r in term_frequency(df, "t", "t").collect()}
    assert tf == {("a a b", "a"): 2, ("a a b", "b"): 1, ("Ärger c", "rger"): 1, ("Ärger c", "c"): 1}


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ids(df, fl.AND(fl.by_date(), fl.by_cosine_similarity("x"))) == []
    odd = spark.createDataFrame([(1, "fox", "z")], "id int, text string, `a.b` string")
    assert ids(odd, fl.by_keywords("fox")) == [1]
