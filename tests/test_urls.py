from __future__ import annotations

import re
from fnmatch import translate
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from gleanframe.functions import urls
from gleanframe.operators import links

URLS = [
    "HTTPS://WWW.Example.example/A/b/?q=1#top", "http://a.example", "http://a.example/", "http://a.example//x//", "/rel/path", "mailto:a@b.example", "", "  http://b.example/x  ",
    "https://c.example:8443/p;v=1?x=/y#", "//d.example/q", "http://e.example?x=1", "http://a.example.evil/x", "ftp://f.example/ü ä", "http://[::1]:80/x",
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_split_like_the_standard_library(spark):
    assert column(spark, URLS, urls.netloc) == [urlsplit(u).netloc for u in URLS]
    assert column(spark, URLS[:7], urls.query) == [urlsplit(u).query for u in URLS[:7]]


def test_normalize(spark):
    def reference(u: str) -> str:
        p = urlsplit(u.strip())
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") or "/", p.query, ""))

    cases = [u for u in URLS if "://" in u]
    assert column(spark, cases, urls.normalize) == [reference(u) for u in cases]
    assert column(spark, [None], urls.normalize) == [None]


def test_base_and_site(spark):
    assert column(spark, ["a.example", "http://a.example/x?y"], urls.normalize_base) == ["https://a.example", "http://a.example"]
    assert column(spark, ["https://WWW.A.example:8080/x", "http://u:p@b.example/", "x", None], urls.site) == ["a.example", "b.example", None, None]


def test_origins(spark):
    df = spark.createDataFrame([("http://a.example/x", "https://A.example/y"), ("http://a.example", "http://www.a.example"), (None, "http://a.example")], "a string, b string")
    rows = df.select(urls.same_origin_loose(F.col("a"), F.col("b")), urls.same_origin_strict(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, False), (False, False)]


@pytest.mark.parametrize("pattern", ["/news/*", "*/202[!4]/*", "/?/x", "/[ab]*.html", "*", "/a[", "/a+b(c)", "/[]x]*", "/x.y"])
def test_glob_like_fnmatch(spark, pattern):
    paths = ["/news/", "/news/a/b", "/en/2023/x", "/en/2024/x", "/a/x", "/ab/x", "/b.html", "/c.html", "/a[", "/a+b(c)", "/]x", "/xzy", "/x.y", "", "/x.y\n"]
    expected = [re.match(translate(pattern), p) is not None for p in paths]
    assert column(spark, paths, lambda c: c.rlike(urls.glob_regex(pattern))) == expected


def test_glob_scope(spark):
    df = spark.createDataFrame([("http://a.example/x/1",), ("http://b.example/x/1",), (None,)], "l string")
    got = df.select(urls.glob_match(F.col("l"), F.lit("http://a.example"), ["/x/*"]), urls.glob_match(F.col("l"), F.lit("http://a.example"), None)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False)]


HREFS = [
    "/x", "y", "../z", "?q=2", "#f", "//h.example/p", "http://o.example/p#f", "/a/../b", "/a/./b", "mailto:m@n.example", "", "http://o.example", "g;x=1/../y", "..", ".", "./", "../../../w", "/..", "/a//b", "x//y", "javascript:void(0)", "a/b/../../c?d=../e#../f", "y?", " /lead ",
]


@pytest.mark.parametrize("base", ["http://a.example/d/page.html?x=1", "http://a.example", "https://a.example/d/e/", "http://a.example/d//e/f"])
def test_resolve_like_urljoin(spark, base):
    df = spark.createDataFrame([(i, base, h) for i, h in enumerate(HREFS)], "i int, b string, h string").orderBy("i")
    assert [r[0] for r in df.select(links.resolve(F.col("b"), F.col("h"))).collect()] == [urljoin(base, h.strip()) for h in HREFS]
    assert [r[0] for r in df.select(urls.defrag(links.resolve(F.col("b"), F.col("h")))).collect()] == [urldefrag(urljoin(base, h.strip()))[0] for h in HREFS]
    plan = df.select(links.resolve(F.col("b"), F.col("h")))._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert df.select(links.resolve(F.lit(None).cast("string"), F.col("h"))).distinct().count() >= 1


def test_sitemap_kinds(spark):
    values = ["http://a.example/S.XML", "http://a.example/x.xml.gz?y", "http://a.example/sitemap", "http://a.example/x?f=.xml", None]
    assert column(spark, values, urls.is_xml) == [True, True, False, False, False]
    assert column(spark, values, urls.looks_like_sitemap) == [True, True, True, False, False]
