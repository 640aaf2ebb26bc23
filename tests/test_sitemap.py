from __future__ import annotations

import time
from datetime import date, datetime
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from gleanframe.functions.dates import in_range, lastmod_date
from gleanframe.operators import dedupe, frontier, robots, sitemap

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
BODIES = [
    ("set", f"<?xml version='1.0'?><!-- c --><urlset {NS}><url><loc> http://a.example/1 </loc><lastmod>2024-01-02</lastmod><changefreq>daily</changefreq><priority>0.5</priority></url><url><lastmod>x</lastmod></url><url><loc>http://a.example/2</loc><lastmod/></url></urlset>"),
    ("index", f"<sitemapindex {NS}><sitemap><loc>http://a.example/s1</loc></sitemap></sitemapindex>"),
    ("broken", "<urlset><url><loc>http://a.example/3</loc></url><url><loc>http://a.example/3</loc>"),
    ("html", "<html><a href='http://a.example/4'>x</a></html>"),
    ("atom", "<feed xmlns='http://www.w3.org/2005/Atom'><id>http://a.example/5</id><link href='http://a.example/no'/><entry><id>urn:x</id></entry></feed>"),
    ("null", None),
    ("empty", " "),
    ("xxe", "<!DOCTYPE x [<!ENTITY e SYSTEM 'file:///etc/passwd'>]><urlset><url><loc>&e;</loc></url></urlset>"),
]


def test_scan(spark):
    df = spark.createDataFrame(BODIES, "url string, body string")
    got = sorted((r.sitemap, r.kind, r.loc, r.lastmod) for r in sitemap.scan(df).collect())
    assert got == [
        ("atom", "url", "http://a.example/5", None), ("broken", "url", "http://a.example/3", None), ("html", "url", "http://a.example/4", None),
        ("index", "sitemap", "http://a.example/s1", None), ("set", "url", "http://a.example/1", "2024-01-02"), ("set", "url", "http://a.example/2", None),
    ]
    assert sitemap.scan(df.where(F.lit(False))).count() == 0


def test_scan_in_time_by_size(spark):
    entries = "".join(f"<url><loc>http://a.example/{i}</loc><lastmod>2024-01-02</lastmod></url>" for i in range(25_000))
    bodies = [("set", f"<urlset>{entries}</urlset>"), ("broken", f"<urlset>{entries}"), ("index", f"<sitemapindex>{entries.replace('url>', 'sitemap>')}</sitemapindex>")]
    began = time.time()
    got = sitemap.scan(spark.createDataFrame(bodies, "url string, body string")).groupBy("sitemap", "kind").agg(F.countDistinct("loc").alias("n"), F.max("pos").alias("pos"), F.count("lastmod").alias("dates")).collect()
    assert sorted(map(tuple, got)) == [("broken", "url", 25_000, 24_999, 0), ("index", "sitemap", 25_000, 24_999, 0), ("set", "url", 25_000, 24_999, 25_000)]
    assert time.time() - began < 30


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<urlset><url><loc>http://a.example/?a&b</loc></url></urlset>", ["http://a.example/?a&b"]), ("\n<?xml version='1.0'?><urlset><url><loc>http://a.example/1</loc></url></urlset><!-- x --> <!-- y -->\n", ["http://a.example/1"]),
        ("<urlset xmlns:i='i'><url><loc><![CDATA[http://a.example/?x&y]]></loc><i:image><i:loc>http://i.example/</i:loc></i:image></url><x><url><loc>http://a.example/2</loc></url></x></urlset>", ["http://a.example/?x&y"]),
        ("<!-- a --><!-- b --><html><loc>http://a.example/3</loc></html>", ["http://a.example/3"]), ("<urlset><url/><url><loc> </loc></url></urlset>", []),
    ],
)
def test_scan_of_odd_bodies(spark, body, expected):
    assert [r.loc for r in sitemap.scan(spark.createDataFrame([("s", body)], "url string, body string")).collect()] == expected


def python_lastmod(s):
    for n, f in ((19, "%Y-%m-%dT%H:%M:%S"), (10, "%Y-%m-%d"), (7, "%Y-%m"), (4, "%Y")):
        try:
            return datetime.strptime(s.strip()[:n], f).date()
        except ValueError:
            pass
    return None


def test_lastmod(spark):
    values = ["2024-05-06", "2024-05-06T07:08:09+02:00", "2024-5-6", "2024-05", "2024", "2024garbage", "2024-13-01", "2024-0315", "junk", "", " 2024-05-06 ", "2024-02-30", "2024-05-06T25:00:00", "20240506", "0000-01-01", "99-01-01"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(lastmod_date(F.col("v"))).collect()] == [python_lastmod(v) for v in values]


def test_range(spark):
    df = spark.createDataFrame([(1, "2022-06-15"), (2, "2023-06-15"), (3, "2024-06-15"), (4, None)], "i int, lastmod string")

    def ids(*a, **k):
        return [r.i for r in df.where(in_range(lastmod_date(F.col("lastmod")), *a, **k)).orderBy("i").collect()]

    assert ids(None, None, strict=True) == [1, 2, 3, 4]
    assert ids(date(2023, 6, 15), None) == [2, 3, 4]
    assert ids(None, date(2023, 6, 15), strict=True) == [1, 2]
    assert ids(date(2023, 1, 1), date(2023, 12, 31), strict=True) == [2]


ROBOTS = "# c\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow:\nDisallow: /x%20y\n\nUser-agent: *\nDisallow: /late\n  SITEMAP: /s.xml\nSitemap: http://o.example/t.xml # note\n"


def test_robots_like_the_standard_library(spark):
    paths = ["/", "/a", "/a/b", "/ab", "/b", "/x y", "/late", "/a?q=1"]
    parser = RobotFileParser()
    parser.parse(ROBOTS.splitlines())
    rows = spark.createDataFrame([(p, f"http://h.example{p}") for p in paths] + [("none", "http://other.example/a"), ("null", None)], "p string, url string")
    bodies = spark.createDataFrame([("http://h.example", ROBOTS), ("http://other.example", None)], "base string, body string")
    got = {r.p: r.allowed for r in robots.allowed(rows, bodies).collect()}
    assert {p: got[p] for p in paths if p != "/x y"} == {p: parser.can_fetch("*", f"http://h.example{p}") for p in paths if p != "/x y"}
    assert got["none"] and got["null"]
    other = rows.select("p", robots.allowed_by(F.col("url"), ROBOTS).alias("allowed"))
    assert {r.p: r.allowed for r in other.collect() if r.p in paths} == {p: got[p] for p in paths}
    named = sorted(r.sitemap for r in robots.sitemap_directives(bodies).collect())
    assert named[0] == "http://h.example/s.xml" and len(named) == 2


def test_select_urls_order(spark):
    rows = spark.createDataFrame(
        [(1, "http://a.example/x/", None), (2, "http://A.example/x", "2024-01-01"), (3, "http://a.example/s.xml", None), (4, "http://b.example/y", None), (5, "http://a.example/y", "2020-01-01"), (6, None, None)],
        "seq int, url string, lastmod string",
    )
    assert [r.seq for r in sitemap.select_urls(rows, ["seq"]).orderBy("seq").collect()] == [1, 4, 5]
    assert [r.seq for r in sitemap.select_urls(rows, ["seq"], start=date(2023, 1, 1), include=["/*"], base="http://a.example").collect()] == [1]
    assert [r.seq for r in sitemap.select_urls(rows, ["seq"], limit=2).orderBy("seq").collect()] == [1, 4]
    assert [r.seq for r in sitemap.select_urls(rows, ["seq"], deduplicate=False).orderBy("seq").collect()] == [1, 2, 4, 5]


def test_dedupe_keeps_the_first_as_written(spark):
    rows = spark.createDataFrame([(2, "http://a.example/x#f"), (1, "HTTP://a.example/x/"), (3, "http://a.example/x"), (4, None), (5, None)], "seq int, url string")
    assert sorted((r.seq, r.url) for r in dedupe.dedupe_by_url(rows, ["seq"]).collect()) == [(1, "HTTP://a.example/x/"), (4, None)]
    assert sorted(r.seq for r in dedupe.dedupe_exact(rows, ["seq"]).collect()) == [1, 2, 4]
    assert dedupe.limit_in_order(rows, 0, ["seq"]).count() == 0


def test_tree(spark):
    bodies = [("root", "".join(["<sitemapindex><sitemap><loc>leaf</loc></sitemap><sitemap><loc>mid</loc></sitemap></sitemapindex>"])), ("leaf", "<urlset>" + "".join(f"<url><loc>http://a.example/{i}</loc></url>" for i in range(20)) + "</urlset>")]
    bodies.append(("mid", "<sitemapindex>" + "".join(f"<sitemap><loc>c{i}</loc></sitemap>" for i in range(50)) + "<sitemap><loc>root</loc></sitemap></sitemapindex>"))
    bodies += [(f"c{i}", f"<urlset><url><loc>http://a.example/c{i}</loc></url></urlset>") for i in range(50)]
    df = spark.createDataFrame(bodies, "url string, body string")
    roots = spark.createDataFrame([("root",)], "url string")
    assert frontier.sitemap_records(df, roots).count() == 70
    assert frontier.sitemap_records(df, roots, follow_index=False).count() == 0
    assert frontier.sitemap_records(df, roots, target=10).count() == 20
    assert frontier.sitemap_records(df, roots, target=21).count() == 70
    assert frontier.sitemap_records(df, spark.createDataFrame([("leaf",), ("leaf",)], "url string"), follow_index=False).count() == 20


@pytest.mark.parametrize("limit,depth,expected", [(None, 50, "abcde"), (2, 50, "abc"), (0, 50, "a"), (None, 1, "abc")])
def test_traverse(spark, limit, depth, expected):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "a", 0), ("b", "d", 1), ("c", "d", 0), ("d", "e", 0), ("x", "y", 0), (None, "z", 0), ("a", None, 2)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    got = frontier.traverse(edges, seeds, depth, limit).orderBy("depth", "url").collect()
    assert "".join(r.url for r in got) == expected
    if limit is None and depth > 3:
        assert {r.url: r.depth for r in got} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
        assert {r.url: r.parent for r in got}["d"] == "b"


def test_no_bound_of_depth_by_default(spark):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", f'<a href="/{i + 1}">next</a>') for i in range(53)], "page_id long, url string, html string")
    got = {r.url: r.depth for r in frontier.deep_links(pages, spark.createDataFrame([("http://a.example/0",)], "url string")).collect()}
    assert got == {f"http://a.example/{i}": i for i in range(1, 54)}
