from __future__ import annotations

import gzip
import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.operators import extract, links, metrics
from gleanframe.schema import spark_type, strict_schema
from gleanframe.sinks import files
from gleanframe.sources import corpus

HTML = """<html lang="de"><head><title> A &amp; B
</title><script>var x='</p><article>no</article>';</script></head><body><nav class="menu main">Menu <div>in</div></nav>
<!-- <article>hidden</article> --><article><h1>Head</h1><p>One <b>two<br>three</p><ul><li>x<li>y</ul><a href="/l">link</a></article><div id="ad">buy</div></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "http://a.example/1", HTML), (2, "http://a.example/2", "<html></html>"), (3, "http://a.example/3", None), (4, None, "plain")], "page_id long, url string, html string")


def test_heuristic(pages):
    got = {r.url: r for r in extract.heuristic(pages).collect()}
    one = got["http://a.example/1"]
    assert (one.title, one.lang, one.text) == ("A &amp; B", "de", "Head One two three x y link")
    assert "buy" in one.raw_text and "hidden" not in one.raw_text
    assert set(got) == {"http://a.example/1", None}


def test_exclude(pages):
    row = pages.where("page_id = 1").select(extract.text_of(extract.without_elements(extract.visible(F.col("html")), [".menu", "#ad", "article"]))).first()
    assert "buy" not in row[0] and "Head" not in row[0] and "Menu" not in row[0]


@pytest.mark.parametrize("kind,start", [("json", '{"text":"Head'), ("markdown", "# A"), ("xml", "<doc"), ("xmltei", "<TEI")])
def test_formats(pages, kind, start):
    got = {r.url: r.result for r in extract.formatted(extract.heuristic(pages.where("page_id = 1")), kind).collect()}
    assert got["http://a.example/1"].startswith(start)
    if kind == "json":
        assert json.loads(got["http://a.example/1"])["lang"] == "de"


def test_format_unknown(pages):
    with pytest.raises(ValueError):
        extract.formatted(extract.heuristic(pages), "pdf")


def test_markdown(pages):
    text = extract.to_markdown("<h2>T</h2><p>a <b>b</b> <i>c</i></p><ul><li>x<ul><li>y</li></ul></li></ul><nav><nav>n</nav>m</nav><p>e&amp;f <a href='u'>l</a></p>", ["nav"])
    assert text == "## T\n\na **b** *c*\n\n- x\n  - y\n\ne&f [l](u)"
    assert extract.to_markdown("<script>x</script>") is None and extract.to_markdown(None) is None
    assert extract.to_markdown("<div class='x y'>a<div>b</div></div>c<p id=z>d</p>", [".y", "#z"]) == "c"
    assert {r.url for r in extract.markdownify(pages).collect()} == {"http://a.example/1", None}


def test_model_records(pages):
    shape = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("n", T.LongType())])

    def generate(prompt, schema):
        if "Head" in prompt:
            return '{"name": "x", "n": 3}'
        return '{"n": 1}'

    rows = extract.model_records(pages, shape, generate).collect()
    assert [(r.url, r.result.name, r.result.n) for r in rows] == [("http://a.example/1", "x", 3)]


def test_parse_records(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, "{}"), (3, "junk"), (4, None), (5, '{"k": "x"}')], "i int, j string")
    assert [r.i for r in extract.parse_records(df, T.StructType([T.StructField("k", T.LongType(), False)]), "j").collect()] == [1]


def test_wraps(spark, pages):
    content = extract.heuristic(pages.where("page_id = 1"))
    assert extract.wrap_scrape(content).first().result.title == "A &amp; B"
    plain = spark.createDataFrame([("u", "t"), ("v", None)], "url string, result string")
    assert [r.url for r in extract.wrap_scrape(plain).collect()] == ["u"]
    assert extract.wrap_crawl(plain).columns == ["text", "url"]


def test_shallow_links(spark):
    html = "<a href='/x'>1</a><a href=\"http://a.example/x#f\">2</a><a href='http://a.example/p/'>self</a><a href='https://a.example/s'>3</a><a href='http://b.example/'>o</a><a href='mailto:x@a.example'>m</a><a href='javascript:void(0)'>j</a><link href='/css'>"
    pages = spark.createDataFrame([(1, "http://a.example/p", html), (2, "http://a.example/q", None)], "page_id long, url string, html string")
    assert sorted(r.link for r in links.shallow_links(pages).collect()) == ["http://a.example/x", "https://a.example/s"]
    assert [r.link for r in links.shallow_links(pages, limit=1).collect()] == ["http://a.example/x"]
    assert links.shallow_links(pages, limit=0).count() == 0
    assert [r.link for r in links.shallow_links(pages, exclude=["/x"]).collect()] == ["https://a.example/s"]


def test_strict_schema():
    given = {"$defs": {"A": {"properties": {"q": {"type": "string", "default": "z"}}}}, "properties": {"a": {"$ref": "#/$defs/A"}, "b": {"type": "array", "items": {"type": "integer"}}}, "required": ["b"]}
    out = strict_schema(given)
    assert out["required"] == ["a", "b"] and out["additionalProperties"] is False
    assert out["properties"]["a"] == {"anyOf": [{"$ref": "#/$defs/A"}, {"type": "null"}]}
    assert out["$defs"]["A"]["properties"]["q"] == {"anyOf": [{"type": "string"}, {"type": "null"}]}
    shape = spark_type({"type": "object", **out})
    assert shape["b"].dataType == T.ArrayType(T.LongType()) and not shape["b"].nullable and shape["a"].nullable


def test_bytes(spark):
    packed = gzip.compress(b"hello")
    assert corpus.unzip(packed) == b"hello" and corpus.unzip(b"raw") == b"raw" and corpus.unzip(None) is None
    assert corpus.unzip(packed, limit=3) == packed
    df = spark.createDataFrame([("a.xml.gz", bytearray(packed)), ("b.xml", bytearray(b"\xef\xbb\xbfhi")), ("c", bytearray(b"\xff")), (None, None)], "url string, body binary")
    got = {r.url: r.t for r in corpus.unzipped(df).select("url", corpus.decode_text(F.col("body")).alias("t")).collect()}
    assert got == {"a.xml.gz": "hello", "b.xml": "hi", "c": "ÿ", None: None}


def test_fetcher_source(spark):
    def fetch(url):
        if url == "bad":
            raise OSError("no")
        return None if url == "gone" else url.encode()

    spark.dataSource.register(corpus.fetcher_source(fetch, "fetched_test"))
    got = spark.read.format("fetched_test").option("urls", "a\nbad\ngone\nb").load().collect()
    assert sorted((r.url, bytes(r.body)) for r in got) == [("a", b"a"), ("b", b"b")]


def test_writers(spark, tmp_path: Path):
    df = spark.createDataFrame([("é", 1, None), ("b", None, date(2024, 1, 2))], "a string, b int, c date").coalesce(1)
    files.dump_json(df, tmp_path / "x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == [{"a": "é", "b": 1, "c": None}, {"a": "b", "b": None, "c": "2024-01-02"}]
    assert "é" in (tmp_path / "x.json").read_text()
    files.dump_json(df.limit(0), tmp_path / "e.json")
    assert json.loads((tmp_path / "e.json").read_text()) == []
    files.dump_jsonl({"s": {2, 1}, "p": Path("/x")}, tmp_path / "x.jsonl")
    assert (tmp_path / "x.jsonl").read_text() == '{"s": [1, 2], "p": "/x"}\n'
    files.dump_csv([{"a": 1}, {"b": 2, "a": 3}], tmp_path / "x.csv")
    assert (tmp_path / "x.csv").read_text().splitlines() == ["a,b", "1,", "3,2"]
    files.dump_csv([], tmp_path / "none.csv")
    assert not (tmp_path / "none.csv").exists()
    files.dump_txt("t", tmp_path / "x.txt")
    with pytest.raises(TypeError):
        files.dump_json([object()], tmp_path / "y.json")
    files.write_jsonl(df, str(tmp_path / "dist"))
    assert spark.read.json(str(tmp_path / "dist")).count() == 2
    files.write_csv(df.limit(0), str(tmp_path / "nocsv"))
    assert not (tmp_path / "nocsv").exists()


def test_stats(spark):
    df = spark.createDataFrame([("a", "x" * 100), ("a", "x"), ("a", None), ("b", "")], "strategy string, text string")
    got = {r.strategy: r for r in metrics.strategy_stats(df).collect()}
    assert (got["a"].pages, got["a"].succeeded, got["a"].likely_failed, got["a"].avg_length, got["a"].median_length) == (3, 2, 1, 50.5, 50.5)
    assert got["b"].succeeded == 0 and got["b"].avg_length is None
    assert [r.choice for r in metrics.round_robin(spark.range(4).withColumnRenamed("id", "pos"), ["x", "y"]).collect()] == ["x", "y", "x", "y"]


@pytest.mark.parametrize(
    ("html", "selectors", "left"),
    [
        ("<div class=ad><div>in</div>LEAK</div><p>stay</p>", [".ad"], " <p>stay</p>"), ("<nav>a<nav>b</nav>LEAK</nav>x", ["nav"], " x"), ("<nav>a</nav>x<nav>b</nav>y", ["nav"], " x y"),
        ("<section id='x y'>k</section><article id=x>g</article>", ["#x"], "<section id='x y'>k</section> "), ("<p class='big ad-free'>k</p><p class='ad big'>g</p>", [".ad"], "<p class='big ad-free'>k</p> "),
        ("<div class=ad>open", [".ad"], "<div class=ad>open"), ("a<img class=ad src=x>b<br class='ad'/>c", [".ad"], "a b c"), (None, [".ad"], None), ("", [".ad", "nav"], ""), ("no ad here", [".ad"], "no ad here"),
    ],
)
def test_elements_with_nested_ones(spark, html, selectors, left):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(extract.without_elements(F.col("h"), selectors)).first()[0] == left


def test_get_like_a_client():
    tries, slept = [], []

    def server(url):
        tries.append(url)
        n = len(tries)
        if url == "gone":
            return corpus.Response(404)
        if url == "late":
            return corpus.Response(429) if n < 3 else corpus.Response(200, b"x")
        if url == "bad":
            raise OSError("no way")
        return corpus.Response(200, gzip.compress(b"y"), "GZIP") if url == "packed" else None if url == "none" else gzip.compress(b"z")

    def ask(url, **options):
        tries.clear(), slept.clear()
        return corpus.get(url, server, sleep=slept.append, **options), len(tries), list(slept)

    assert ask("gone", retries=5) == (None, 1, []) and ask("none", retries=5) == (None, 1, [])
    assert ask("late", retries=3, delay=0.5) == (b"x", 3, [0.5, 1.0]) and ask("late", retries=2, delay=1.0) == (None, 2, [1.0])
    assert ask("bad", retries=2) == (None, 2, [0.0]) and ask("packed") == (b"y", 1, []) and ask("a.gz")[0] == b"z"


def test_fetched_where_the_queue_is(spark):
    queue = spark.createDataFrame([("a",), ("b",), (None,), ("gone",), ("a",)], "url string")
    got = sorted((r.url, bytes(r.body)) for r in corpus.fetched(queue, lambda u: None if u == "gone" else u.encode() * 2, parts=2).collect())
    assert got == [("a", b"aa"), ("a", b"aa"), ("b", b"bb")] and corpus.fetched(queue.limit(0), lambda u: b"x").count() == 0
