from __future__ import annotations

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gleanframe.__main__ import main
from gleanframe.operators import filters as fl
from gleanframe.operators import frontier, metrics
from gleanframe.plans.engine import Crawler, LinkExtractor, Scraper, SiteMap, register_strategy, timed
from gleanframe.sources import models
from gleanframe.settings import LLMSettings, ProxySettings, Settings, SitemapSettings
from gleanframe.streaming import results

BASE = "http://a.example"


def page(links: str, words: str) -> str:
    return f"<html><title>{words}</title><body><article>{words}</article>" + "".join(f"<a href='{x}'>x</a>" for x in links.split()) + "</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (BASE + "/", page("/a /b /skip/x http://a.example.evil/ http://b.example/", "home")), (BASE + "/a", page("/c /a#f", "fox one")), (BASE + "/b", page("/ /d", "dog")),
        (BASE + "/c", page("/e", "fox two")), (BASE + "/d", page("", "fox three")), (BASE + "/skip/x", page("", "fox hidden")),
    ]
    return spark.createDataFrame(rows, "url string, html string").withColumn("page_id", F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def tables(spark):
    robots = spark.createDataFrame([(BASE, "User-agent: *\nDisallow: /no\nSitemap: /s.xml")], "base string, body string")
    maps = spark.createDataFrame(
        [(BASE + "/s.xml", f"<sitemapindex><sitemap><loc>{BASE}/t.xml</loc></sitemap></sitemapindex>"), (BASE + "/t.xml", "<urlset>" + "".join(f"<url><loc>{BASE}{p}</loc><lastmod>{m}</lastmod></url>" for p, m in (("/x", "2024-01-01"), ("/x/", "2024-02-01"), ("/no/1", "2024-01-01"), ("/y", "2020-01-01"), ("/z.xml", "2024-01-01"))) + "</urlset>")],
        "url string, body string",
    )
    return robots, maps


def urls(df):
    return sorted(r.url.removeprefix(BASE) for r in df.collect())


def test_link_extractor(spark, pages):
    with LinkExtractor(spark, pages) as e:
        assert urls(e.run(BASE + "/")) == ["/", "/a", "/b", "/c", "/d", "/e", "/skip/x"]
        assert sorted(e.stream(BASE + "/"))[0] == BASE + "/"
    with LinkExtractor(spark, pages, Settings(exclude_link_patterns=["/skip/*"], link_extraction_limit=3)) as e:
        assert urls(e.run(BASE + "/")) == ["/a", "/b", "/c"] or len(urls(e.run(BASE + "/"))) == 3
    shallow = LinkExtractor(spark, pages, Settings(link_extraction_strategy="shallow"))
    assert urls(shallow.run(BASE + "/")) == ["/a", "/b", "/skip/x"]
    with pytest.raises(AssertionError):
        shallow.stream(BASE + "/")
    assert LinkExtractor(spark, pages, Settings(link_extraction_limit=0)).run(BASE + "/").count() == 0


def test_crawler(spark, pages):
    with Crawler(spark, pages, Settings(exclude_link_patterns=["/skip/*"])) as c:
        assert urls(c.run(BASE + "/")) == ["/", "/a", "/b", "/c", "/d"]
        assert urls(c.run(BASE + "/", fl.by_keywords("fox"))) == ["/a", "/c", "/d"]
        assert urls(c.run(BASE + "/", fl.by_keywords("fox"), limit=1)) == ["/a"]
        assert len(list(c.stream(BASE + "/"))) == 5
    with pytest.raises(RuntimeError):
        c.run(BASE + "/")


def test_scraper(spark, pages):
    with Scraper(spark, pages) as s:
        rows = s.run([BASE + "/a", BASE + "/a", BASE + "/none"]).collect()
        assert [r.result.text for r in rows] == ["fox one", "fox one"]
    with Scraper(spark, pages, Settings(scraping_strategy="markdownify")) as s:
        assert "fox one" in s.run(BASE + "/a").first().result.text
    with Scraper(spark, pages, Settings(scraping_output_format="xml")) as s:
        assert s.run(BASE + "/a").first().result.startswith("<doc")
    shape = {"type": "object", "properties": {"t": {"type": "string"}}, "required": ["t"]}
    with Scraper(spark, pages, Settings(scraping_strategy="genai", genai=LLMSettings(shape, lambda p, s: '{"t": "ok"}'))) as s:
        assert s.run(BASE + "/a").first().result.t == "ok" or s.run(BASE + "/a").first().result.result.t == "ok"


def test_site_map(spark, pages, tables):
    robots, maps = tables
    with SiteMap(spark, pages, Settings(), robots, maps) as m:
        assert urls(m.run("a.example")) == [] or urls(m.run(BASE)) == ["/x", "/y"]
        assert urls(m.run(BASE)) == ["/x", "/y"]
        assert urls(m.run(BASE, limit=1)) == ["/x"]
    from datetime import date

    with SiteMap(spark, pages, Settings(sitemap=SitemapSettings(start_date=date(2023, 1, 1), respect_robots=False)), robots, maps) as m:
        assert urls(m.run(BASE)) == ["/no/1", "/x"]
    with SiteMap(spark, pages) as m:
        assert "/a" in urls(m.run(BASE))
    assert SiteMap(spark).run(BASE).count() == 0


@pytest.mark.parametrize(
    "bad",
    [
        {"scraping_strategy": "x"}, {"link_extraction_strategy": "x"}, {"scraping_output_format": "pdf"}, {"concurrency": 0}, {"max_retries": 0}, {"request_timeout": 0}, {"retry_delay": -1},
        {"link_extraction_limit": -1}, {"logging_level": "LOUD"}, {"scraping_strategy": "genai"}, {"scraping_strategy": "genai", "genai": LLMSettings({}), "scraping_output_format": "xml"}, {"proxy_rotation_method": "x"},
    ],
)
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_proxy_and_timer():
    assert ProxySettings("http://h:1", "u s", "p@").url == "http://u%20s:p%40@h:1"
    assert ProxySettings("http://x@h:1", "u").url == "http://x@h:1"
    said = []
    with timed("x", said.append):
        pass
    assert said[0].startswith("x: ")


def test_cli(spark, pages, tmp_path, capsys):
    pages.write.parquet(str(tmp_path / "p"))
    assert main([]) == 0
    assert main(["crawl", BASE + "/", "--pages", str(tmp_path / "p"), "--limit", "2"]) == 0
    assert capsys.readouterr().out.count('"url"') == 2
    assert subprocess.run([sys.executable, "-m", "gleanframe", "--version"], capture_output=True, text=True).stdout.strip() == "0.1.0"


def test_stream_and_seen_set(spark, pages, tmp_path):
    source = tmp_path / "in"
    pages.unionByName(pages.withColumn("url", F.concat("url", F.lit("#again")))).repartition(3).write.parquet(str(source))
    got = []
    for _ in range(2):
        stream = results.first_seen(results.page_stream(spark, str(source), pages.schema, 1))
        q = results.run_available(stream, lambda b, i: got.extend(r.url for r in b.collect()), str(tmp_path / "cp"))
        q.awaitTermination()
    assert len(got) == 6


def test_running_counts(spark, pages, tmp_path):
    source = tmp_path / "in"
    pages.select("url", F.lit("k").alias("host")).repartition(2).write.parquet(str(source))
    stream = spark.readStream.schema("url string, host string").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = []
    q = results.running_counts(stream, "host").writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(r.pages for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(out) == 6


def test_fallback_takes_held_and_allowed_pages_in_order(spark):
    rows = [(BASE + "/", page("/x/ /gone /no/1 /y#f /x", "home")), (BASE + "/x/", page("/z", "x")), (BASE + "/y", page("/x", "y")), (BASE + "/no/1", page("/behind", "no")), (BASE + "/behind", page("", "b")), (BASE + "/z", page("/deep", "z")), (BASE + "/deep", "")]
    pages = spark.createDataFrame(rows, "url string, html string").withColumn("page_id", F.monotonically_increasing_id())
    robots = spark.createDataFrame([(BASE, "User-agent: *\nDisallow: /no")], "base string, body string")
    seed = spark.createDataFrame([(BASE,)], "url string")

    def walk(**options):
        return [(r.url.removeprefix(BASE), r.depth) for r in frontier.html_fallback(pages, seed, **options).orderBy("seq").collect()]

    assert walk(robots_bodies=robots) == [("", 0), ("/x/", 1), ("/y", 1), ("/z", 2)]
    assert walk(max_depth=1) == [("", 0), ("/x/", 1), ("/no/1", 1), ("/y", 1)] and walk(max_pages=2) == [("", 0), ("/x/", 1)]
    assert frontier.html_fallback(pages, seed.limit(0)).count() == 0
    with SiteMap(spark, pages, Settings(), robots) as m:
        assert urls(m.run(BASE)) == ["", "/x/", "/y", "/z"]


def test_registered_strategy_priority_and_levels(spark, pages):
    register_strategy("lengths", lambda found, settings: found.select("url", F.length("html").alias("size")))
    with Crawler(spark, pages, Settings(scraping_strategy="lengths", link_extraction_limit=2)) as c:
        assert sorted(r.size for r in c.run(BASE + "/").collect())[0] > 0 and c.run(BASE + "/").count() == 2
    edges = spark.createDataFrame([("a", "b", 0, False), ("a", "c", 1, True), ("a", "d", 2, None), ("c", "e", 0, False)], "src string, dst string, pos int, priority boolean")
    said = []
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r.url for r in frontier.traverse(edges, seeds, limit=1).collect()} == {"a", "c"}
    assert {r.url for r in frontier.traverse(edges, seeds, on_level=lambda depth, size: said.append((depth, size))).collect()} == set("abcde") and said == [(1, 3), (2, 1)]


def test_walks_read_the_seeds_sites_only(spark, pages):
    seeds = spark.createDataFrame([(BASE + "/",)], "url string")
    other = pages.unionByName(pages.withColumn("url", F.replace("url", F.lit(BASE), F.lit("http://b.example"))))
    assert frontier.site_pages(other, seeds).count() == pages.count()
    many = spark.createDataFrame([(f"http://s{i}.example/",) for i in range(frontier.MAX_PREFIXES + 1)] + [(BASE + "/",)], "url string")
    assert frontier.site_pages(other, many).count() == pages.count()
    assert sorted(r.url for r in frontier.deep_links(other, seeds, limit=4).collect()) == [BASE + x for x in ("/", "/a", "/b", "/skip/x")] or frontier.deep_links(other, seeds, limit=4).count() == 4


def test_requested_and_random_choice(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",)], "url string")
    results = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", ""), ("z", "x")], "url string, text string")
    row = metrics.requested_stats(asked, results, seconds=2.0).first()
    assert (row.requested, row.succeeded, round(row.success_rate, 3), row.pages_per_second) == (3, 1, 0.333, 0.5)
    assert metrics.requested_stats(asked.limit(0), results).first().success_rate is None
    rows = spark.range(300).withColumnRenamed("id", "pos")
    got = [r.choice for r in metrics.random_choice(rows, ["a", "b", "c"], 1).orderBy("pos").collect()]
    assert got == [r.choice for r in metrics.random_choice(rows, ["a", "b", "c"], 1).orderBy("pos").collect()] and min(map(got.count, "abc")) > 60
    assert metrics.random_choice(rows, []).first().choice is None


def test_results_take_the_shape_of_the_question(spark, pages):
    with Scraper(spark, pages) as s:
        assert s.results(BASE + "/a")["result"]["text"] == "fox one" and s.results(BASE + "/none") is None
        assert [r["url"] for r in s.results([BASE + "/a", BASE + "/none", BASE + "/a"])] == [BASE + "/a"] * 2


def test_repeated_flags():
    from gleanframe.__main__ import parser

    args = parser().parse_args(["crawl", "u", "--pages", "p", "--include", "/a", "--include", "/b", "/c"])
    assert args.include == ["/a", "/b", "/c"] and args.exclude is None


def test_model_providers(spark, pages):
    asked = []

    def post(url, payload, headers, timeout):
        asked.append((url, payload, headers, timeout))
        return {"response": "l", "candidates": [{"content": {"parts": [{"text": "g"}]}}], "choices": [{"message": {"content": "o"}}]}

    shape = {"title": "T", "type": "object", "properties": {"t": {"type": "string"}}}
    assert models.model("Ollama", "m", options={"top_p": 1, "odd": 2}, post=post)("p", shape) == "l"
    assert asked[-1][0] == "http://localhost:11434/api/generate" and asked[-1][1]["options"] == {"top_p": 1} and asked[-1][1]["format"] == shape and not asked[-1][1]["think"]
    assert models.model("gemini", "m", "k", timeout=3, post=post)("p") == "g"
    assert asked[-1][0].endswith("/v1beta/models/m:generateContent") and "generationConfig" not in asked[-1][1] and asked[-1][3] == 3
    assert models.model("openai", "m", "k", options={"odd": 2}, strict=False, post=post)("p", shape) == "o"
    sent = asked[-1][1]
    assert sent["odd"] == 2 and sent["response_format"]["json_schema"]["name"] == "T" and sent["response_format"]["json_schema"]["schema"]["additionalProperties"] is False and asked[-1][2] == {"Authorization": "Bearer k"}
    assert models.model("openai", "m", base_url="http://here/v1/", post=post)("p") == "o" and asked[-1][0] == "http://here/v1/chat/completions" and asked[-1][2] == {}
    for provider, key in (("openai", None), ("google", None), ("other", "k")):
        with pytest.raises(ValueError):
            models.model(provider, "m", key)
    for message in ({"refusal": "no"}, {"content": ""}):
        with pytest.raises(RuntimeError):
            models.model("openai", "m", "k", post=lambda *a, m=message: {"choices": [{"message": m}]})("p")
    generate = models.model("ollama", "m", post=lambda *a: {"response": '{"t": "ok"}'})
    with Scraper(spark, pages, Settings(scraping_strategy="genai", genai=LLMSettings(shape, generate))) as s:
        assert "ok" in str(s.run(BASE + "/a").first())
