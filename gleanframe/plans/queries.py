"""Queries of the core operators and the SQL that must give the same rows."""

from __future__ import annotations

import gzip
from collections.abc import Callable
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, urls
from ..functions.dates import in_range, lastmod_date
from ..operators import dedupe, extract, filters, frontier, links, metrics, robots, sitemap, timestamps
from ..runtime import materialize, scratch
from ..sinks.files import union_keys, write_jsonl
from ..sources import corpus
from ..streaming import results

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Parts of the SQL.
_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{_SPLIT}', {n})"


def _trim(u: str) -> str:
    return rf"regexp_replace({u}, '^\s+|\s+$', '', 'g')"


def _norm(u: str) -> str:
    t = _trim(u)
    p = f"regexp_replace({_part(t, 3)}, '/+$', '')"
    return (
        f"(CASE WHEN {_part(t, 1)} <> '' THEN lower({_part(t, 1)}) || ':' ELSE '' END || CASE WHEN {_part(t, 2)} <> '' THEN '//' || lower({_part(t, 2)}) ELSE '' END"
        f" || CASE WHEN {p} = '' THEN '/' ELSE {p} END || CASE WHEN {_part(t, 4)} <> '' THEN '?' || {_part(t, 4)} ELSE '' END)"
    )


def _origin(u: str) -> str:
    return f"({_part(u, 1)} || '://' || {_part(u, 2)})"


_DEFRAG = "regexp_replace({0}, '#.*$', '', 's')"
_XML = "(lower({0}) LIKE '%.xml' OR lower({0}) LIKE '%.xml.gz')"
_LASTMOD = f"""(SELECT CASE WHEN year(d) >= 1 THEN d END FROM (SELECT coalesce(
  CAST(try_strptime(substr(s, 1, 19), '%Y-%m-%dT%H:%M:%S') AS DATE), CAST(try_strptime(substr(s, 1, 10), '%Y-%m-%d') AS DATE),
  CAST(try_strptime(substr(s, 1, 7), '%Y-%m') AS DATE), CAST(try_strptime(substr(s, 1, 4), '%Y') AS DATE)) AS d FROM (SELECT {_trim("lastmod")} AS s)))"""
_LINKS = f"""links AS (
  SELECT page_id, page_url, i - 1 AS pos, href, CASE WHEN href LIKE 'http%' THEN href ELSE {_origin("page_url")} || href END AS link FROM (
    SELECT page_id, page_url, unnest(hrefs) AS href, unnest(range(1, len(hrefs) + 1)) AS i FROM (
      SELECT page_id, url AS page_url, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)', 1) AS hrefs FROM pages)))"""


# URLs


@query("url_split", f"SELECT record_id, {_part('url', 1)} AS scheme, {_part('url', 2)} AS netloc, {_part('url', 3)} AS path, {_part('url', 4)} AS query, {_part('url', 5)} AS fragment FROM url_records")
def url_split(spark, d):
    u = F.col("url")
    return table(spark, d, "url_records").select("record_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"))


@query("url_normalize", f"SELECT record_id, {_norm('url')} AS norm FROM url_records")
def url_normalize(spark, d):
    return table(spark, d, "url_records").select("record_id", urls.normalize(F.col("url")).alias("norm"))


@query("url_defrag", f"SELECT record_id, {_DEFRAG.format('url')} AS url FROM url_records")
def url_defrag(spark, d):
    return table(spark, d, "url_records").select("record_id", urls.defrag(F.col("url")).alias("url"))


@query("base_prefix", f"SELECT record_id, {_origin('url')} AS prefix, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN {_origin('url')} ELSE 'https://' || {_part(chr(39) + 'https://' + chr(39) + ' || url', 2)} END AS base FROM url_records")
def base_prefix(spark, d):
    return table(spark, d, "url_records").select("record_id", urls.origin(F.col("url")).alias("prefix"), urls.normalize_base(F.col("url")).alias("base"))


@query("url_same_origin", f"SELECT record_id, lower({_part('url', 2)}) = lower({_part('source', 2)}) AS loose, {_part('url', 1)} = {_part('source', 1)} AND lower({_part('url', 2)}) = lower({_part('source', 2)}) AS strict FROM url_records")
def url_same_origin(spark, d):
    a, b = F.col("url"), F.col("source")
    return table(spark, d, "url_records").select("record_id", urls.same_origin_loose(a, b).alias("loose"), urls.same_origin_strict(a, b).alias("strict"))


@query("url_sitemap_kind", f"SELECT record_id, {_XML.format(_part('source', 3))} AS is_xml, {_XML.format(_part('source', 3))} OR lower({_part('source', 3)}) LIKE '%sitemap%' AS sitemap FROM url_records")
def url_sitemap_kind(spark, d):
    s = F.col("source")
    return table(spark, d, "url_records").select("record_id", urls.is_xml(s).alias("is_xml"), urls.looks_like_sitemap(s).alias("sitemap"))


# Links


@query("links_anchor", f"WITH {_LINKS} SELECT page_id, pos, href, link FROM links")
def links_anchor(spark, d):
    return links.page_links(table(spark, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "link")


@query(
    "links_fallback",
    f"""SELECT page_id, link FROM (SELECT page_id, page_url, CASE WHEN href LIKE 'http%' THEN href ELSE {_origin("page_url")} || href END AS link FROM (
  SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''#\\s]+)', 1)) AS href FROM pages)
  WHERE href NOT ILIKE 'mailto:%' AND href NOT ILIKE 'javascript:%') WHERE lower({_part("link", 2)}) = lower({_part("page_url", 2)})""",
)
def links_fallback(spark, d):
    return links.fallback_links(table(spark, d, "pages")).select("page_id", "link")


_SHALLOW = f"""s AS (SELECT DISTINCT page_id, {_DEFRAG.format("link")} AS link FROM links WHERE href NOT ILIKE 'mailto:%' AND href NOT ILIKE 'javascript:%'
  AND {_part("link", 2)} = {_part("page_url", 2)} AND regexp_replace({_DEFRAG.format("link")}, '/+$', '') <> regexp_replace(page_url, '/+$', ''))"""


@query("links_shallow", f"WITH {_LINKS}, {_SHALLOW} SELECT page_id, link FROM s")
def links_shallow(spark, d):
    return links.shallow_links(table(spark, d, "pages"))


@query("shallow_limit", f"""WITH {_LINKS}, l AS (SELECT page_id, page_url, pos, href, {_DEFRAG.format("link")} AS link FROM links),
s AS (SELECT page_id, link, min(pos) AS pos FROM l WHERE href NOT ILIKE 'mailto:%' AND href NOT ILIKE 'javascript:%' AND {_part("link", 2)} = {_part("page_url", 2)} AND regexp_replace(link, '/+$', '') <> regexp_replace(page_url, '/+$', '') GROUP BY page_id, link)
SELECT page_id, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM s) WHERE r <= 3""")
def shallow_limit(spark, d):
    return links.shallow_links(table(spark, d, "pages"), limit=3)


@query("links_exclude", f"SELECT record_id FROM url_records WHERE NOT {_part('url', 3)} GLOB '*.html' AND NOT {_part('url', 3)} GLOB '/[a-d]*'")
def links_exclude(spark, d):
    u = F.col("url")
    return links.in_scope(table(spark, d, "url_records"), urls.origin(u), None, ["*.html", "/[a-d]*"], "url").select("record_id")


@query("links_include", f"SELECT record_id FROM url_records WHERE {_part('url', 3)} GLOB '/en/*' OR {_part('url', 3)} GLOB '*/202[!4]/*'")
def links_include(spark, d):
    u = F.col("url")
    return links.in_scope(table(spark, d, "url_records"), urls.origin(u), ["/en/*", "*/202[!4]/*"], None, "url").select("record_id")


@query("links_include_exclude", f"SELECT record_id FROM url_records WHERE ({_part('url', 3)} GLOB '/en/*' OR {_part('url', 3)} GLOB '/?o*') AND NOT {_part('url', 3)} GLOB '*.html'")
def links_include_exclude(spark, d):
    u = F.col("url")
    return links.in_scope(table(spark, d, "url_records"), urls.origin(u), ["/en/*", "/?o*"], ["*.html"], "url").select("record_id")


@query(
    "links_in_scope",
    f"""WITH {_LINKS}, l AS (SELECT page_id, pos, {_DEFRAG.format("link")} AS link FROM links WHERE {_part("link", 1)} = {_part("page_url", 1)} AND lower({_part("link", 2)}) = lower({_part("page_url", 2)})),
k AS (SELECT *, {_norm("link")} AS norm FROM l WHERE {_part("link", 3)} GLOB '/[a-m]*')
SELECT page_id, link, norm FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY page_id, pos) AS r FROM k) WHERE r = 1""",
)
def links_in_scope(spark, d):
    found = links.same_site_links(table(spark, d, "pages"), include=["/[a-m]*"])
    first = dedupe.dedupe_by_url(found, ["page_id", "pos"], "link")
    return first.select("page_id", "link", urls.normalize(F.col("link")).alias("norm"))


# Distinct, limits, lookups


@query("dedupe_first_wins", f"SELECT record_id, url FROM (SELECT record_id, url, row_number() OVER (PARTITION BY {_norm('url')} ORDER BY record_id) AS r FROM url_records) WHERE r = 1")
def dedupe_first_wins(spark, d):
    return dedupe.dedupe_by_url(table(spark, d, "url_records").select("record_id", "url"), ["record_id"])


@query("dedupe_exact", f"SELECT record_id, url FROM (SELECT record_id, url, row_number() OVER (PARTITION BY {_DEFRAG.format('url')} ORDER BY record_id) AS r FROM url_records) WHERE r = 1")
def dedupe_exact(spark, d):
    return dedupe.dedupe_exact(table(spark, d, "url_records").select("record_id", "url"), ["record_id"])


@query("limit_first_n", f"SELECT record_id, url FROM (SELECT record_id, url, row_number() OVER (PARTITION BY {_norm('url')} ORDER BY record_id) AS r FROM url_records) WHERE r = 1 ORDER BY record_id LIMIT 50")
def limit_first_n(spark, d):
    first = dedupe.dedupe_by_url(table(spark, d, "url_records").select("record_id", "url"), ["record_id"])
    return dedupe.limit_in_order(first, 50, ["record_id"])


@query("fetch_hit", "SELECT c.url, length(p.html) AS chars FROM content_items c JOIN pages p ON c.url = p.url")
def fetch_hit(spark, d):
    return corpus.fetch(table(spark, d, "content_items"), table(spark, d, "pages")).select("url", F.length("html").cast("long").alias("chars"))


@query("fetch_miss", "SELECT url FROM url_records WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = url_records.url)")
def fetch_miss(spark, d):
    return corpus.misses(table(spark, d, "url_records"), table(spark, d, "pages"))


# Iteration


def _site_graph(spark, d):
    """Pages and links of a site, both ways."""
    e = frontier.link_edges(table(spark, d, "pages"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "pos"))


def _site_walk(spark, d):
    """The edges of the graph and one seed a site."""
    edges = materialize(_site_graph(spark, d), "site-graph")
    pages = frontier.link_edges(table(spark, d, "pages"))
    seeds = pages.groupBy(F.lower(urls.netloc(F.col("src"))).alias("h")).agg(F.min("src").alias("url")).select("url")
    return edges, seeds


_GRAPH = f"""{_LINKS}, e0 AS (SELECT DISTINCT {_DEFRAG.format("page_url")} AS src, {_DEFRAG.format("link")} AS dst FROM links WHERE {_part("link", 1)} = {_part("page_url", 1)} AND lower({_part("link", 2)}) = lower({_part("page_url", 2)})),
e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), seeds AS (SELECT min(src) AS url FROM e0 GROUP BY lower({_part("src", 2)})),
b AS (SELECT url, 0 AS depth FROM seeds UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON b.url = e.src WHERE b.depth < 4)"""


@query("crawl_bfs_depth", f"WITH RECURSIVE {_GRAPH} SELECT url, min(depth) AS depth FROM b GROUP BY url")
def crawl_bfs_depth(spark, d):
    return frontier.traverse(*_site_walk(spark, d), max_depth=4).select("url", "depth")


_REACHED = f"""{_LINKS}, e0 AS (SELECT DISTINCT {_DEFRAG.format("page_url")} AS src, {_DEFRAG.format("link")} AS dst FROM links WHERE {_part("link", 1)} = {_part("page_url", 1)} AND lower({_part("link", 2)}) = lower({_part("page_url", 2)})),
e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), seeds AS (SELECT min(src) AS url FROM e0 GROUP BY lower({_part("src", 2)})),
b(url, depth) USING KEY (url) AS (SELECT url, 0 FROM seeds UNION SELECT e.dst, min(b.depth) + 1 FROM b JOIN e ON b.url = e.src WHERE NOT EXISTS (SELECT 1 FROM recurring.b r WHERE r.url = e.dst) GROUP BY e.dst)"""


@query("crawl_bfs_full", f"WITH RECURSIVE {_REACHED} SELECT url, depth FROM b")
def crawl_bfs_full(spark, d):
    """``crawl_bfs_depth`` without a bound of depth: everything reachable."""
    return frontier.traverse(*_site_walk(spark, d)).select("url", "depth")


@query("deep_links", f"WITH {_LINKS} SELECT DISTINCT {_DEFRAG.format('link')} AS url, 1 AS depth FROM links WHERE {_part('link', 1)} = {_part('page_url', 1)} AND lower({_part('link', 2)}) = lower({_part('page_url', 2)})")
def deep_links(spark, d):
    pages = table(spark, d, "pages")
    return frontier.deep_links(pages, pages.select(urls.defrag(F.col("url")).alias("url")))


@query(
    "crawl_filtered",
    rf"""SELECT url, title FROM (SELECT url, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '[ \t\n\r\f]+', ' ', 'g')), '') AS title FROM pages) WHERE lower(title) LIKE '%road%'""",
)
def crawl_filtered(spark, d):
    pages = table(spark, d, "pages")
    seeds = pages.select(urls.defrag(F.col("url")).alias("url"))
    return frontier.crawl(pages, seeds, extract.heuristic(pages), filters.by_keywords("road", "title")).select("url", "title")


def _sitemap_tree(spark, d):
    """Edges and roots of a tree of four levels."""

    def edges(t: str, parent: str, pk: str, child: str, ck: str) -> DataFrame:
        return table(spark, d, t).select(F.concat(F.lit(parent), pk).alias("src"), F.concat(F.lit(child), ck).alias("dst"), F.lit(0).alias("pos"))

    tree = edges("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edges("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(edges("orders", "c", "o_custkey", "o", "o_orderkey"))
    roots = table(spark, d, "region").where(F.col("r_name").isin("AMERICA", "ASIA")).select(F.concat(F.lit("r"), "r_regionkey").alias("url"))
    return tree, roots


@query(
    "sitemap_tree",
    """SELECT 'r' || r_regionkey AS url, 0 AS depth FROM region WHERE r_name IN ('AMERICA', 'ASIA')
UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AMERICA', 'ASIA')
UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AMERICA', 'ASIA')
UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AMERICA', 'ASIA')""",
)
def sitemap_tree(spark, d):
    """A tree of four levels, walked like an index of indexes."""
    return frontier.traverse(*_sitemap_tree(spark, d)).select("url", "depth")


def _tree_pages(spark, d):
    """Pages of a tree, each with links to the ones below in order: regions, nations, customers; orders aren't held."""
    base = "http://tree.example/"

    def level(t: str, key: str, mark: str, name: str, below: str, up: str, child: str, mark_below: str) -> DataFrame:
        under = table(spark, d, below).groupBy(F.col(up).alias("k")).agg(F.array_sort(F.collect_list(child)).alias("c"))
        rows = table(spark, d, t).join(under, F.col(key) == F.col("k"), "left")
        anchors = F.array_join(F.transform("c", lambda c: F.concat(F.lit(f'<a href="/{mark_below}'), c, F.lit('">x</a>'))), "")
        html = F.concat(F.lit("<html><title>"), name, F.lit("</title><body>"), F.coalesce(anchors, F.lit("")), F.lit("</body></html>"))
        return rows.select(F.col(key).cast("long").alias("page_id"), F.concat(F.lit(base + mark), key).alias("url"), html.alias("html"))

    customers = level("customer", "c_custkey", "c", "c_name", "orders", "o_custkey", "o_orderkey", "o")
    pages = level("region", "r_regionkey", "r", "r_name", "nation", "n_regionkey", "n_nationkey", "n").unionByName(level("nation", "n_nationkey", "n", "n_name", "customer", "c_nationkey", "c_custkey", "c")).unionByName(customers)
    return materialize(pages, "tree-pages")


def _seed(spark, url: str) -> DataFrame:
    return spark.createDataFrame([(url,)], "url string")


_TREE = """t AS (
  SELECT 'n' || n_nationkey AS node, 1 AS depth, 'r' || n_regionkey AS parent, n_nationkey AS pos, n_name AS title FROM nation WHERE n_regionkey = 0
  UNION ALL SELECT 'c' || c_custkey, 2, 'n' || c_nationkey, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
  UNION ALL SELECT 'o' || o_orderkey, 3, 'c' || o_custkey, o_orderkey, NULL FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0)"""


@query("deep_links_limit", f"WITH {_TREE} SELECT 'http://tree.example/' || node AS url, depth FROM (SELECT * FROM t ORDER BY depth, parent, pos LIMIT 400)")
def deep_links_limit(spark, d):
    """The first 400 links from one seed, over three levels."""
    return frontier.deep_links(_tree_pages(spark, d), _seed(spark, "http://tree.example/r0"), limit=400)


@query("deep_links_tree", f"WITH {_TREE} SELECT 'http://tree.example/' || node AS url, depth FROM t")
def deep_links_tree(spark, d):
    """All links from one seed, over three levels."""
    return frontier.deep_links(_tree_pages(spark, d), _seed(spark, "http://tree.example/r0"))


@query("crawl_bfs_limit", f"WITH {_TREE} SELECT 'http://tree.example/' || node AS url, title FROM (SELECT * FROM t WHERE title LIKE '%1%' ORDER BY depth, parent, pos LIMIT 100)")
def crawl_bfs_limit(spark, d):
    """The first 100 pages with a 1 in their title, from one seed, over two levels of pages that have none."""
    found = frontier.crawl(_tree_pages(spark, d), _seed(spark, "http://tree.example/r0"), extract.heuristic, filters.by_keywords("1", "title"), limit=100)
    return found.select("url", "title")


@query("crawl_tree", f"WITH {_TREE} SELECT 'http://tree.example/' || node AS url, depth FROM t WHERE title LIKE '%1%'")
def crawl_tree(spark, d):
    found = frontier.crawl(_tree_pages(spark, d), _seed(spark, "http://tree.example/r0"), extract.heuristic, filters.by_keywords("1", "title"))
    return found.select("url", "depth")


@query("crawl_deep_chain", "WITH RECURSIVE c AS (SELECT 0 AS i UNION ALL SELECT i + 1 FROM c WHERE i + 1 < (SELECT 3 * count(*) FROM nation)) SELECT 'http://chain.example/p' || i AS url, i AS depth FROM c WHERE i > 0")
def crawl_deep_chain(spark, d):
    """Pages that each name only the next one: as many levels as there are pages."""
    i = F.col("n_nationkey") * 3 + F.col("k")
    nodes = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).select(i.alias("page_id"))
    last = nodes.agg(F.max("page_id")).first()[0]
    html = F.when(F.col("page_id") < last, F.concat(F.lit('<a href="/p'), (F.col("page_id") + 1).cast("string"), F.lit('">next</a>'))).otherwise(F.lit("<p>end</p>"))
    pages = nodes.select("page_id", F.concat(F.lit("http://chain.example/p"), "page_id").alias("url"), html.alias("html"))
    return frontier.deep_links(pages, _seed(spark, "http://chain.example/p0"))


@query(
    "html_fallback",
    """WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS place, starts_with('n' || n_nationkey, 'n1') AS banned FROM nation WHERE n_regionkey = 1),
c AS (SELECT c_custkey, c_acctbal FROM customer JOIN n ON c_nationkey = n_nationkey WHERE NOT banned ORDER BY place, c_custkey LIMIT 150 - 1 - (SELECT count(*) FROM n))
SELECT 'http://tree.example/r1' AS url, 0 AS depth UNION ALL SELECT 'http://tree.example/n' || n_nationkey, 1 FROM n WHERE NOT banned
UNION ALL SELECT 'http://tree.example/c' || c_custkey, 2 FROM c WHERE c_acctbal >= 0""",
)
def html_fallback(spark, d):
    """A walk with addresses that are disallowed or not held on its way, which count toward the number of pages."""
    pages = _tree_pages(spark, d)
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("http://tree.example/c"), "c_custkey").alias("url"))
    rules = spark.createDataFrame([("http://tree.example", "User-agent: *\nDisallow: /n1")], "base string, body string")
    return frontier.html_fallback(pages.join(poor, "url", "left_anti"), _seed(spark, "http://tree.example/r1"), 2, 150, rules).select("url", "depth")


@query(
    "frontier_cap",
    """WITH n AS (SELECT n_nationkey, 'n' || n_nationkey AS url FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AMERICA', 'ASIA')),
c AS (SELECT c_custkey, 'c' || c_custkey AS url FROM customer JOIN n ON c_nationkey = n_nationkey ORDER BY n.url, 'c' || c_custkey LIMIT 100),
o AS (SELECT 'o' || o_orderkey AS url FROM orders JOIN c ON o_custkey = c_custkey ORDER BY c.url, 'o' || o_orderkey LIMIT 100)
SELECT 'r' || r_regionkey AS url, 0 AS depth FROM region WHERE r_name IN ('AMERICA', 'ASIA') UNION ALL SELECT url, 1 FROM n UNION ALL SELECT url, 2 FROM c UNION ALL SELECT url, 3 FROM o""",
)
def frontier_cap(spark, d):
    """A walk whose queue holds a hundred addresses a level: the rest is dropped, as a caller asked."""
    return frontier.traverse(*_sitemap_tree(spark, d), max_level=100).select("url", "depth")


# Sitemaps and robots


@query("lastmod_parse", f"SELECT record_id, {_LASTMOD} AS lastmod_date FROM url_records")
def lastmod_parse(spark, d):
    return table(spark, d, "url_records").select("record_id", lastmod_date(F.col("lastmod")).alias("lastmod_date"))


_START, _END = date(2022, 3, 1), date(2024, 6, 30)
_BETWEEN = f"{_LASTMOD} BETWEEN DATE '{_START}' AND DATE '{_END}'"


@query("lastmod_range", f"SELECT record_id FROM url_records WHERE coalesce({_BETWEEN}, true)")
def lastmod_range(spark, d):
    return table(spark, d, "url_records").where(in_range(lastmod_date(F.col("lastmod")), _START, _END)).select("record_id")


@query("lastmod_range_strict", f"SELECT record_id FROM url_records WHERE coalesce({_LASTMOD} >= DATE '{_START}', false)")
def lastmod_range_strict(spark, d):
    return table(spark, d, "url_records").where(in_range(lastmod_date(F.col("lastmod")), _START, None, strict=True)).select("record_id")


@query(
    "sitemap_pipeline",
    f"""SELECT record_id, url FROM (SELECT record_id, url, row_number() OVER (PARTITION BY {_norm("url")} ORDER BY record_id) AS r FROM url_records
WHERE coalesce({_BETWEEN}, true) AND NOT {_XML.format(_part("url", 3))} AND {_part("url", 3)} GLOB '*/[a-h]*') WHERE r = 1 ORDER BY record_id LIMIT 1000""",
)
def sitemap_pipeline(spark, d):
    rows = table(spark, d, "url_records").select("record_id", "url", "lastmod")
    return sitemap.select_urls(rows, ["record_id"], _START, _END, include=["*/[a-h]*"], limit=1000).select("record_id", "url")


@query(
    "sitemap_xml_scan",
    f"SELECT 's' || (record_id % 50) AS sitemap, {_trim('url')} AS loc, nullif({_trim('lastmod')}, '') AS lastmod, changefreq, priority FROM url_records",
)
def sitemap_xml_scan(spark, d):
    """Records written as sitemaps of prefixed elements, with a comment, and read back."""

    def element(name: str, value) -> F.Column:
        safe = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"<sm:{name}>"), safe, F.lit(f"</sm:{name}>")))

    rows = table(spark, d, "url_records")
    one = F.concat(F.lit("<sm:url><!-- entry -->"), element("loc", F.col("url")), element("lastmod", F.col("lastmod")), element("changefreq", F.col("changefreq")), element("priority", F.col("priority")), F.lit("</sm:url>"))
    bodies = rows.groupBy(F.concat(F.lit("s"), F.col("record_id") % 50).alias("url")).agg(F.array_join(F.collect_list(one), "").alias("b"))
    bodies = bodies.select("url", F.concat(F.lit('<?xml version="1.0"?><sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9">'), "b", F.lit("</sm:urlset>")).alias("body"))
    return sitemap.scan(bodies).select("sitemap", "loc", "lastmod", "changefreq", "priority")


@query(
    "sitemap_index_scan",
    "SELECT DISTINCT url AS sitemap, CASE WHEN rtrim(body) LIKE '%</sitemapindex>' THEN 'sitemap' ELSE 'url' END AS kind, unnest(regexp_extract_all(body, '<loc>(http[^<]+)</loc>', 1)) AS loc FROM sitemap_bodies",
)
def sitemap_index_scan(spark, d):
    """Indexes give children; broken ones give the addresses a pattern finds."""
    return sitemap.scan(table(spark, d, "sitemap_bodies")).select("sitemap", "kind", "loc")


@query("rss_scan", "SELECT n_name AS sitemap, 'url' AS kind, 'http://' || lower(replace(n_name, ' ', '-')) || '.example/' || t AS loc FROM nation, (VALUES ('a'), ('b'), ('c')) v(t)")
def rss_scan(spark, d):
    host = F.concat(F.lit("http://"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example/"))
    body = F.concat(F.lit("<rss version='2.0'><channel><link>"), host, F.lit("a</link><title>x</title><item><link> "), host, F.lit("b </link></item><item><id>"), host, F.lit("c</id><id>urn:1</id></item></channel></rss>"))
    return sitemap.scan(table(spark, d, "nation").select(F.col("n_name").alias("url"), body.alias("body"))).select("sitemap", "kind", "loc")


@query("regex_scan", f"SELECT DISTINCT 'b' || (record_id % 20) AS sitemap, url AS loc FROM url_records WHERE NOT contains(url, '<') AND url = {_trim('url')}")
def regex_scan(spark, d):
    """Bodies that break off: a pattern finds their addresses, each once."""
    rows = table(spark, d, "url_records").where(~F.col("url").contains("<") & (F.col("url") == urls.trimmed(F.col("url"))))
    one = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>"))
    bodies = rows.groupBy(F.concat(F.lit("b"), F.col("record_id") % 20).alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(one), "")).alias("body"))
    return sitemap.scan(bodies).select("sitemap", "loc")


@query(
    "probe_common_paths",
    "SELECT DISTINCT base, base || p AS sitemap FROM robots_bodies, (VALUES ('/sitemap.xml'), ('/sitemap_index.xml'), ('/wp-sitemap.xml'), ('/sitemap.xml.gz'), ('/index-sitemap.xml'), ('/sitemap/sitemap.xml')) v(p) WHERE base || p IN (SELECT url FROM sitemap_bodies WHERE length(body) > 0)",
)
def probe_common_paths(spark, d):
    return sitemap.probe_common_paths(table(spark, d, "robots_bodies").select("base").distinct(), table(spark, d, "sitemap_bodies"))


@query(
    "sitemaps_of",
    r"""WITH n AS (SELECT DISTINCT base, regexp_replace(l, '(?i)^\s*sitemap:\s*', '') AS sitemap FROM (SELECT base, unnest(string_split(body, chr(10))) AS l FROM robots_bodies) WHERE regexp_matches(l, '(?i)^\s*sitemap:'))
SELECT * FROM n UNION SELECT DISTINCT base, base || p FROM robots_bodies, (VALUES ('/sitemap.xml'), ('/sitemap_index.xml'), ('/wp-sitemap.xml'), ('/sitemap.xml.gz'), ('/index-sitemap.xml'), ('/sitemap/sitemap.xml')) v(p) WHERE base || p IN (SELECT url FROM sitemap_bodies WHERE length(body) > 0)""",
)
def sitemaps_of(spark, d):
    return sitemap.sitemaps_of(table(spark, d, "robots_bodies"), table(spark, d, "sitemap_bodies"))


@query("gunzip_bodies", "SELECT url || '.gz' AS url, body FROM sitemap_bodies WHERE body IS NOT NULL")
def gunzip_bodies(spark, d):
    """Bodies packed, and then unfolded and decoded again."""

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([gzip.compress(x.encode()) for x in b.column(1).to_pylist()], pa.binary())], names=["url", "body"])

    rows = table(spark, d, "sitemap_bodies").where("body IS NOT NULL").select(F.concat("url", F.lit(".gz")).alias("url"), "body")
    return corpus.unzipped(rows.mapInArrow(packed, "url string, body binary")).select("url", corpus.decode_text(F.col("body")).alias("body"))


@query("jsonl_round_trip", "SELECT item_id, url, title, date FROM content_items")
def jsonl_round_trip(spark, d):
    """Items written as JSON lines and read back, nulls among them."""
    folder = scratch(spark, "jsonl")
    write_jsonl(table(spark, d, "content_items").select("item_id", "url", "title", "date"), folder)
    return spark.read.schema("item_id long, url string, title string, date string").json(folder)


@query("sitemap_records", "SELECT 'l' || n_nationkey AS source, 'http://x.example/' || c_custkey AS url, 2 AS depth FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def sitemap_records(spark, d):
    """An index of indexes down to leaves, from one root."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")

    def index(rows: DataFrame, key: str, loc) -> DataFrame:
        entries = F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), loc, F.lit("</loc></sitemap>"))), "")
        return rows.groupBy(F.concat(F.lit(key), "n_regionkey").alias("url")).agg(entries.alias("b")).select("url", F.concat(F.lit("<sitemapindex>"), "b", F.lit("</sitemapindex>")).alias("body"))

    leaf = customer.groupBy(F.concat(F.lit("l"), "c_nationkey").alias("url")).agg(F.array_join(F.collect_list(F.concat(F.lit("<url><loc>http://x.example/"), "c_custkey", F.lit("</loc></url>"))), "").alias("b"))
    bodies = index(nation, "m", F.concat(F.lit("l"), "n_nationkey")).unionByName(leaf.select("url", F.concat(F.lit("<urlset>"), "b", F.lit("</urlset>")).alias("body")))
    bodies = bodies.unionByName(spark.createDataFrame([("top", "<sitemapindex><sitemap><loc>m1</loc></sitemap></sitemapindex>")], "url string, body string"))
    roots = spark.createDataFrame([("top",)], "url string")
    return frontier.sitemap_records(bodies, roots).select("source", "url", "depth")


@query(
    "robots_sitemaps",
    r"""SELECT base, regexp_replace(l, '(?i)^\s*sitemap:\s*', '') AS sitemap FROM (SELECT base, unnest(string_split(body, chr(10))) AS l FROM robots_bodies) WHERE regexp_matches(l, '(?i)^\s*sitemap:')""",
)
def robots_sitemaps(spark, d):
    return robots.sitemap_directives(table(spark, d, "robots_bodies")).select("base", "sitemap")


@query(
    "robots_allow",
    f"""WITH r AS (SELECT lower({_part("base", 2)}) AS host, i, lower(regexp_extract(l, '^\\s*([A-Za-z-]+)\\s*:', 1)) AS k, trim(regexp_extract(l, ':(.*)$', 1)) AS v FROM (
  SELECT base, unnest(string_split(body, chr(10))) AS l, unnest(range(len(string_split(body, chr(10))))) AS i FROM robots_bodies WHERE body IS NOT NULL)),
u AS (SELECT record_id, lower({_part("url", 2)}) AS host, {_part("url", 3)} || CASE WHEN {_part("url", 4)} <> '' THEN '?' || {_part("url", 4)} ELSE '' END AS p FROM url_records)
SELECT u.record_id, coalesce(arg_min(r.k = 'allow' OR r.v = '', r.i), true) AS allowed FROM u LEFT JOIN r ON u.host = r.host AND r.k IN ('allow', 'disallow') AND starts_with(u.p, r.v) GROUP BY u.record_id""",
)
def robots_allow(spark, d):
    return robots.allowed(table(spark, d, "url_records").select("record_id", "url"), table(spark, d, "robots_bodies")).select("record_id", "allowed")


# Extraction

_VISIBLE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"


def _tag(t: str) -> str:
    return rf"nullif(regexp_extract(v, '(?is)<{t}\b[^>]*>(.*?)</{t}\s*>', 1), '')"


def _text(h: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace({h}, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'), ' '), '')"


_MAIN = f"coalesce({_tag('article')}, {_tag('main')}, {_tag('body')}, v)"
_TITLE = r"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '[ \t\n\r\f]+', ' ', 'g'), ' '), '')"
_LANG = r"nullif(regexp_extract(html, '(?is)<html\b[^>]*\blang=[\"'']([^\"'']*)', 1), '')".replace('\\"', '"')


@query("extract_text", f"SELECT page_id, {_TITLE} AS title, {_LANG} AS lang, {_text(_MAIN)} AS text FROM (SELECT *, {_VISIBLE} AS v FROM pages)")
def extract_text(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", extract.title(html).alias("title"), extract.page_lang(html).alias("lang"), extract.text_of(extract.main_html(html)).alias("text"))


@query("extract_wrap_crawl", f"SELECT url, {_TITLE} AS title, length({_text(_MAIN)}) AS chars FROM (SELECT *, {_VISIBLE} AS v FROM pages)")
def extract_wrap_crawl(spark, d):
    return extract.wrap_crawl(extract.heuristic(table(spark, d, "pages"))).select("url", "title", F.length("text").cast("long").alias("chars"))


@query("extract_wrap_scrape", f"SELECT c.url, {_TITLE} AS title FROM content_items c JOIN pages p ON c.url = p.url")
def extract_wrap_scrape(spark, d):
    found = extract.wrap_scrape(extract.heuristic(corpus.fetch(table(spark, d, "content_items"), table(spark, d, "pages"))))
    return found.select("url", F.col("result.title").alias("title"))


@query("extract_exclude", rf"SELECT page_id, {_text(_MAIN)} AS text FROM (SELECT page_id, regexp_replace(regexp_replace({_VISIBLE}, '(?is)<nav\b.*?</nav\s*>', ' ', 'g'), '(?is)<footer\b.*?</footer\s*>', ' ', 'g') AS v FROM pages)")
def extract_exclude(spark, d):
    html = extract.without_elements(extract.visible(F.col("html")), ["nav", "footer"])
    return table(spark, d, "pages").select("page_id", extract.text_of(extract.main_html(html)).alias("text"))


@query("extract_markdown")
def extract_markdown(spark, d):
    return extract.markdownify(table(spark, d, "pages"), ["nav", "footer", ".s1"])


@query("extract_formats")
def extract_formats(spark, d):
    content = extract.heuristic(table(spark, d, "pages"))
    out = [extract.formatted(content, f).select("url", F.lit(f).alias("format"), "result") for f in ("json", "markdown", "xml", "xmltei")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("schema_extract_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def schema_extract_json(spark, d):
    shape = T.StructType([T.StructField("k", T.LongType(), False)])
    return extract.parse_records(table(spark, d, "events").select("event_id", "props"), shape, "props").select("event_id", F.col("result.k").alias("k"))


# Filters

_FIELD = "coalesce(nullif(text, ''), nullif(content, ''), nullif(title, ''))"
_DATE = "coalesce(nullif(date, ''), nullif(filedate, ''))"
_DAY = rf"(CASE WHEN regexp_full_match({_DATE}, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN CAST(try_strptime({_DATE}, '%Y-%m-%d') AS DATE) END)"
_F_DATE = f"coalesce({_DAY} BETWEEN DATE '2022-01-01' AND DATE '2023-12-31', false)"
_F_WORDS = "coalesce(contains(lower(nullif(text, '')), 'lighthouse') OR contains(lower(nullif(text, '')), 'pump'), false)"
_F_HTML = "coalesce(ends_with(lower(nullif(url, '')), '.html'), false)"


def _items(spark: SparkSession, d: str, f) -> DataFrame:
    return filters.keep(table(spark, d, "content_items"), f).select("item_id")


_by_date = filters.by_date("2022-01-01", "2023-12-31")
_by_words = filters.by_keywords(["Lighthouse", "pump"])
_by_html = filters.by_extension("html")

query("filter_date", f"SELECT item_id FROM content_items WHERE {_F_DATE}")(lambda s, d: _items(s, d, _by_date))
query("filter_keywords", f"SELECT item_id FROM content_items WHERE {_F_WORDS}")(lambda s, d: _items(s, d, _by_words))
query("filter_extension", f"SELECT item_id FROM content_items WHERE {_F_HTML}")(lambda s, d: _items(s, d, _by_html))
query("filter_files", "SELECT item_id FROM content_items WHERE regexp_matches(lower(url), '\\.(pdf|png|jpg|jpeg|webp|gif|txt|md|html)$')")(lambda s, d: _items(s, d, filters.by_files(["pdf", "image", "text", "html"])))
query("filter_and", f"SELECT item_id FROM content_items WHERE {_F_DATE} AND {_F_WORDS}")(lambda s, d: _items(s, d, filters.AND(_by_date, _by_words)))
query("filter_or", f"SELECT item_id FROM content_items WHERE {_F_DATE} OR {_F_HTML}")(lambda s, d: _items(s, d, filters.OR(_by_date, _by_html)))
query("filter_not", f"SELECT item_id FROM content_items WHERE NOT {_F_WORDS}")(lambda s, d: _items(s, d, filters.NOT(_by_words)))
query("filter_empty_chain", "SELECT item_id FROM content_items")(lambda s, d: _items(s, d, filters.FilterChain()))
query("filter_no_keywords", "SELECT item_id FROM content_items WHERE false")(lambda s, d: _items(s, d, filters.by_keywords([])))
query("filter_nested", f"SELECT item_id FROM content_items WHERE ({_F_DATE} OR NOT {_F_WORDS}) AND NOT {_F_HTML}")(lambda s, d: _items(s, d, filters.AND(filters.OR(_by_date, filters.NOT(_by_words)), filters.NOT(_by_html))))


query("filter_column", "SELECT item_id FROM content_items WHERE coalesce(length(title) > 40 AND contains(url, 'news'), false)")(lambda s, d: _items(s, d, filters.by_column((F.length("title") > 40) & F.col("url").contains("news"))))
query("filter_function", "SELECT item_id FROM content_items WHERE coalesce(len(string_split(title, ' ')), 0) % 2 = 1")(lambda s, d: _items(s, d, filters.by_function(lambda r: len((r["title"] or "").split(" ")) % 2 == 1 and r["title"] is not None, ["title"])))


@query("extract_text_field", "SELECT item_id, coalesce(nullif(text, ''), nullif(content, ''), '') AS text FROM content_items")
def extract_text_field(spark, d):
    return table(spark, d, "content_items").select("item_id", text.extract_text(F.col("text"), F.col("content")).alias("text"))


@query("filter_resolve_field", f"SELECT item_id, {_FIELD} AS field, {_DATE} AS day FROM content_items")
def filter_resolve_field(spark, d):
    items = table(spark, d, "content_items")
    return items.select("item_id", filters.resolve_field(items.columns, filters.TEXT_FIELDS).alias("field"), filters.resolve_field(items.columns, filters.DATE_FIELDS).alias("day"))


_QUERY = "the old lighthouse and the broken pump near the station"
_TERMS = "SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower({0}), '[a-z0-9]+')) AS t FROM content_items) GROUP BY item_id, t"
_COSINE = f"""WITH d AS ({_TERMS.format(_FIELD)}), q AS (SELECT t, count(*) AS n FROM (SELECT unnest(regexp_extract_all('{_QUERY}', '[a-z0-9]+')) AS t) GROUP BY t),
s AS (SELECT d.item_id, sum(d.n * coalesce(q.n, 0)) / (sqrt(sum(d.n * d.n)) * (SELECT sqrt(sum(n * n)) FROM q)) AS c FROM d LEFT JOIN q ON d.t = q.t GROUP BY d.item_id)"""


@query("filter_cosine", _COSINE + " SELECT item_id FROM s WHERE c >= 0.25")
def filter_cosine(spark, d):
    return _items(spark, d, filters.by_cosine_similarity(_QUERY))


@query("cosine_score", _COSINE + f" SELECT i.item_id, CASE WHEN {_FIELD} IS NOT NULL THEN round(coalesce(c, 0), 6) END AS score FROM content_items i LEFT JOIN s ON i.item_id = s.item_id")
def cosine_score(spark, d):
    items = table(spark, d, "content_items")
    return items.select("item_id", F.round(text.cosine_to(filters.resolve_field(items.columns, filters.TEXT_FIELDS), _QUERY), 6).alias("score"))


@query("term_frequency", "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY doc_id, term")
def term_frequency(spark, d):
    return text.term_frequency(table(spark, d, "documents"), "doc_id", "text")


# Figures, unions, streams


@query(
    "bench_strategy_stats",
    f"""WITH r AS (SELECT 'main' AS strategy, {_text(_MAIN)} AS t FROM (SELECT *, {_VISIBLE} AS v FROM pages) UNION ALL SELECT 'title', {_TITLE} FROM pages)
SELECT strategy, count(*) AS pages, count(t) AS succeeded, count(*) FILTER (length(t) < 80) AS likely_failed, round(avg(length(t)), 6) AS avg_length, CAST(median(length(t)) AS DOUBLE) AS median_length,
  count(t) / count(*) AS success_rate, count(*) FILTER (length(t) < 80) / count(*) AS likely_failed_rate FROM r GROUP BY strategy""",
)
def bench_strategy_stats(spark, d):
    html = F.col("html")
    pages = table(spark, d, "pages")
    both = pages.select(F.lit("main").alias("strategy"), extract.text_of(extract.main_html(html)).alias("text")).unionByName(pages.select(F.lit("title").alias("strategy"), extract.title(html).alias("text")))
    return metrics.strategy_stats(both).withColumn("avg_length", F.round("avg_length", 6))


@query("requested_success", "SELECT count(*) AS requested, count(p.url) AS succeeded, count(p.url) / count(*) AS success_rate FROM (SELECT DISTINCT url FROM url_records UNION SELECT url FROM content_items) r LEFT JOIN (SELECT DISTINCT url FROM pages WHERE length(html) > 0) p ON r.url = p.url")
def requested_success(spark, d):
    """Successes over all addresses that were asked for, also those without any result."""
    asked = table(spark, d, "url_records").select("url").unionByName(table(spark, d, "content_items").select("url"))
    return metrics.requested_stats(asked, table(spark, d, "pages").select("url", F.col("html").alias("text"))).select("requested", "succeeded", "success_rate")


@query("navigations_per_page", "SELECT count(url) AS navigations, count(DISTINCT url) AS pages, count(url) / nullif(count(DISTINCT url), 0) AS per_page FROM content_items")
def navigations_per_page(spark, d):
    return metrics.navigations_per_page(table(spark, d, "content_items"))


@query("proxy_round_robin", "SELECT record_id, CASE (record_id - 1) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS choice FROM url_records")
def proxy_round_robin(spark, d):
    rows = table(spark, d, "url_records").select("record_id", (F.col("record_id") - 1).alias("pos"))
    return metrics.round_robin(rows, ["a", "b", "c"]).select("record_id", "choice")


@query(
    "csv_union_keys",
    "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment, '' AS phone FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '', 'n' || s_nationkey FROM supplier",
)
def csv_union_keys(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.concat(F.lit("n"), "s_nationkey").alias("phone"))
    return union_keys([a, b])


@query("stream_crawl", f"SELECT url, {_TITLE} AS title FROM pages")
def stream_crawl(spark, d):
    """Pages as a stream, extracted and written batch by batch until what is there is done."""
    pages = table(spark, d, "pages")
    folder = scratch(spark, "stream")
    pages.write.mode("overwrite").parquet(f"{folder}/in")
    stream = results.page_stream(spark, f"{folder}/in", pages.schema)
    q = results.run_available(extract.heuristic(stream).select("url", "title"), lambda batch, _: batch.write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint")
    q.awaitTermination()
    return spark.read.schema("url string, title string").parquet(f"{folder}/out")


_ISO = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)"


def _iso_sql(t: str, key: str, field: str) -> str:
    return (
        f"SELECT '{t}' AS tbl, {key} AS row_id, '{field}' AS field, strftime(try_cast(v AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') AS utc"
        f" FROM (SELECT {key}, {_trim(field)} AS v FROM {t}) WHERE regexp_full_match(v, '{_ISO}') AND try_cast(v AS TIMESTAMPTZ) IS NOT NULL"
    )


@query("stream_first_seen", f"SELECT DISTINCT {_norm('url')} AS norm FROM pages")
def stream_first_seen(spark, d):
    """A stream of pages, each twice, through the seen-set: every address once."""
    folder = scratch(spark, "seen")
    pages = table(spark, d, "pages").select("url", "page_id")
    pages.unionByName(pages).repartition(4).write.parquet(f"{folder}/in")
    stream = results.first_seen(results.page_stream(spark, f"{folder}/in", pages.schema, 1))
    q = results.run_available(stream, lambda batch, _: batch.select(urls.normalize(F.col("url")).alias("norm")).write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint")
    q.awaitTermination()
    return spark.read.schema("norm string").parquet(f"{folder}/out")


@query("p4_iso", " UNION ALL ".join([_iso_sql("url_records", "record_id", "lastmod"), _iso_sql("url_records", "record_id", "discovered_at"), _iso_sql("content_items", "item_id", "date")]))
def p4_iso(spark, d):
    """The part of p4_found that SQL can read too: values written as ISO instants with an offset."""
    records, items = table(spark, d, "url_records"), table(spark, d, "content_items")
    written = (
        records.select(F.lit("url_records").alias("tbl"), F.col("record_id").alias("row_id"), F.lit("lastmod").alias("field"), F.col("lastmod").alias("v"))
        .unionByName(records.select(F.lit("url_records").alias("tbl"), F.col("record_id").alias("row_id"), F.lit("discovered_at").alias("field"), F.col("discovered_at").alias("v")))
        .unionByName(items.select(F.lit("content_items").alias("tbl"), F.col("item_id").alias("row_id"), F.lit("date").alias("field"), F.col("date").alias("v")))
    )
    return p4_found(spark, d).join(written.where(urls.trimmed(F.col("v")).rlike(f"^{_ISO}$")), ["tbl", "row_id", "field"]).select("tbl", "row_id", "field", "utc")


@query("p4_found")
def p4_found(spark, d):
    """Every lastmod, discovered_at and printed date that denotes a moment, in UTC."""
    records, items, sites = (table(spark, d, t) for t in ("url_records", "content_items", "sites"))
    read = (
        timestamps.interpret(records, sites, "url_records/lastmod", "record_id", "lastmod", "url", "source")
        .unionByName(timestamps.interpret(records, sites, "url_records/discovered_at", "record_id", "discovered_at", "url", "source", local=False))
        .unionByName(timestamps.interpret(items, sites, "content_items/date", "item_id", "date", "url", None))
    )
    name = F.split(F.split_part("grp", F.lit("\t"), F.lit(1)), "/")
    return timestamps.choose(read).select(name[0].alias("tbl"), "row_id", name[1].alias("field"), "utc")
