"""The four engines over a corpus table: site maps, links, scraping, crawling. ``run`` gives a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as settings_module
from ..functions import urls
from ..operators import extract, frontier, links, robots, sitemap
from ..operators.filters import Filter
from ..runtime import ship, small_or_plain
from ..schema import spark_type
from ..settings import Settings
from ..sinks.files import plain
from ..sources import corpus


#: Strategies of extraction beside the built-in ones: pages and settings to rows with ``url``.
STRATEGIES: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {}


def register_strategy(name: str, extract_pages: Callable[[DataFrame, Settings], DataFrame]) -> None:
    """Add a strategy, or put another in its place; settings then accept its name."""
    STRATEGIES[name] = extract_pages
    settings_module.OWN_STRATEGIES.add(name)


#: Times the limit at which a walk over sitemaps that nothing filters ends.
OVERFETCH = 3


@contextmanager
def timed(what: str, report=print):
    """Report the seconds a block takes."""
    start = time.perf_counter()
    try:
        yield
    finally:
        report(f"{what}: {time.perf_counter() - start:.2f} s")


class Engine:
    """Holds the session, the settings and the tables that stand for the web: pages(url, html), robots(base, body),
    sitemaps(url, body). A closed engine refuses to run."""

    def __init__(self, spark: SparkSession, pages: DataFrame | None = None, settings: Settings | None = None, robots_bodies: DataFrame | None = None, sitemap_bodies: DataFrame | None = None):
        ship(spark)
        self.spark, self.pages, self.settings = spark, pages, settings or Settings()
        self.robots, self.sitemaps = robots_bodies, sitemap_bodies
        self._open = True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        self._open = False

    def _ensure_open(self) -> None:
        if not self._open:
            raise RuntimeError(f"{type(self).__name__} is closed")

    def _seeds(self, url: str | Sequence[str]) -> DataFrame:
        found = [url] if isinstance(url, str) else list(url)
        return self.spark.createDataFrame([(u,) for u in found], "url string")

    def _extract(self, pages: DataFrame) -> DataFrame:
        s = self.settings
        if (own := STRATEGIES.get(s.scraping_strategy)) is not None:
            return own(pages, s)
        skip = list(s.exclude_selectors or ())
        if s.scraping_strategy == "markdownify":
            return extract.markdownify(pages, skip)
        if s.scraping_strategy == "genai":
            shape = s.genai.output_schema
            as_json = None if isinstance(shape, T.StructType) else shape
            kind = shape if isinstance(shape, T.StructType) else spark_type(shape)
            return extract.model_records(pages, kind, s.genai.generate, s.max_retries, skip, as_json)
        content = extract.heuristic(pages)
        return content if s.scraping_output_format == "json" else extract.formatted(content, s.scraping_output_format)


class SiteMap(Engine):
    """Addresses of a site: its sitemaps, else links from its pages."""

    def run(self, url: str, limit: int | None = None) -> DataFrame:
        """(url) in order of discovery, after robots, dates, include patterns and deduplication."""
        self._ensure_open()
        s, m = self.settings, self.settings.sitemap
        seed = self._seeds(url).select(urls.normalize_base(F.col("url")).alias("base"))
        base = urls.normalize_base(F.lit(url))
        own_robots = self.robots.where(F.col("base") == base) if self.robots is not None else None
        rows = None
        if self.sitemaps is not None:
            named = robots.sitemap_directives(own_robots).select("base", "sitemap") if own_robots is not None else None
            probed = sitemap.probe_common_paths(seed, self.sitemaps)
            roots = probed if named is None else named.unionByName(probed).distinct()
            # Without filters that drop records, a few times the limit is enough.
            filtered = m.start_date or m.end_date or s.include_link_patterns
            target = None if limit is None or filtered else OVERFETCH * limit
            rows = frontier.sitemap_records(self.sitemaps, roots.select(F.col("sitemap").alias("url")), m.follow_index, target=target)
            if rows.isEmpty():
                rows = None
        if rows is None and m.html_fallback and self.pages is not None:
            rules = own_robots if m.respect_robots else None
            found = frontier.html_fallback(self.pages, seed.select(F.col("base").alias("url")), m.max_depth, m.max_pages, rules)
            rows = found.select("url", F.lit("html_crawl").alias("source"), F.lit(None).cast("string").alias("lastmod"), "depth", F.col("seq").alias("pos"))
        if rows is None:
            return self.spark.createDataFrame([], "url string")
        order = ["depth", "source", "pos", "url"]
        if own_robots is not None and m.respect_robots:
            # The seed's rules hold for every record, whatever its host; one body of one site comes to the driver.
            own = own_robots.select("body").first()
            rows = rows.where(robots.allowed_by(F.col("url"), own["body"] if own else None))
        picked = sitemap.select_urls(rows, order, m.start_date, m.end_date, m.strict_date_filter, list(s.include_link_patterns or ()) or None, base, None, m.deduplicate, limit)
        return picked.select("url")


class LinkExtractor(Engine):
    """Links of a page (shallow) or of all pages reachable from it (deep)."""

    def run(self, url: str | Sequence[str]) -> DataFrame:
        self._ensure_open()
        s = self.settings
        include, exclude = list(s.include_link_patterns or ()), list(s.exclude_link_patterns or ())
        if s.link_extraction_strategy == "shallow":
            own = self.pages.join(small_or_plain(self._seeds(url)), "url", "left_semi")
            return links.shallow_links(own, include, exclude, s.link_extraction_limit, "url").select(F.col("link").alias("url"))
        return frontier.deep_links(self.pages, self._seeds(url), include, exclude, s.link_extraction_limit).select("url")

    def stream(self, url: str | Sequence[str]) -> Iterator[str]:
        """Deep links as partitions come in."""
        if self.settings.link_extraction_strategy != "deep":
            raise AssertionError("only deep extraction can be streamed")
        return (r["url"] for r in self.run(url).toLocalIterator())


class Scraper(Engine):
    """Content of given addresses."""

    def run(self, url: str | Sequence[str]) -> DataFrame:
        """(url, result); addresses without page or content drop out, repeated ones repeat."""
        self._ensure_open()
        pages = corpus.fetch(self._seeds(url), self.pages)
        return extract.wrap_scrape(self._extract(pages))

    def results(self, url: str | Sequence[str]) -> list[dict] | dict | None:
        """The rows as plain values: for one address its result or None, for several a list with those that have one.

        Meant for what a person asks for: the results come to the driver.
        """
        found = [plain(r) for r in self.stream(url)]
        return (found[0] if found else None) if isinstance(url, str) else found

    def stream(self, url: str | Sequence[str]) -> Iterator[Row]:
        return self.run(url).toLocalIterator()


class Crawler(Engine):
    """Breadth-first discovery, extraction and filters in one plan."""

    def run(self, url: str | Sequence[str], filters: Filter | None = None, limit: int | None = None) -> DataFrame:
        """Content rows beside their address; the limit counts pages that pass the filter."""
        self._ensure_open()
        s = self.settings
        n = s.link_extraction_limit if limit is None else limit
        found = frontier.crawl(self.pages, self._seeds(url), lambda visited: extract.wrap_crawl(self._extract(visited)), filters, list(s.include_link_patterns or ()), list(s.exclude_link_patterns or ()), n)
        return found.drop("depth")

    def stream(self, url: str | Sequence[str], filters: Filter | None = None) -> Iterator[Row]:
        return self.run(url, filters).toLocalIterator()
