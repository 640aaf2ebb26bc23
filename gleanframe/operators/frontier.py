"""Breadth-first discovery as a loop of joins: each level is written to the shared folder before the next."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..runtime import BROADCAST_ROWS, materialize, small_or_plain
from . import links, robots, sitemap
from .filters import Filter, keep

#: Sites of seeds up to which pages are picked by the beginnings of their addresses, which reach the scan as filters.
MAX_PREFIXES = 64
#: Levels after which what is known is written together, so that a deep walk's plans stay small.
COMPACT = 16


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, limit: int | None = None, max_level: int | None = None, until: Callable[[DataFrame], bool] | None = None, on_level: Callable[[int, int], None] | None = None) -> DataFrame:
    """(url, depth, parent, pos) of everything reachable over ``edges`` (src, dst, pos) from ``seeds`` (url).

    Each address comes once, at its least depth, from the least (parent, pos) there; seeds have depth 0 and no parent.
    With ``limit`` the loop ends once that many addresses beside the seeds are known, and the first of them in (depth,
    parent, pos) are kept. ``max_level`` bounds a level like a full queue: what is dropped may come back later.
    Without ``max_depth`` the loop ends at the first level that brings nothing new, as it must on any table of edges.
    ``until`` is asked with each level, the seeds' among them, and ends the loop; ``on_level`` is told each level's depth
    and size. If edges have ``priority`` (boolean), addresses reached with it go ahead of others of their level. A level is one shuffled join and one anti-join on narrow rows; no level is held on the driver.
    """
    late = ~F.coalesce("priority", F.lit(False)) if "priority" in edges.columns else F.lit(False)
    edges = edges.select("src", "dst", "pos", late.alias("late")).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    edges = materialize(edges.distinct(), "edges")
    shape = [F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("pos"), F.lit(False).alias("late")]
    known = materialize(seeds.select("url").where(F.col("url").isNotNull()).distinct().select("url", F.lit(0).alias("depth"), *shape), "level-0")
    level, found = known, 0
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        if limit is not None and found >= limit or until is not None and until(level):
            break
        step = level.select(F.col("url").alias("_from")).join(edges, F.col("_from") == F.col("src"))
        first = step.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("late", "src", "pos")).alias("_by"))
        new = first.join(known.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), F.col("_by.src").alias("parent"), F.col("_by.pos").cast("int").alias("pos"), "_by.late")
        if max_level is not None:
            new = new.orderBy("late", "parent", "pos", "url").limit(max_level)
        level = materialize(new, f"level-{depth}")
        size = level.count()
        if not size:
            break
        if on_level is not None:
            on_level(depth, size)
        found += size
        known = known.unionByName(level)
        if depth % COMPACT == 0:
            known = materialize(known, f"known-{depth}")
    if limit is not None:
        reached = known.where("depth > 0").orderBy("depth", "late", "parent", "pos", "url").limit(max(0, limit))
        known = known.where("depth = 0").unionByName(reached)
    return known.drop("late")


def link_edges(pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(src, dst, pos) same-site links in scope, fragments dropped on both sides."""
    found = links.same_site_links(pages, include, exclude)
    return found.select(urls.defrag(F.col("page_url")).alias("src"), F.col("link").alias("dst"), "pos")


def site_pages(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """The pages on the seeds' sites, the only ones that a walk over same-site links can reach.

    Few sites come as beginnings of addresses, so that the scan can skip what lies elsewhere; many by a join.
    """
    sites = materialize(seeds.select(urls.origin(F.col("url")).alias("_site")).dropna().distinct(), "seed-sites")
    few = [r["_site"] for r in sites.limit(MAX_PREFIXES + 1).collect()]
    if len(few) > MAX_PREFIXES:
        return pages.join(small_or_plain(sites), urls.origin(F.col("url")) == F.col("_site"), "left_semi")
    # Hosts are compared without case, so their pages may write them in other ways.
    plain, other = F.lit(False), F.lit(False)
    for s in few:
        plain |= F.col("url").startswith(s)
        other |= F.lower(urls.origin(F.col("url"))) == s.lower()
    return pages.where(plain | other)


def _page_links(level: DataFrame, pages: DataFrame, include: list[str] | None, exclude: list[str] | None) -> DataFrame:
    """(src, dst, pos) links of the pages of a level."""
    at = pages.join(small_or_plain(level.select(F.col("url").alias("_at"))), urls.defrag(F.col("url")) == F.col("_at"), "left_semi")
    return link_edges(at, include, exclude)


def deep_links(pages: DataFrame, seeds: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, limit: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(url, depth) links found from the seeds, in scope; links count when found, whether or not their page is there.

    The seeds aren't links, unless one links to them: a link to a seed counts at the least depth at which it is found.
    Only pages on the seeds' sites are read. Without ``limit`` their links are taken once, for all levels; with it only
    the pages of a level are parsed, and the walk ends at the level that brings the last link.
    """
    empty = seeds.select("url", F.lit(0).alias("depth")).where(F.lit(False))
    if limit == 0:
        return empty
    pages = site_pages(pages, seeds)
    edges = materialize(link_edges(pages, include, exclude).distinct(), "link-edges") if limit is None else None
    level = start = materialize(seeds.select("url").where(F.col("url").isNotNull()).distinct(), "seeds")
    found: DataFrame | None = None
    total = 0
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        at = edges.join(level.select(F.col("url").alias("src")), "src", "left_semi") if edges is not None else _page_links(level, pages, include, exclude)
        new = at.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("src", "pos")).alias("_by"))
        if found is not None:
            new = new.join(found.select("url"), "url", "left_anti")
        level = materialize(new.select("url", F.lit(depth).alias("depth"), F.col("_by.src").alias("parent"), F.col("_by.pos").alias("pos")), f"links-{depth}")
        size = level.count()
        if not size:
            break
        total += size
        found = level if found is None else found.unionByName(level)
        if depth % COMPACT == 0:
            found = materialize(found, f"found-{depth}")
        if limit is not None and total >= limit:
            break
        level = level.join(small_or_plain(start), "url", "left_anti")
    if found is None:
        return empty
    if limit is not None:
        found = found.orderBy("depth", "parent", "pos", "url").limit(limit)
    return found.select("url", "depth")


def crawl(pages: DataFrame, seeds: DataFrame, extracted: DataFrame | Callable[[DataFrame], DataFrame], content_filter: Filter | None = None, include: list[str] | None = None, exclude: list[str] | None = None, limit: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Content (with ``url``) of the pages visited from the seeds that passes the filter, with ``depth``.

    ``extracted`` are rows of content, or what makes them of pages: then only visited pages are extracted. Links of
    filtered pages are still followed; filtered pages don't count toward the limit. Only pages on the seeds' sites are
    read. With ``limit`` a level's pages are parsed and extracted when the level is reached, and the walk ends at the
    level that brings the last row.
    """
    pages = site_pages(pages, seeds)

    def content(visited: DataFrame) -> DataFrame:
        at = visited.select(F.col("url").alias("_visited"), "depth", "parent", "pos")
        if callable(extracted):
            own = pages.join(small_or_plain(at.select("_visited")), urls.defrag(F.col("url")) == F.col("_visited"), "left_semi")
            rows = extracted(own)
        else:
            rows = extracted
        return keep(rows.join(at, urls.defrag(F.col("url")) == F.col("_visited")).drop("_visited"), content_filter)

    if limit is None:
        reached = materialize(traverse(link_edges(pages, include, exclude), seeds, max_depth), "reached")
        return content(reached).drop("parent", "pos")
    known = level = materialize(seeds.select("url").where(F.col("url").isNotNull()).distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("pos")), "level-0")
    rows, total = [], 0
    for depth in itertools.count(1):
        rows.append(materialize(content(level), f"content-{depth}"))
        total += rows[-1].count()
        if total >= limit or max_depth is not None and depth > max_depth:
            break
        new = _page_links(level, pages, include, exclude).groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("src", "pos")).alias("_by")).join(known.select("url"), "url", "left_anti")
        level = materialize(new.select("url", F.lit(depth).alias("depth"), F.col("_by.src").alias("parent"), F.col("_by.pos").cast("int").alias("pos")), f"level-{depth}")
        if level.isEmpty():
            break
        known = known.unionByName(level)
        if depth % COMPACT == 0:
            known = materialize(known, f"known-{depth}")
            rows = [materialize(functools.reduce(DataFrame.unionByName, rows), f"content-to-{depth}")]
    both = functools.reduce(DataFrame.unionByName, rows)
    return both.orderBy("depth", "parent", "pos", "url").limit(max(0, limit)).drop("parent", "pos")


def sitemap_records(bodies: DataFrame, roots: DataFrame, follow_index: bool = True, max_depth: int | None = None, target: int | None = None) -> DataFrame:
    """(url, source, lastmod, changefreq, priority, depth, pos) of all sitemaps reachable from ``roots`` (url).

    Bodies are scanned once; the loop runs over the edges from index to child only. With ``target`` it ends at the
    level where that many records are known; levels are whole, so there may be more.
    """
    entries = materialize(sitemap.scan(bodies), "sitemap-entries")
    edges = entries.where("kind = 'sitemap'").select(F.col("sitemap").alias("src"), F.col("loc").alias("dst"), "pos")
    sizes = materialize(entries.where("kind = 'url'").groupBy(F.col("sitemap").alias("_s")).agg(F.count("*").alias("n")), "sitemap-sizes") if target is not None else None
    known = 0

    def enough(level: DataFrame) -> bool:
        nonlocal known
        known += level.join(sizes, F.col("url") == F.col("_s")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return known >= target

    reached = traverse(edges, roots, max_depth if follow_index else 0, until=enough if target is not None else None)
    rows = entries.where("kind = 'url'").join(reached.select(F.col("url").alias("_s"), "depth"), F.col("sitemap") == F.col("_s"))
    return rows.select(F.col("loc").alias("url"), F.col("sitemap").alias("source"), "lastmod", "changefreq", "priority", "depth", "pos")


def _resource(url: Column) -> Column:
    """What is fetched for an address: without fragment, an empty path is the root."""
    return F.regexp_replace(urls.defrag(url), r"^(\w+://[^/?#]+)(?=\?|$)", "$1/")


def html_fallback(pages: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int = 500, robots_bodies: DataFrame | None = None) -> DataFrame:
    """(url, depth, seq) of the pages that a walk over same-host links finds where a site has no sitemap.

    The walk goes page by page in order, but is done level by level: a level's addresses are ordered by their parent's
    place and their place in it, and the first of those that are the same when normalised counts. Every address taken
    counts toward ``max_pages``, also one that robots rules disallow or that isn't held; neither of these is a result or
    is followed. Results are written as the link had them; ``seq`` is their place among all addresses taken.
    """
    level = materialize(seeds.select(F.col("url"), urls.normalize(F.col("url")).alias("norm"), F.lit(0).alias("up"), F.monotonically_increasing_id().alias("pos")).where(F.col("url").isNotNull()), "fallback-seeds")
    pages = site_pages(pages.where(F.length("html") > 0), seeds)
    known: DataFrame | None = None
    results, taken = [], 0
    for depth in range(max_depth + 1):
        first = level.groupBy("norm").agg(F.min(F.struct("up", "pos", "url")).alias("_by")).select("norm", "_by.*")
        if known is not None:
            first = first.join(known, "norm", "left_anti")
        # At most max_pages rows: their order is one task's.
        some = materialize(first.orderBy("up", "pos", "url").limit(max_pages - taken), f"fallback-{depth}")
        some = materialize(some.withColumn("seq", F.lit(taken) + F.row_number().over(Window.orderBy("up", "pos", "url")) - 1), f"fallback-seq-{depth}")
        size = some.count()
        if not size:
            break
        taken += size
        known = some.select("norm") if known is None else known.unionByName(some.select("norm"))
        ok = some if robots_bodies is None else robots.allowed(some, robots_bodies).where("allowed").drop("allowed")
        at = ok.select(F.col("url").alias("_url"), "seq")
        at = F.broadcast(at) if size <= BROADCAST_ROWS else at
        held = pages.join(at, _resource(F.col("url")) == _resource(F.col("_url"))).withColumn("url", F.col("_url")).drop("_url")
        held = materialize(held.dropDuplicates(["seq"]), f"fallback-held-{depth}")
        results.append(held.select("url", F.lit(depth).alias("depth"), "seq"))
        if taken >= max_pages:
            break
        found = links.fallback_links(held, "seq").select(F.col("page_id").alias("up"), "pos", F.col("link").alias("url"))
        level = found.withColumn("norm", urls.normalize(F.col("url")))
    if not results:
        return seeds.select("url", F.lit(0).alias("depth"), F.lit(0).alias("seq")).where(F.lit(False))
    return functools.reduce(DataFrame.unionByName, results)
