"""Links of pages: extraction, resolution and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# The shapes of href attributes, of anchors only or of any element.
ANCHOR = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)"""
ANY_HREF = r"""(?i)href\s*=\s*["']([^"'#\s]+)"""


def _merged_path(base: Column, href: Column) -> Column:
    """The path of a relative reference against the base's, dot segments (and a relative one's empty middle segments) removed."""
    own, above = F.split(urls.path(href), "/"), F.split(urls.path(base), "/")
    folder = F.when(F.element_at(above, -1) == "", above).otherwise(F.slice(above, 1, F.size(above) - 1))
    both = F.concat(folder, own)
    both = F.filter(both, lambda s, i: (i == 0) | (i == F.size(both) - 1) | (s != ""))
    parts = F.when(urls.path(href).startswith("/"), own).otherwise(both)
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    walked = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    path = F.array_join(walked, "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def resolve(base: Column, href: Column) -> Column:
    """``href`` as seen from the web address ``base``, by RFC 3986 as browsers and the standard library read it.

    All of it stays in the JVM; absolute and plain root-relative links, the bulk, take the first two branches. Other
    schemes (``mailto:``) stay as they are, an empty reference is the base itself, null gives null.
    """
    h = urls.trimmed(href)
    plain = h.rlike(r"^/(?!/)[^?#]*$") & ~h.contains("/.") & ~h.contains("//")
    query, fragment = urls.query(h), urls.fragment(h)
    tail = F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit(""))
    asked = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    inherited = F.when(query != "", query).otherwise(urls.query(base))
    same_page = F.concat(urls.origin(base), urls.path(base), F.when(inherited != "", F.concat(F.lit("?"), inherited)).otherwise(F.lit("")), tail)
    return (
        F.when(h.rlike(r"^https?://"), h)
        .when(plain, F.concat(urls.origin(base), h))
        .when((urls.scheme(h) != "") & (urls.scheme(h) != urls.scheme(base)), h)
        .when(urls.netloc(h) != "", F.concat(urls.scheme(base), F.lit(":"), F.regexp_replace(h, "^[^/]*", "")))
        .when(h == "", base)
        .when(urls.path(h) == "", same_page)
        .otherwise(F.concat(urls.origin(base), _merged_path(base, h), asked, tail))
    )


def page_links(pages: DataFrame, pattern: str = ANCHOR, id_col: str = "page_id") -> DataFrame:
    """(page_id, page_url, pos, href, link) of every link of every page, in order; scripts included as they are written.

    Pages without html or address give nothing.
    """
    found = pages.select(F.col(id_col).alias("page_id"), F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("pos", "href"))
    return found.withColumn("link", resolve(F.col("page_url"), F.col("href"))).where(F.col("link").isNotNull())


def _scheme_ok(href: Column) -> Column:
    return ~F.lower(href).startswith("mailto:") & ~F.lower(href).startswith("javascript:")


def fallback_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Same-host links of any element for crawls without a sitemap: no fragments, duplicates kept."""
    found = page_links(pages, ANY_HREF, id_col)
    return found.where(_scheme_ok(F.col("href")) & urls.same_origin_loose(F.col("link"), F.col("page_url")))


def shallow_links(pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, limit: int | None = None, id_col: str = "page_id") -> DataFrame:
    """(page_id, link) distinct internal links of each page itself: same host as written, any scheme, not the page.

    ``limit`` holds per page, in order of place; 0 gives nothing, None all.
    """
    rows = page_links(pages, ANCHOR, id_col).withColumn("link", urls.defrag(F.col("link")))
    page, link = F.col("page_url"), F.col("link")
    inside = _scheme_ok(F.col("href")) & (urls.netloc(link) == urls.netloc(page)) & (F.regexp_replace(link, "/+$", "") != F.regexp_replace(page, "/+$", ""))
    rows = in_scope(rows.where(inside), urls.origin(link), include, exclude)
    firsts = rows.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    if limit is not None:
        # A page's own links only: bounded by the page.
        kept = firsts.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "link"))), 1, max(limit, 1)).alias("l"))
        firsts = kept.select("page_id", F.explode("l").alias("l")).select("page_id", "l.link") if limit > 0 else firsts.where(F.lit(False))
    return firsts.select("page_id", "link")


def in_scope(rows: DataFrame, base: Column, include: list[str] | None, exclude: list[str] | None, link_col: str = "link") -> DataFrame:
    """Rows whose link matches an include pattern (if any) and no exclude pattern."""
    link = F.col(link_col)
    if include:
        rows = rows.where(urls.glob_match(link, base, include))
    if exclude:
        rows = rows.where(~urls.glob_match(link, base, exclude))
    return rows


def same_site_links(pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, id_col: str = "page_id") -> DataFrame:
    """(page_id, page_url, pos, link) links with the page's scheme and host, fragments dropped, in scope."""
    rows = page_links(pages, ANCHOR, id_col).withColumn("link", urls.defrag(F.col("link")))
    rows = rows.where(urls.same_origin_strict(F.col("link"), F.col("page_url")))
    return in_scope(rows, urls.origin(F.col("page_url")), include, exclude).select("page_id", "page_url", "pos", "link")
