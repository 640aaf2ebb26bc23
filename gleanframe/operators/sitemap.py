"""Sitemaps: scans of urlset, index, feed and broken bodies, and the pipeline from records to addresses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.dates import in_range, lastmod_date
from . import dedupe, links, robots

# Places where a site's sitemap is looked for.
COMMON_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap.xml.gz", "/index-sitemap.xml", "/sitemap/sitemap.xml")

#: Entries that a task holds before it passes them on.
ROWS = 10_000
_ENTRIES = T.StructType([T.StructField("sitemap", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType()), *[T.StructField(f, T.StringType()) for f in ("loc", "lastmod", "changefreq", "priority")]])
_FIELDS = {f: i for i, f in enumerate(("loc", "lastmod", "changefreq", "priority"))}

_SPACE = re.compile(r"\s*", re.ASCII)
_OPENED = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)")
_CLOSED = re.compile(r"</([A-Za-z_][A-Za-z0-9_.:-]*)>")
_LOC = re.compile(r"<loc>\s*(http[^<]+?)\s*</loc>", re.ASCII)
_HREF = re.compile(r"""href=["'](http[^"']+)["']""")
_FEED = re.compile(r"<(?:[A-Za-z0-9_]+:)?(?:link|id)\b[^>/]*>\s*(http[^<]*?)\s*</", re.ASCII)
_SPACES = " \t\n\r\f\v"


def _first_tag(body: str) -> str:
    """The name of the first element after declarations and comments, empty if there is none."""
    at = _SPACE.match(body).end()
    while body.startswith(("<?", "<!"), at):
        end = "-->" if body.startswith("<!--", at) else "?>" if body.startswith("<?", at) else ">"
        if (stop := body.find(end, at + (4 if end == "-->" else 2))) < 0:
            return ""
        at = _SPACE.match(body, stop + len(end)).end()
    found = _OPENED.match(body, at)
    return found[1] if found else ""


def _last_tag(body: str) -> str:
    """The name of the closing tag at the end, comments aside; empty if the body doesn't end so."""
    end = len(body.rstrip(_SPACES))
    while body.endswith("-->", 0, end) and (start := body.rfind("<!--", 0, end)) >= 0:
        end = len(body[:start].rstrip(_SPACES))
    start = body.rfind("</", 0, end)
    found = _CLOSED.fullmatch(body, start, end) if start >= 0 else None
    return found[1] if found else ""


def _elements(body: str, name: str) -> list[list[str | None]] | None:
    """The fields of each element ``name`` right under the root, namespaces aside; what follows the root isn't
    read, and None stands for a body that can't be parsed."""
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    path: list[str] = []
    out: list[list[str | None]] = []
    held: list[str] = []

    def opened(tag: str, _) -> None:
        path.append(tag.rsplit(":", 1)[-1].lower())
        if len(path) == 2 and path[1] == name:
            out.append([None] * len(_FIELDS))
        elif len(path) == 3:
            held.clear()

    def closed(_) -> None:
        if len(path) == 3 and path[1] == name and path[2] in _FIELDS:
            out[-1][_FIELDS[path[2]]] = "".join(held)
        path.pop()

    def text(s: str) -> None:
        if len(path) == 3:
            held.append(s)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, text
    try:
        parser.Parse(body.lstrip(_SPACES).encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        if e.code != expat.errors.codes[expat.errors.XML_ERROR_JUNK_AFTER_DOC_ELEMENT]:
            return None
    return out


def _read(body: str) -> tuple[str, list[list[str | None]]]:
    """Kind and entries of a body."""
    first = _first_tag(body)
    root = first.lower()
    if first and first.rsplit(":", 1)[-1] == _last_tag(body).rsplit(":", 1)[-1]:
        if "sitemapindex" in root or "urlset" in root:
            kind, name = ("sitemap", "sitemap") if "sitemapindex" in root else ("url", "url")
            found = _elements(body, name)
            if found is not None:
                return kind, [e if kind == "url" else [e[0], None, None, None] for e in found]
        elif "rss" in root or "feed" in root:
            return "url", [[u, None, None, None] for u in _FEED.findall(body)]
    return "url", [[u, None, None, None] for u in dict.fromkeys(_LOC.findall(body) + _HREF.findall(body))]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for sitemap, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            kind, entries = _read(body)
            for start in range(0, len(entries), ROWS):
                part = entries[start : start + ROWS]
                fields = [pa.array([e[i] for e in part], pa.string()) for i in range(len(_FIELDS))]
                places = pa.array(range(start, start + len(part)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([sitemap] * len(part), pa.string()), pa.array([kind] * len(part)), places, *fields], names=_ENTRIES.fieldNames())


def scan(bodies: DataFrame, url_col: str = "url", body_col: str = "body") -> DataFrame:
    """(sitemap, kind, pos, loc, lastmod, changefreq, priority) of each entry; kind is ``sitemap`` for children, else ``url``.

    The root element decides, namespaces aside: an index gives children, a urlset records, a feed its http links; what
    can't be parsed or has another root gives the addresses a pattern finds. Entries without address and null or empty
    bodies give nothing; empty fields are null. External entities aren't read. A body is read once, from one end to the
    other, however many entries it has.
    """
    rows = bodies.select(F.col(url_col).alias("sitemap"), F.col(body_col).alias("body")).where(F.col("body").isNotNull() & (F.trim("body") != ""))
    out = rows.mapInArrow(_scanned, _ENTRIES)
    return out.select("sitemap", "kind", "pos", *[F.nullif(urls.trimmed(F.col(f)), F.lit("")).alias(f) for f in _FIELDS]).where(F.col("loc").isNotNull())


def probe_common_paths(bases: DataFrame, bodies: DataFrame, base_col: str = "base", url_col: str = "url", body_col: str = "body") -> DataFrame:
    """(base, sitemap) of the usual places that hold a body."""
    places = F.explode(F.array(*[F.concat(F.col(base_col), F.lit(p)) for p in COMMON_PATHS]))
    candidates = bases.select(F.col(base_col).alias("base"), places.alias("sitemap"))
    there = bodies.where(F.length(body_col) > 0).select(F.col(url_col).alias("_url"))
    return candidates.join(there, F.col("sitemap") == F.col("_url"), "left_semi")


def sitemaps_of(robots_bodies: DataFrame, bodies: DataFrame) -> DataFrame:
    """(base, sitemap) from robots directives, and from the usual places those don't name."""
    named = robots.sitemap_directives(robots_bodies).select("base", "sitemap").distinct()
    probed = probe_common_paths(robots_bodies.select("base"), bodies)
    return named.unionByName(probed.join(named, ["base", "sitemap"], "left_anti"))


def select_urls(records: DataFrame, order: list[str], start: date | None = None, end: date | None = None, strict: bool = False, include: list[str] | None = None, base: str | Column | None = None, robots_bodies: DataFrame | None = None, deduplicate: bool = True, limit: int | None = None) -> DataFrame:
    """Records (with ``url`` and ``lastmod``) that a site map yields: robots, date range, no sitemaps, include, first of
    each normalised address, limit, in this order. ``base`` bounds the include patterns; null addresses are dropped."""
    rows = records.where(F.col("url").isNotNull())
    if robots_bodies is not None:
        rows = robots.allowed(rows, robots_bodies).where("allowed").drop("allowed")
    rows = rows.where(in_range(lastmod_date(F.col("lastmod")), start, end, strict) & ~urls.is_xml(F.col("url")))
    if include:
        bound = urls.origin(F.col("url")) if base is None else F.lit(base) if isinstance(base, str) else base
        rows = links.in_scope(rows, bound, include, None, "url")
    if deduplicate:
        rows = dedupe.dedupe_by_url(rows, order)
    return dedupe.limit_in_order(rows, limit, order)
