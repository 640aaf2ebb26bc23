"""URL columns: RFC-3986 split by one regular expression, lenient on anything a page may hold."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The groups of RFC 3986, appendix B (scheme, authority, path, query, fragment).
SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def trimmed(url: Column) -> Column:
    """White space of any kind taken from both ends."""
    return F.regexp_replace(url, r"^\s+|\s+$", "")


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 5)


def normalize(url: Column) -> Column:
    """Lower scheme and host, drop the fragment and trailing slashes; path case and query stay."""
    u = trimmed(url)
    p = F.regexp_replace(path(u), "/+$", "")
    sch, net, q = scheme(u), netloc(u), query(u)
    head = F.concat(
        F.when(sch != "", F.concat(F.lower(sch), F.lit(":"))).otherwise(F.lit("")),
        F.when(net != "", F.concat(F.lit("//"), F.lower(net))).otherwise(F.lit("")),
    )
    return F.concat(head, F.when(p == "", F.lit("/")).otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def defrag(url: Column) -> Column:
    return F.regexp_replace(url, "#[\\s\\S]*$", "")


def origin(url: Column) -> Column:
    """``scheme://netloc`` as written."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def normalize_base(url: Column) -> Column:
    """``https://`` is assumed where no http scheme is given; the path is dropped."""
    full = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))
    return origin(full)


def site(url: Column) -> Column:
    """The host in lower case without user, ``www.`` and port; null where there is none."""
    host = F.regexp_extract(trimmed(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:@]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def same_origin_loose(a: Column, b: Column) -> Column:
    """Same network location; the scheme doesn't count, ``www.`` does."""
    return F.coalesce(F.lower(netloc(a)) == F.lower(netloc(b)), F.lit(False))


def same_origin_strict(a: Column, b: Column) -> Column:
    """Same scheme and network location."""
    return F.coalesce((scheme(a) == scheme(b)) & (F.lower(netloc(a)) == F.lower(netloc(b))), F.lit(False))


def is_xml(url: Column) -> Column:
    p = F.lower(path(url))
    return F.coalesce(p.endswith(".xml") | p.endswith(".xml.gz"), F.lit(False))


def looks_like_sitemap(url: Column) -> Column:
    p = F.lower(path(url))
    return F.coalesce(p.endswith(".xml") | p.contains("sitemap") | p.endswith(".xml.gz"), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A shell pattern (``*`` crosses slashes, ``?``, ``[a]``, ``[!a]``) as one anchored Java expression."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append("[\\s\\S]*")
        elif ch == "?":
            out.append("[\\s\\S]")
        elif ch == "[" and (end := pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append(f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]")
            i = end + 1
        else:
            out.append(re.sub(r"([\\.^$|()\[\]{}+*?])", r"\\\1", ch))
    return "^(?:" + "".join(out) + ")\\z"


def glob_match(link: Column, base: Column, patterns: list[str] | None) -> Column:
    """In scope of ``base`` and, if there are patterns, its path matches one of them; nulls don't match."""
    ok = link.startswith(base)
    if patterns:
        ok = ok & reduce(lambda a, b: a | b, [path(link).rlike(glob_regex(p)) for p in patterns])
    return F.coalesce(ok, F.lit(False))
