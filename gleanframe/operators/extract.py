"""Content of pages: deterministic extraction in the JVM, Markdown by a streaming parser, model-shaped records."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONTENT

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, _HIDDEN, " ")


# Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Cutter(HTMLParser):
    """Places (start, end) of the elements that selectors choose, nested ones of the same tag included."""

    def __init__(self, html: str, tags: frozenset[str], classes: frozenset[str], ids: frozenset[str]):
        super().__init__(convert_charrefs=False)
        self.html, self.tags, self.classes, self.ids = html, tags, classes, ids
        self.starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.cuts: list[tuple[int, int]] = []
        self.open: tuple[str, int] | None = None
        self.depth = 0
        self.feed(html)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _chosen(self, tag: str, attrs) -> bool:
        found = {k: v or "" for k, v in attrs}
        return tag in self.tags or not self.classes.isdisjoint(found.get("class", "").split()) or found.get("id") in self.ids

    def handle_starttag(self, tag, attrs):
        if self.open is not None:
            self.depth += tag == self.open[0]
        elif self._chosen(tag, attrs):
            if tag in _VOID:
                self.handle_startendtag(tag, attrs)
            else:
                self.open, self.depth = (tag, self._at()), 1

    def handle_startendtag(self, tag, attrs):
        if self.open is None and self._chosen(tag, attrs):
            self.cuts.append((self._at(), self._at() + len(self.get_starttag_text() or "")))

    def handle_endtag(self, tag):
        if self.open is not None and tag == self.open[0]:
            self.depth -= 1
            if not self.depth:
                end = self.html.find(">", self._at())
                self.cuts.append((self.open[1], len(self.html) if end < 0 else end + 1))
                self.open = None

    def result(self) -> str:
        out, last = [], 0
        for a, b in self.cuts:
            out += [self.html[last:a], " "]
            last = b
        return "".join(out) + self.html[last:]


def without_elements(html: Column, selectors: Sequence[str]) -> Column:
    """The page without elements chosen by tag, ``.class`` or ``#id``, whatever is nested in them; unclosed ones stay.

    Elements chosen by tag that hold none of their kind are cut in the JVM; a parser in Arrow batches reads only pages
    with nested ones, or in which a class or id occurs at all.
    """
    tags = [s.lower() for s in selectors if not s.startswith((".", "#"))]
    classes, ids = [s[1:] for s in selectors if s.startswith(".")], [s[1:] for s in selectors if s.startswith("#")]
    cut, parse = html, F.lit(False)
    for t in tags:
        cut = F.regexp_replace(cut, rf"(?is)<{re.escape(t)}\b.*?</{re.escape(t)}\s*>", " ")
    for t in tags:
        parse |= cut.rlike(rf"(?i)</{re.escape(t)}\s*>")
    for name in (*classes, *ids):
        parse |= html.contains(name)
    chosen = frozenset(tags), frozenset(classes), frozenset(ids)

    @F.pandas_udf(T.StringType())
    def parsed(pages: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else _Cutter(h, *chosen).result() for h in pages], dtype="object")

    return F.when(parse, parsed(F.when(parse, html))).otherwise(cut)


def squeezed(text: Column) -> Column:
    """ASCII white space squeezed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def title(html: Column) -> Column:
    return F.nullif(squeezed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)), F.lit(""))


def page_lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang=["']([^"']*)""", 1), F.lit(""))


def page_date(html: Column) -> Column:
    """The day of a published or modified time in the page's metadata or its first time element."""
    meta = F.regexp_extract(html, r"""(?is)<meta\b[^>]*(?:article:published_time|date)["'][^>]*content=["'](\d{4}-\d{2}-\d{2})""", 1)
    return F.nullif(F.coalesce(F.nullif(meta, F.lit("")), F.regexp_extract(html, r"""(?is)<time\b[^>]*datetime=["'](\d{4}-\d{2}-\d{2})""", 1)), F.lit(""))


def main_html(html: Column) -> Column:
    """The first article, else main, else body, else all; of the visible page."""
    v = visible(html)

    def part(tag: str) -> Column:
        return F.nullif(F.regexp_extract(v, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))

    return F.coalesce(part("article"), part("main"), part("body"), v)


def text_of(html: Column) -> Column:
    """Text without tags; character references stay as written."""
    return F.nullif(squeezed(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), F.lit(""))


def heuristic(pages: DataFrame, exclude: Sequence[str] = (), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """CONTENT rows: ``url``, ``text`` of the main part, ``raw_text`` of the whole page, ``title``, ``lang``, ``date``.

    Pages without html or without text give no row (a failed extraction).
    """
    raw = F.col(html_col)
    html = without_elements(raw, exclude) if exclude else raw
    rows = pages.select(F.col(url_col).alias("url"), text_of(main_html(html)).alias("text"), text_of(visible(raw)).alias("raw_text"), title(raw).alias("title"), page_lang(raw).alias("lang"), page_date(raw).alias("date"))
    return rows.where(F.col("text").isNotNull())


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def formatted(content: DataFrame, output: str = "json") -> DataFrame:
    """(url, result): the content as a JSON object, Markdown, XML or TEI-XML."""
    if output == "json":
        fields = [F.col(f) for f in CONTENT.fieldNames() if f in content.columns and f != "url"]
        return content.select("url", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("result"))
    if output == "markdown":
        head = F.when(F.col("title").isNotNull(), F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"))).otherwise(F.lit(""))
        return content.select("url", F.concat(head, F.col("text")).alias("result"))
    t, x, u = _escaped(F.col("title")), _escaped(F.col("text")), _escaped(F.col("url"))
    if output == "xml":
        return content.select("url", F.concat(F.lit('<doc title="'), F.replace(t, F.lit('"'), F.lit("&quot;")), F.lit('" source="'), u, F.lit('"><main><p>'), x, F.lit("</p></main></doc>")).alias("result"))
    if output == "xmltei":
        return content.select("url", F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), t, F.lit("</title></titleStmt><sourceDesc><p>"), u, F.lit("</p></sourceDesc></fileDesc></teiHeader><text><body><p>"), x, F.lit("</p></body></text></TEI>")).alias("result"))
    raise ValueError(f"output must be json, markdown, xml or xmltei, not {output}")


# Elements without an end tag, and elements that part blocks of text.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("p div section article main header footer aside nav ul ol table tr blockquote pre form figure h1 h2 h3 h4 h5 h6 li hr title".split())


class MarkdownWriter(HTMLParser):
    """Markdown from parser events: ATX headings, ``-`` bullets, links, emphasis, code; excluded elements skipped with
    all they hold."""

    def __init__(self, exclude: Sequence[str] = ()):
        super().__init__(convert_charrefs=True)
        self.tags = {s.lower() for s in exclude if not s.startswith((".", "#"))} | {"script", "style", "template", "noscript"}
        self.classes = {s[1:] for s in exclude if s.startswith(".")}
        self.ids = {s[1:] for s in exclude if s.startswith("#")}
        self.out: list[str] = []
        self.skip: list[str] = []
        self.lists: list[list] = []
        self.hrefs: list[str | None] = []
        self.pre = 0

    def _block(self) -> None:
        self.out.append("\n\n" if not self.lists else "\n")

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip:
            if tag not in _VOID and tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in self.tags or self.classes & set((a.get("class") or "").split()) or a.get("id") in self.ids and a.get("id"):
            if tag not in _VOID:
                self.skip.append(tag)
            return
        if tag in ("ul", "ol"):
            if not self.lists:
                self._block()
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "a":
            self.hrefs.append(a.get("href"))
            self.out.append("[" if a.get("href") else "")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag in _BLOCKS:
            self._block()

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            if not self.lists:
                self._block()
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a":
            href = self.hrefs.pop() if self.hrefs else None
            self.out.append(f"]({href})" if href else "")
        elif tag == "tr":
            self.out.append("|")
        elif tag in _BLOCKS and tag != "li":
            self._block()

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(html: str | None, exclude: Sequence[str] = ()) -> str | None:
    """Markdown of a page, each line without trailing white space; None if nothing remains."""
    if not html:
        return None
    writer = MarkdownWriter(exclude)
    writer.feed(html)
    writer.close()
    lines = [line.rstrip() for line in "".join(writer.out).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return text or None


def markdownify(pages: DataFrame, exclude: Sequence[str] = (), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, text): whole pages as Markdown; pages without html or text give no row."""
    skipped = tuple(exclude)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_markdown(h, skipped) for h in b.column(1).to_pylist()], pa.string())], names=["url", "text"])

    picked = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, "url string, text string").where(F.col("text").isNotNull())


def prompt(markdown: str) -> str:
    return f"Read the page below and return its data as one JSON object of the given schema.\n\nPage:\n{markdown}\n"


def model_records(pages: DataFrame, schema: T.StructType, generate: Callable[[str, dict], str | None], max_retries: int = 2, exclude: Sequence[str] = (), json_schema: dict | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, result): records of ``schema`` that ``generate(prompt, json_schema)`` gives for each page as JSON text.

    ``generate`` runs on the executors and is tried up to ``max_retries`` times a page on nothing or an exception; what
    then fails, or lacks a required field, gives no row.
    """
    wanted = json_schema or json.loads(schema.json())
    skipped = tuple(exclude)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for html in b.column(1).to_pylist():
                text, answer = to_markdown(html, skipped), None
                for _ in range(max(1, max_retries) if text else 0):
                    try:
                        answer = generate(prompt(text), wanted)
                    except Exception:
                        answer = None
                    if answer is not None:
                        break
                out.append(answer)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["url", "answer"])

    picked = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return parse_records(picked.mapInArrow(run, "url string, answer string"), schema, "answer").select("url", "result")


def parse_records(rows: DataFrame, schema: T.StructType, json_col: str) -> DataFrame:
    """``rows`` with ``result`` parsed from JSON text; rows that don't parse or lack a required field are left out."""
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    out = rows.withColumn("result", F.from_json(json_col, loose)).where(F.col("result").isNotNull() & F.get_json_object(json_col, "$").isNotNull())
    for f in schema:
        if not f.nullable:
            out = out.where(F.col(f"result.{f.name}").isNotNull())
    return out


def wrap_crawl(content: DataFrame) -> DataFrame:
    """Content flattened beside its address; a plain ``result`` string becomes ``text``."""
    return content if "result" not in content.columns else content.select(F.col("result").alias("text"), "url")


def wrap_scrape(content: DataFrame) -> DataFrame:
    """(url, result) with the content nested; failed extractions (null results) are dropped."""
    if "result" in content.columns:
        return content.select("url", "result").where(F.col("result").isNotNull())
    return content.select("url", F.struct(*[c for c in content.columns if c != "url"]).alias("result"))

