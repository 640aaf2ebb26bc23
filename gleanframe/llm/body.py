"""The main body of a page: parser events, text-to-tag ratio by line, Gaussian smoothing and threshold clustering.

The regions found so decide every line. In plain text, the signs that stand for markup and the wording or place of
surroundings (menus, notices, prompts, lists of other articles) count as tags. Only a page's own title and the line
that names its author are put back afterwards.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import prose
from .residue import NOTICE_COVERAGE, has_filler_text, judge, notice_coverage

#: Width of the Gaussian in lines, and rounds of the two-cluster threshold.
SIGMA, ROUNDS = 0.5, 8
#: Bounds of the threshold, as logarithms of one more than the ratio, and the ratio from which a line is full text.
LOWEST, HIGHEST, FULL = 1.9, 2.3, 60.0
#: Tags that a word counts as in a line with the wording or the place of surroundings.
WORDING = 3.0
#: Words up to which a line that ends no sentence and leads to no text can be a link.
LONGEST_LINK = 16
#: A run of short lines before any sentence is a menu from this number on.
LEAST_MENU = 4
#: A list of other articles has at least this many entries.
LEAST_RELATED = 2

# Elements whose text is never shown.
_HIDDEN = frozenset(("script", "style", "noscript", "template", "svg"))
# Elements that hold surroundings.
_CHROME = frozenset(("nav", "footer", "aside", "form", "button", "select"))
_AROUND = frozenset((prose.SURROUNDING, prose.MENU, prose.CRUMB, prose.RELATED, prose.NOTICE))
_PASSED = frozenset((prose.OTHER, prose.TITLE, prose.SURROUNDING, prose.NOTICE, prose.RELATED))
_TEXT = frozenset((prose.SENTENCE, prose.ITEM, prose.BYLINE))
_SENTENCE_BREAK = re.compile(r"[.!?…]\s+\S")


class LineEvents(HTMLParser):
    """Characters shown and tags met, by line of the source, from a stream of parser events."""

    def __init__(self, lines: int):
        super().__init__(convert_charrefs=False)
        self.chars = [0] * lines
        self.tags = [0] * lines
        self.hidden = self.chrome = 0

    def _line(self) -> int:
        return min(self.getpos()[0] - 1, len(self.chars) - 1)

    def handle_starttag(self, tag, attrs):
        self.tags[self._line()] += 1
        self.hidden += tag in _HIDDEN
        self.chrome += tag in _CHROME

    def handle_startendtag(self, tag, attrs):
        self.tags[self._line()] += 1

    def handle_endtag(self, tag):
        self.tags[self._line()] += 1
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))
        self.chrome = max(0, self.chrome - (tag in _CHROME))

    def handle_data(self, data):
        at = self._line()
        for k, part in enumerate(data.split("\n")):
            n = min(at + k, len(self.chars) - 1)
            if not self.hidden:
                self.chars[n] += len(part.strip())
            if self.chrome and part.strip():
                self.tags[n] += 1

    def handle_entityref(self, name):
        self.chars[self._line()] += not self.hidden

    handle_charref = handle_entityref


# Elements that begin a line of their own.
_BLOCKS = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())


class BlockEvents(HTMLParser):
    """The text of a page in lines that end at block elements, the tags met in each, and the page's title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.tags: list[float] = []
        self.items: list[bool] = []  # whether a line is an entry of a list
        self.title = ""
        self._in_item = False
        self._parts: list[str] = []
        self._met = 0.0
        self.hidden = self.chrome = 0
        self._in_title = False

    def _end(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.lines.append(text)
            self.items.append(self._in_item)
            self.tags.append(self._met + (WORDING * len(text.split()) if self.chrome else 0.0))
        self._parts, self._met = [], 0.0

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._end()
            self._in_item = tag == "li"
        self._met += 1
        self.hidden += tag in _HIDDEN
        self.chrome += tag in _CHROME
        self._in_title |= tag == "title"

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCKS:
            self._end()
        self._met += 1

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self._end()
            self._in_item = False
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))
        self.chrome = max(0, self.chrome - (tag in _CHROME))
        self._in_title &= tag not in ("title", "head")

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self.hidden:
            self._parts.append(data)

    def close(self):
        super().close()
        self._end()


def page_body(html: str | None) -> str | None:
    """The main body of a page as text, a block a line; null stays null."""
    if html is None:
        return None
    events = BlockEvents()
    events.feed(html)
    events.close()
    lines, name = events.lines, _plain(events.title)
    kinds = [prose.ITEM if item and k == prose.OTHER else k for k, item in zip([_kind(s, name) for s in lines], events.items)]
    inside = regions([len(s) / max(1.0, t + w) for s, t, w in zip(lines, events.tags, line_tags(lines, kinds))], kinds)
    return "\n".join(s for s, k, ok in zip(lines, kinds, inside) if ok or k == prose.TITLE)


def _marks(s: str) -> int:
    """Signs of plain text that stand for markup: bars, dots and arrows between links, link brackets, gaps."""
    return s.count("|") + s.count("·") + s.count("»") + s.count("›") + s.count("](") + s.count("   ")


def line_tags(lines: list[str], kinds: list[int]) -> list[float]:
    """Tags that plain text would have had: one a sign that stands for markup, some a word for lines in the wording of
    surroundings, for entries of a list of other articles and for runs of short lines that lead to no text."""
    tags = [float(_marks(s)) for s in lines]
    n_words = [len(s.split()) for s in lines]
    at = [i for i, k in enumerate(kinds) if k != prose.EMPTY]
    following, run = _following(at, kinds), _short_runs(at, kinds, n_words)
    spoken = False  # whether a sentence has been met
    related = -1  # entries so far of a list of other articles, -1 outside one
    for p, i in enumerate(at):
        k, n = kinds[i], n_words[i]
        if k in _AROUND:
            tags[i] += WORDING * n
        if k == prose.RELATED:
            related = 0
        elif k in _AROUND or k in (prose.BYLINE, prose.TITLE):
            related = -1
        elif related >= 0:
            one = not _SENTENCE_BREAK.search(lines[i])
            if k == prose.OTHER or k == prose.SENTENCE and one and related < LEAST_RELATED or k == prose.ITEM and related == 0:
                related += 1
                tags[i] += WORDING * n
            else:
                related = -1
        elif k == prose.OTHER and n <= LONGEST_LINK and following[p] not in _TEXT:
            tags[i] += WORDING * n
        elif k in (prose.OTHER, prose.ITEM) and not spoken and run[p] >= LEAST_MENU:
            # The last line of a run may be the heading of the sentence after it.
            heading = k == prose.OTHER and p + 1 < len(at) and kinds[at[p + 1]] == prose.SENTENCE
            tags[i] += 0.0 if heading else WORDING * n
        spoken |= k == prose.SENTENCE
    return tags


def _following(at: list[int], kinds: list[int]) -> list[int | None]:
    """The kind that each line leads to: of the next one that is neither a heading nor set into the text."""
    out: list[int | None] = [None] * len(at)
    k = None
    for p in range(len(at) - 1, -1, -1):
        out[p] = k
        if kinds[at[p]] not in _PASSED:
            k = kinds[at[p]]
    return out


def _short_runs(at: list[int], kinds: list[int], n_words: list[int]) -> list[int]:
    """How many lines in a row, each with this one, are of its kind and of three words at most beside a bullet."""
    out, start, last = [0] * len(at), 0, None
    for p, i in enumerate(at):
        k = kinds[i] if n_words[i] <= 3 + (kinds[i] == prose.ITEM) else None
        if k is None or k != last:
            start = p
        last = k
        out[p] = 0 if k is None else p - start + 1
    for p in range(len(at) - 2, -1, -1):
        if out[p] and out[p + 1] > out[p]:
            out[p] = out[p + 1]
    return out


def ratios(text: str, lines: list[str], kinds: list[int]) -> list[float]:
    """Text-to-tag ratio of each line: characters shown to a tag met (``LineEvents``) or stood for (``line_tags``)."""
    tags = line_tags(lines, kinds)
    if "<" in text:
        events = LineEvents(len(lines))
        events.feed(text)
        events.close()
        return [c / max(1.0, t + w) for c, t, w in zip(events.chars, events.tags, tags)]
    return [len(s.strip()) / max(1.0, w) for s, w in zip(lines, tags)]


_REACH = max(1, round(4 * SIGMA))
_KERNEL = [math.exp(-0.5 * (d / SIGMA) ** 2) for d in range(-_REACH, _REACH + 1)]


def regions(ratio: list[float], kinds: list[int]) -> list[bool]:
    """Which lines lie in content regions: the ratios of lines that aren't empty, smoothed, fall into two clusters.

    The threshold is the middle of the clusters' means, kept within LOWEST and HIGHEST: so a page that is all content,
    or has none, isn't parted through its middle. Above FULL a ratio says no more.
    """
    at = [i for i, k in enumerate(kinds) if k != prose.EMPTY]
    r = [0.0] * _REACH + [math.log1p(min(ratio[i], FULL)) for i in at] + [0.0] * _REACH
    n = len(at)
    smooth = []
    for i in range(n):
        lo, hi = max(0, _REACH - i), min(len(_KERNEL), n - i + _REACH)
        smooth.append(sum(map(operator.mul, _KERNEL, r[i : i + len(_KERNEL)])) / sum(_KERNEL[lo:hi]))
    cut = (min(smooth, default=0.0) + max(smooth, default=0.0)) / 2
    for _ in range(ROUNDS):
        below = [x for x in smooth if x < cut]
        above = n - len(below)
        if not below or not above:
            break
        base = sum(below)
        new = (base / len(below) + (sum(smooth) - base) / above) / 2
        if abs(new - cut) < 1e-3:
            break
        cut = new
    cut = min(max(cut, LOWEST), HIGHEST)
    out = [False] * len(kinds)
    for i, x in zip(at, smooth):
        out[i] = x >= cut
    return out


def _plain(s: str) -> str:
    return " ".join(s.lower().split()).rstrip(".!…:»? ")


def _kind(s: str, name: str) -> int:
    """The line's own kind; headings come out as OTHER."""
    if not s:
        return prose.EMPTY
    if name and len(s) <= 2 * len(name) + 10 and _plain(s) == name:
        return prose.TITLE
    if k := prose.surrounding(s):
        return k
    if prose.notice(s):
        return prose.NOTICE
    if prose.bullet(s):
        return prose.ITEM
    return prose.SENTENCE if prose.ends_sentence(s) else prose.OTHER


def surrounding_lines(text: str | None, title: str | None = None) -> list[int]:
    """Numbers of the lines that aren't empty and not part of the main body: those outside the content regions.

    The page's own title and the author's line belong to the body wherever they stand. Fields that as a whole are a
    notice or filler have no such lines, as have null and empty ones.
    """
    if not text:
        return []
    raw = text.split("\n")
    lines = [s.strip() for s in raw]
    name = _plain(title) if title else ""
    kinds = [_kind(s, name) for s in lines]
    if prose.NOTICE in kinds and notice_coverage(raw) >= NOTICE_COVERAGE or has_filler_text(text) and _all_filler(lines):
        return []
    inside = regions(ratios(text, raw, kinds), kinds)
    return [i for i, k in enumerate(kinds) if k not in (prose.EMPTY, prose.TITLE) and not inside[i] and (k != prose.BYLINE or "|" in lines[i])]


def _all_filler(lines: list[str]) -> bool:
    """Whether filler covers the field: each of its own lines is residue by itself."""
    own = [s for s in lines if s and not prose.surrounding(s)]
    return bool(own) and sum(judge(s) is not None for s in own) >= NOTICE_COVERAGE * len(own)


_SCHEMA = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])


def _found(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, titles = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[], [], []]
            for k, name in enumerate(fields):
                for i, title, text in zip(ids, titles, b.column(k + 2).to_pylist()):
                    if found := surrounding_lines(text, title):
                        for c, v in zip(out, (i, name, found)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.int32()))], names=_SCHEMA.fieldNames())

    return run


def boilerplate(items: DataFrame, fields: tuple[str, ...] = ("content", "text"), id_col: str = "item_id", title_col: str | None = "title") -> DataFrame:
    """(item_id, field, lines): per field the numbers of its lines outside the main body; fields without any are left out.

    One Arrow pass over whole texts, no shuffle. Null and empty fields give nothing, null titles are no titles, null
    ids stay, repeated rows repeat, other columns are ignored.
    """
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    picked = items.select(F.col(id_col).cast("long").alias("item_id"), title.alias("title"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    return picked.mapInArrow(_found(list(fields)), _SCHEMA)


def _each(f, names: list[str]):
    """``f`` of a row's text (last column) and title (the one before it), beside the columns ahead of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f(text, title) for title, text in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.string())], names=names)

    return run


def body_of(text: str | None, title: str | None = None) -> str | None:
    """The text without the lines around and inside its main body; null stays null."""
    gone = set(surrounding_lines(text, title))
    return text if text is None or not gone else "\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone)


def main_body(items: DataFrame, fields: tuple[str, ...] = ("content", "text"), id_col: str = "item_id", title_col: str | None = "title") -> DataFrame:
    """(item_id, field, body): each field without the lines around and inside its main body; null stays null."""
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("_x")
    picked = items.select(F.col(id_col).cast("long").alias("item_id"), title.alias("title"), both).select("item_id", "_x.field", "title", "_x.text")
    return picked.mapInArrow(_each(body_of, ["item_id", "field", "body"]), "item_id long, field string, body string")


def page_bodies(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, body) of pages of markup; one Arrow pass, no shuffle. Null pages have a null body, empty ones an empty one."""
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.lit(None).cast("string").alias("title"), F.col(html_col).alias("html"))
    return picked.mapInArrow(_each(lambda html, _: page_body(html), ["page_id", "body"]), "page_id long, body string")
