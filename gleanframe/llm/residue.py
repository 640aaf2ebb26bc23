"""Template residue, filler text and notices that stand in a page's place, by a multi-pattern automaton."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon, prose

#: Share of a text's words, surroundings aside, that must stand in notices for the text to be nothing but a notice.
NOTICE_COVERAGE = 0.6
#: Share of a line's words that must be pseudo-Latin, and their least number.
LATIN_SHARE, LATIN_WORDS = 0.35, 3

# HTML elements that may stand in angle brackets without being placeholders; those that are usual names of fields too need a closing tag.
ELEMENTS = frozenset("html head body meta script style div span table thead tbody tr td th ul ol li img pre code main nav header footer article section aside form input button select iframe strong em sup sub small font center blockquote br hr".split())
FIELDS = frozenset("title link label option address time summary".split())

_NAME = r"(?=[A-Za-z][\w.-])[A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9]+)*"
#: Placeholder syntaxes: doubled or marked brackets, percent, at and underscore fences, and worded slots.
PLACEHOLDER = re.compile(
    rf"""(?<![^\s(\["'«“>:])(?:
      \{{\{{\{{?[#/^&>!]?\s*(?:each\s+|if\s+|unless\s+|with\s+)?{_NAME}\s*\}}?\}}\}}
    | \{{%[-]?\s*(?:if\s+|for\s+|include\s+|block\s+)?{_NAME}\s*[-]?%\}}
    | <%[=-]?\s*{_NAME}\s*-?%>
    | [$#]!?\{{\s*{_NAME}\s*\}}
    | \{{\s*{_NAME}\s*\}}
    | \[\[\s*{_NAME}\s*\]\] | <<\s*{_NAME}\s*>> | <(?P<angle>[a-z][a-z0-9_.-]{{2,}})>
    | \[%\s*{_NAME}\s*%\] | %%\s*{_NAME}\s*%% | %{_NAME}% | @@{_NAME}@@ | __{_NAME}__ | \*\|{_NAME}\|\*
    | X{{2,4}}_{_NAME}_X{{2,4}} | ~~{_NAME}~~ | &&{_NAME}&& | \{{\s*{_NAME}\s*\|\s*\w+\s*\}} | %\({_NAME}\)[sd] | \${_NAME}[$;]
    | \[(?:INSERT|YOUR|ENTER|ADD|Insert|Your|Enter|Add)\s[^\[\]\n]{{2,}}\]
    | \[[A-Za-z_.\ -]{{2,}}\s(?:here|HERE|goes\ here|GOES\ HERE)\]
    | (?:TODO|FIXME|TK):\s{_NAME}
    | (?<!\S)\{{\d{{1,2}}\}}(?!\S)
    )(?![\w`])""",
    re.X,
)
_STOP = re.compile(r"[.!?…](?=\s|$)")
_TRAILER = re.compile(r"^\S+(?: \S+){0,3} / [0-9a-f]{5,}$")

_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("field", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("coverage", T.DoubleType()),
])


def placeholder_size(text: str) -> int:
    """Characters of unfilled placeholders that aren't quoted as code (an odd number of backticks before them in their line)."""
    n = ticks = seen = line = 0
    markup = ELEMENTS
    if "</" in text:
        markup = ELEMENTS | {name for name in FIELDS if f"</{name}>" in text}
    for m in PLACEHOLDER.finditer(text):
        if m["angle"] in markup:
            continue
        if (start := text.rfind("\n", seen, m.start()) + 1) > line:
            line, ticks, seen = start, 0, start
        ticks += text.count("`", seen, m.start())
        seen = m.start()
        if ticks % 2 == 0:
            n += m.end() - m.start()
    return n


def is_pseudo_latin(tokens: list[str]) -> bool:
    stems = lexicon.latin_stems()
    found = [t[:5] for t in tokens if t[:5] in stems and len(t) > 3]
    return len(found) >= LATIN_WORDS and len(found) >= LATIN_SHARE * len(tokens) and len(set(found)) >= min(3, len(tokens))


def latin_size(text: str) -> int:
    """Characters of the lines in pseudo-Latin."""
    return sum(len(line) for line in text.lower().split("\n") if is_pseudo_latin(line.split()))


def filler_size(squeezed: str, hits: list) -> int:
    """Characters of the sentences that hold the place of text to come; their parts must lie in one or in the one after it."""
    n = 0
    stops: list[int] | None = None
    found: dict[str, int] = {}  # where a part was found last; hits come in order, so it holds until it is passed
    for end, (size, entries) in hits:
        for kind, parts in entries:
            if kind != "filler":
                continue
            at = bound = end + 1
            if len(parts) > 1:
                if stops is None:
                    stops = [m.end() for m in _STOP.finditer(squeezed)]
                k = bisect.bisect_right(stops, at) + 1
                bound = stops[k] if k < len(stops) else len(squeezed)
            for p in parts[1:]:
                if 0 <= found.get(p, 0) < at or p not in found:
                    found[p] = squeezed.find(p, at)
                if not 0 <= found[p] <= bound:
                    at = -1
                    break
                at = found[p] + len(p)
            if at >= 0:
                n += at - end - 1 + size
    return n


def notice_coverage(lines: list[str]) -> float:
    """Share of the words, surroundings and trailing request ids aside, that stand in notices."""
    inside = outside = 0
    for line in lines:
        s = line.strip()
        if not s:
            continue
        n = len(s.split())
        if found := prose.notice_words(s):
            inside += found
            outside += n - found
        elif not prose.surrounding(s) and not _TRAILER.match(" ".join(s.lower().split())):
            outside += n
    return inside / (inside + outside) if inside else 0.0


def _hits(text: str) -> tuple[str, list, set[str]]:
    """The squeezed text, the automaton's hits in it, and their kinds."""
    squeezed = " ".join(text.lower().split())
    hits = list(lexicon.automaton().iter(squeezed))
    return squeezed, hits, {kind for _, (_, entries) in hits for kind, _ in entries}


def has_filler_text(text: str) -> bool:
    """Filler sentences or a line of pseudo-Latin."""
    squeezed, hits, kinds = _hits(text)
    return "latin" in kinds and latin_size(text) > 0 or "filler" in kinds and filler_size(squeezed, hits) > 0


def judge(text: str | None) -> tuple[str, float] | None:
    """(reason, coverage) if the text is residue, else None. Reasons: placeholder, filler, notice.

    One pass of the automaton tells which kinds the text can hold at all; the shapes of those are then checked. A
    placeholder or filler counts wherever it stands (its ``coverage`` is its share of the text's characters), a notice
    only where it covers at least NOTICE_COVERAGE of the words.
    """
    if not text:
        return None
    squeezed, hits, kinds = _hits(text)
    if "slot" in kinds and (n := placeholder_size(text)):
        return "placeholder", round(n / len(text), 4)
    n = (latin_size(text) if "latin" in kinds else 0) + (filler_size(squeezed, hits) if "filler" in kinds else 0)
    if n:
        return "filler", round(min(1.0, n / len(text)), 4)
    if ("notice" in kinds or "message" in kinds or prose.speaks_of_trouble(squeezed)) and (share := notice_coverage(text.split("\n"))) >= NOTICE_COVERAGE:
        return "notice", round(share, 4)
    return None


def _judged(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            ids = b.column(0).to_pylist()
            for k, name in enumerate(fields):
                for i, text in zip(ids, b.column(k + 1).to_pylist()):
                    if (found := judge(text)) is not None:
                        for c, v in zip(out, (i, name, *found)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())], names=_SCHEMA.fieldNames())

    return run


def residue(rows: DataFrame, id_col: str, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """The fields of ``rows`` that hold residue instead of content: (row_id, field, reason, coverage).

    One Arrow pass over whole texts, no shuffle. Null and empty texts are no residue; null ids stay; a repeated row
    is judged each time; other columns are ignored. A notice beside a main body, and placeholders quoted as code,
    are content.
    """
    picked = rows.select(F.col(id_col).cast("long").alias("row_id"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    return picked.mapInArrow(_judged(list(fields)), _SCHEMA)


def without_residue(rows: DataFrame, id_col: str, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """``rows`` without those that hold residue in any of the fields; rows with a null id stay."""
    bad = residue(rows, id_col, fields).select(F.col("row_id").alias("_row_id")).distinct()
    return rows.join(bad, F.col(id_col) == F.col("_row_id"), "left_anti")
