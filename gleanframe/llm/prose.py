"""What one line of a web text is: a sentence of natural language, a surrounding, a menu, a heading, or something else."""

from __future__ import annotations

import re
from functools import cache, lru_cache

from . import lexicon

#: Characters up to which what was found in a line is remembered for the next time it comes; longer lines are read anew.
LONG = 260
#: Share of a line's words that must stand in sentences with the wording of surroundings, and of a sentence's words that must be signs of them.
SURROUNDING_SHARE, SIGN_SHARE = 1 / 3, 0.3
#: Share of a sentence's words that must be words of notices for it to be one without a known phrase.
TROUBLE_SHARE = 0.2

# Kinds of lines.
EMPTY, SENTENCE, SURROUNDING, MENU, CRUMB, RELATED, BYLINE, ITEM, NOTICE, OTHER, TITLE = range(11)

_WORD = re.compile(r"[^\W\d_]+")
_DECOR = re.compile(r"(?:--|[>»•*·]|#{1,6})\s+")
_BULLET = re.compile(r"^(?:[-•*–]|\[[ x]\]|\d{1,3}[.)])\s+")
_LINK = re.compile(r"\[([^\]]{1,60})\]\([^)]*\)")
_END = re.compile(r"""[.!?…:;]["'”’»)\]]*(?:\s*\(\d+\)[.?!]?)?$""")
_PARTS = re.compile(r"(?<=[.!?…;])\s+|\s+[|·•–—/-]\s+")
_SEPARATORS = re.compile(r"\s*[|·•]\s*|\s{3,}")


@cache
def _prompts() -> re.Pattern[str]:
    return re.compile("|".join(lexicon.phrases(lexicon.PROMPTS, sep="\n")))


@cache
def _bylines() -> re.Pattern[str]:
    return re.compile("|".join(lexicon.phrases(lexicon.BYLINES, sep="\n")))


@cache
def _menu() -> re.Pattern[str]:
    words = sorted(lexicon.phrases(lexicon.MENU, sep=","), key=len, reverse=True)
    return re.compile(r"(?:(?:%s)(?:\s+|\s*[|·•>»/]\s*|$))+" % "|".join(map(re.escape, words)))


@cache
def _crumb() -> re.Pattern[str]:
    words = sorted(lexicon.phrases(lexicon.MENU, sep=","), key=len, reverse=True)
    return re.compile(r"^(?:%s)\s*[>»/›]\s*" % "|".join(map(re.escape, words)))


@cache
def _related() -> frozenset[str]:
    return frozenset(lexicon.phrases(lexicon.RELATED))


@cache
def _related_heads() -> frozenset[str]:
    return frozenset(w.split()[0] for w in _related())


def words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def hits(tokens: list[str], common: dict[str, frozenset[str]]) -> tuple[str, int]:
    """The language with most common words among the tokens, and how many."""
    best, most = "", 0
    for lang, own in common.items():
        n = sum(1 for t in tokens if t in own)
        if n > most:
            best, most = lang, n
    return best, most


@cache
def _menu_heads() -> frozenset[str]:
    return frozenset(w.split()[0] for w in lexicon.phrases(lexicon.MENU, sep=","))


_HEAD = re.compile(r"[^\W_]+")


@cache
def _signs() -> tuple[frozenset[str], frozenset[str]]:
    return frozenset(lexicon.phrases(lexicon.SIGNS + lexicon.SERVICE, sep=" ")), frozenset(lexicon.phrases(lexicon.FILLING, sep=" "))


def _may_be_signed(tokens: list[str]) -> bool:
    """Whether enough of a line's words are signs for SURROUNDING_SHARE of it to be sentences of signs."""
    signs, filling = _signs()
    if signs.isdisjoint(tokens) and tokens[-1].rstrip(_STOPS) not in signs and tokens[0].rstrip(_STOPS) not in signs:
        return False
    bare = [t.rstrip(_STOPS) for t in tokens]
    n = sum([t in signs for t in bare])
    return n >= 2 and n >= SIGN_SHARE * SURROUNDING_SHARE * len(bare) or 3 * (n + sum([t in filling for t in bare])) >= 2 * len(bare)


@cache
def _trouble() -> frozenset[str]:
    return frozenset(lexicon.phrases(lexicon.TROUBLE, sep=" "))


def _signed(part: str) -> bool:
    """Mostly words that sites use around a body: two at least, or one and no word that bears content."""
    signs, filling = _signs()
    tokens = _WORD.findall(part)
    n = sum([t in signs for t in tokens])
    return n >= 2 and n >= SIGN_SHARE * len(tokens) or n == 1 and all(t in signs or t in filling for t in tokens)


@cache
def _prompt_heads() -> frozenset[str]:
    """First words of the prompts; those that begin with a name or a number are told by their digit."""
    found = re.findall(r"[(|^]+([^\W\d_]+)", "|".join(lexicon.phrases(lexicon.PROMPTS, sep="\n")))
    return frozenset(w for x in found for w in (x, lexicon.plain(x)))


_STOPS = ".:!?,;"
_DIGIT = re.compile(r"\d")


def _prompt(s: str, tokens: list[str]) -> bool:
    return bool(tokens) and (tokens[0] in _prompt_heads() or _DIGIT.search(s) is not None) and _prompts().match(s) is not None


def _surrounding_words(s: str, hits: list[tuple[int, int]]) -> int:
    """Words of a squeezed lower-case line in sentences that hold a phrase of surroundings (``hits``: end, length), are
    prompts or consist of signs."""
    n = start = k = 0
    for part in _PARTS.split(s):
        at = s.find(part, start)
        start = at + len(part)
        covered = 0
        while k < len(hits) and hits[k][0] < start:  # hits come by their ends
            covered = max(covered, hits[k][1] if hits[k][0] >= at else 0)
            k += 1
        if covered and (covered >= 0.2 * len(part) or covered >= 16) or _signed(part) or _prompt(part, part.split()):
            n += len(part.split())
    return n


@lru_cache(maxsize=1 << 10)
def _read(line: str) -> tuple[str, list[str], list[tuple[int, int]], list[tuple[int, int, bool]]]:
    """The squeezed line in lower case, its words, the phrases of surroundings in it (end, length) and those of notices
    and messages (start, end, whether a notice)."""
    tokens = line.lower().split()
    s = " ".join(tokens)
    around, notices = [], []
    for end, (size, found) in lexicon.automaton().iter(s):
        kinds = [kind for kind, _ in found]
        if "around" in kinds:
            around.append((end, size))
        if "notice" in kinds or "message" in kinds:
            notices.append((end + 1 - size, end + 1, "notice" in kinds))
    return s, tokens, around, notices


@cache
def _byline_heads() -> frozenset[str]:
    return frozenset("by von par por di door text texte texto testo tekst text: texte: texto: testo: tekst:".split())


def surrounding(line: str) -> int:
    """SURROUNDING, MENU, CRUMB, RELATED or BYLINE for lines around a body, else 0; lines of any length."""
    return _known_surrounding(line) if len(line) <= LONG else _surrounding(line)


def _surrounding(line: str) -> int:
    s, tokens, hits, _ = _read(line)
    if not s:
        return 0
    odd = not s[0].isalpha() or s[-1] in "!»"
    if odd:
        if (mark := _DECOR.match(s)) is not None:
            s = s[mark.end() :]
            hits = [(end - mark.end(), size) for end, size in hits if end - size + 1 >= mark.end()]
        if s.endswith((" !", " »")):
            s = s[:-2]
        if not s:
            return 0
        tokens = s.split()
    if tokens[0].rstrip(_STOPS) in _related_heads() and s.rstrip(".!…:»? ") in _related():
        return RELATED
    item = _LINK.sub(r"\1", s) if "](" in s else s
    item = item if item[0].isalpha() else _BULLET.sub("", item)
    head = _HEAD.search(item)
    if head and head[0] in _menu_heads():
        if _menu().fullmatch(_SEPARATORS.sub(" ", item).rstrip(".!…:»? ")):
            return MENU
        if _crumb().match(s):
            return CRUMB
    barred = "|" in item
    if barred or "·" in item:
        parts = [p for p in re.split(r"\s*[|·]\s*", item) if p]
        if len(parts) >= 3 and 2 * sum(1 for p in parts if _menu().fullmatch(p)) >= len(parts):
            return MENU
    if _prompt(s, tokens):
        return SURROUNDING
    if (hits or _may_be_signed(tokens)) and _surrounding_words(s, hits) >= SURROUNDING_SHARE * len(tokens):
        return SURROUNDING
    return BYLINE if (barred or tokens[0] in _byline_heads()) and s[-1] not in "!?" and _bylines().match(s) else 0


_known_surrounding = lru_cache(maxsize=1 << 16)(_surrounding)


def _covered(hits: list[tuple[int, int, bool]], start: int, end: int) -> tuple[int, int]:
    """Characters from ``start`` to ``end`` that stand in notices, and in notices or messages; overlapping hits count once."""
    out = []
    for any_kind in (False, True):
        n = last = 0
        for a, b, sure in hits:
            if (sure or any_kind) and a >= start and b <= end:
                n += max(0, b - max(a, last))
                last = max(last, b)
        out.append(n)
    return out[0], out[1]


def _troubled(part: str) -> bool:
    """At least two words of notices, and TROUBLE_SHARE of all words."""
    tokens, trouble = _WORD.findall(part), _trouble()
    n = sum([t in trouble for t in tokens])
    return n >= 2 and n >= TROUBLE_SHARE * len(tokens)


def speaks_of_trouble(squeezed: str) -> bool:
    """Whether a sixth of a text's words are words of notices: only then can it be nothing but notices without a known
    phrase (a share of TROUBLE_SHARE in NOTICE_COVERAGE of its words)."""
    tokens = squeezed.split()
    trouble = _trouble()
    return 6 * sum([t in trouble or t.rstrip(_STOPS) in trouble for t in tokens]) >= len(tokens)


def notice_words(line: str) -> int:
    """Words of the line that stand in notices: all or none of a short line, the notice sentences of a long one."""
    s, tokens, _, hits = _read(line)
    if not hits:
        trouble = _trouble()
        if trouble.isdisjoint(tokens):
            return 0
        n = sum([t in trouble or t.rstrip(_STOPS) in trouble for t in tokens])
        if n < 2 or n < TROUBLE_SHARE / 2 * len(tokens):
            return 0
        n = sum([len(x.split()) for x in _PARTS.split(s) if _troubled(x)])
        return n if len(line) > LONG else len(tokens) if 2 * n > len(tokens) else 0
    hits = sorted(hits)
    if len(line) <= LONG:
        sure, covered = _covered(hits, 0, len(s))
        known = sure >= 0.3 * len(s) or sure >= 18 or covered >= 0.5 * len(s)
        return len(tokens) if known or 2 * sum([len(x.split()) for x in _PARTS.split(s) if _troubled(x)]) > len(tokens) else 0
    n = start = k = 0
    for x in _PARTS.split(s):
        at = s.find(x, start)
        start = at + len(x)
        own = []
        while k < len(hits) and hits[k][0] < start:
            own.append(hits[k])
            k += 1
        sure, covered = _covered(own, at, start) if own else (0, 0)
        if sure >= 0.3 * len(x) or sure >= 18 and len(x) <= LONG or covered >= 0.5 * len(x) or _troubled(x):
            n += len(x.split())
    return n


def notice(line: str) -> bool:
    """A line that is mostly an error, access, verification or script notice; one of any length."""
    n = notice_words(line)
    return n > 0 and 2 * n > len(line.split())


def is_sentence(line: str, tokens: list[str], n_common: int) -> bool:
    """Running text: at least four words, two of them common ones, and one common word to six; no table or list entry."""
    n = len(tokens)
    return n >= 4 and n_common >= 2 and 6 * n_common >= n


def ends_sentence(line: str) -> bool:
    last = line.rstrip()[-1:]
    return last in ".!?…:;" and last != "" or last in "\"'”’»)]" and bool(_END.search(line.rstrip()))


def bullet(line: str) -> bool:
    return bool(_BULLET.match(line.strip()))
