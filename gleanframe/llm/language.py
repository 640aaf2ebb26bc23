"""Language of each document and of each of its mixed-language segments by rank-order n-gram profiles.

Profiles are fitted on a bounded sample of labelled documents: the most frequent n-grams of each language in order.
A text is compared with each profile by out-of-place distance: how far its own n-grams, in order of frequency, lie from
their places in the profile. Lines are compared singly; a line of another language than its document must also have
most of its common words in that language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import prose
from .labels import LANGUAGES, label_code
from .quality import LineReader, common_word_sets

#: Labelled documents a language that profiles are fitted on, and n-grams a profile.
SAMPLE, PROFILE = 300, 400
#: Characters of a sample text from which its distance says how far texts of its language lie, and texts that must say so.
LEAST_CHARS, LEAST_TEXTS = 80, 50
#: Words that a line must have to be compared by itself.
LEAST_WORDS = 5
#: Language of texts that lie farther from every profile than any text of the sample from its own, by this factor.
UNKNOWN, FARTHEST = "und", 1.1

_LETTERS = 62  # the commonest letters have numbers from 1, all others share the last one; 0 parts words
_OTHER = _LETTERS + 1
_BASE = _OTHER + 1


@dataclass
class Profiles:
    """Per language the place of each n-gram known to any of them; PROFILE where a language doesn't have it."""

    langs: list[str]
    letters: np.ndarray  # code point -> number
    dense: np.ndarray  # n-gram -> its column in places, or -1
    places: np.ndarray  # languages x n-grams
    farthest: float = math.inf  # distance beyond which a text is in none of the languages

    @property
    def size(self) -> int:
        return self.places.shape[1]


def _numbers(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all texts in a row, each between word breaks, and the text each belongs to."""
    joined = " " + " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    line = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)])
    x = letters[np.minimum(points, len(letters) - 1)]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0) | (line[1:] != line[:-1])
    return x[keep], line[keep]


def _ngrams(x: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 1- to 3-grams within words and over their breaks, and the text of each."""
    x = x.astype(np.int64)
    two, three = x[:-1] * _BASE + x[1:], (x[:-2] * _BASE + x[1:-1]) * _BASE + x[2:]
    ok1 = x != 0
    ok2 = (line[1:] == line[:-1]) & ((x[:-1] != 0) | (x[1:] != 0))
    ok3 = (line[2:] == line[:-2]) & (x[1:-1] != 0)
    codes = np.concatenate([x[ok1], two[ok2] + _BASE, three[ok3] + _BASE + _BASE * _BASE])
    return codes, np.concatenate([line[ok1], line[1:][ok2], line[2:][ok3]])


def fit(samples: dict[str, list[str]], size: int = PROFILE) -> Profiles:
    """Profiles of the languages whose texts are given."""
    langs = [k for k in sorted(samples) if samples[k]]
    counts = Counter(c for k in langs for t in samples[k] for c in t.lower() if c.isalpha())
    letters = np.zeros(0x2500, np.uint8)
    for cp in range(len(letters)):
        if chr(cp).isalpha():
            letters[cp] = _OTHER
    letters[-1] = _OTHER
    for i, (c, _) in enumerate(sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:_LETTERS]):
        if ord(c) < len(letters) - 1:
            letters[ord(c)] = i + 1
    tops = []
    for k in langs:
        codes, _ = _ngrams(*_numbers([t.lower() for t in samples[k]], letters))
        values, n = np.unique(codes, return_counts=True)
        tops.append(values[np.lexsort((values, -n))][:size])
    known = np.unique(np.concatenate(tops)) if tops else np.zeros(0, np.int64)
    dense = np.full(_BASE + _BASE**2 + _BASE**3, -1, np.int16)
    dense[known] = np.arange(len(known))
    places = np.full((len(langs), len(known)), size, np.int32)
    for i, top in enumerate(tops):
        places[i, dense[top]] = np.arange(len(top))
    out = Profiles(langs, letters, dense, places)
    own = []
    for i, k in enumerate(langs):
        texts = [t.lower() for t in samples[k] if len(t) >= LEAST_CHARS]
        if len(texts) >= LEAST_TEXTS:
            own.append(_distances(_counts(texts, out), out)[:, i])
    if own:
        out.farthest = FARTHEST * float(np.concatenate(own).max())
    return out


def _distances(counts: np.ndarray, p: Profiles) -> np.ndarray:
    """texts x languages: mean out-of-place distance of each text's n-grams, given texts x n-grams counts."""
    line, gram = np.nonzero(counts)
    if not len(line):
        return np.zeros((len(counts), len(p.langs)))
    n = np.minimum(counts[line, gram], 0xFFFF)
    order = np.sort((line.astype(np.int64) << 32) | ((0xFFFF - n).astype(np.int64) << 16) | gram)
    line, gram = order >> 32, order & 0xFFFF
    present, starts, sizes = np.unique(line, return_index=True, return_counts=True)
    rank = np.arange(len(line)) - np.repeat(starts, sizes)
    out = np.zeros((len(counts), len(p.langs)))
    for i in range(len(p.langs)):
        out[present, i] = np.add.reduceat(np.abs(rank - p.places[i, gram]), starts) / sizes
    return out


def _counts(texts: list[str], p: Profiles) -> np.ndarray:
    codes, line = _ngrams(*_numbers(texts, p.letters))
    gram = p.dense[codes]
    ok = gram >= 0
    return np.bincount(line[ok] * p.size + gram[ok], minlength=len(texts) * p.size).reshape(len(texts), p.size)


def confidence(distances: np.ndarray, n: int) -> float:
    """From 0 to 1: how much nearer the ``n``-th language is than the nearest of the others; 1 if there are no others."""
    others = np.delete(distances, n)
    least = float(others.min(initial=np.inf))
    return 1.0 if not len(others) else max(0.0, 1 - float(distances[n]) / least) if least > 0 else 0.0


def fit_profiles(docs: DataFrame, common_words: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from at most ``sample`` documents a language, whose label agrees with their common words.

    The sample is the documents of smallest id hash among those labelled; about twice as many are fetched. A language
    without such documents is fitted on its list of common words.
    """
    common = common_word_sets(common_words)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label_code(F.col(lang_col)).alias("label")).where(F.col("label").isin(*LANGUAGES))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, 2.0 * sample / n))).otherwise(share)
    h = F.xxhash64(F.lit("profile"), F.col("id"))
    picked = rows.where((F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))) < share).select("label", h.alias("h"), "text").toArrow().to_pylist() if sizes else []
    reader = LineReader(common)
    samples: dict[str, list[str]] = {k: [] for k in sorted(common)}
    for r in sorted(picked, key=lambda r: (r["label"], r["h"])):
        own = samples.setdefault(r["label"], [])
        if len(own) >= sample or not r["text"]:
            continue
        kept = [s for s in r["text"].lower().split("\n") if len(s) > 30 and not prose.surrounding(s) and (t := s.split()) and reader.sentence(s, t) and prose.hits(t, common)[0] == r["label"]]
        if kept:
            own.append(" ".join(kept))
    for k, words in common.items():
        if not samples[k]:
            samples[k] = sorted(words)
    return fit(samples)


_SEGMENT = T.StructType([T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])
_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("running", T.BooleanType()), T.StructField("segments", T.ArrayType(_SEGMENT)),
])


class Tagger:
    """Languages of a batch of texts."""

    def __init__(self, profiles: Profiles, common: dict[str, frozenset[str]]):
        self.p, self.common, self.reader = profiles, common, LineReader(common)
        self.block = max(64, 6_000_000 // max(1, profiles.size))

    def lines(self, text: str) -> tuple[list[tuple[int, str, str | None]], bool]:
        """Body lines fit to be compared, each with the language that most of its common words are in (None if it has less
        than two), and whether the text is running text: at least half of its words, lines around the body aside, stand
        in sentences, and not all of it is notices."""
        out, inside, counted, speaking = [], 0, 0, False
        by_word, known, langs = self.reader.by_word, self.reader.any_common, self.reader.langs
        for i, line in enumerate(text.split("\n")):
            s = line.strip()
            if not s or prose.surrounding(s):
                continue
            low = s.lower()
            tokens = low.split()
            counted += len(tokens)
            if prose.notice(s):
                inside += len(tokens)
                continue
            common = [t for t in tokens if t in by_word]
            if prose.is_sentence(s, tokens, sum([t in known for t in common])):
                inside += len(tokens)
                speaking = True
                if len(tokens) >= LEAST_WORDS and prose.ends_sentence(s) and not prose.bullet(s):
                    votes = [0] * len(langs)
                    for t in common:
                        for k in by_word[t]:
                            votes[k] += 1
                    most = max(votes)
                    out.append((i, low, langs[votes.index(most)] if most >= 2 else None))
        return out, speaking and 2 * inside >= counted

    def tag(self, texts: list[str]) -> list[tuple[str | None, float, bool, list[tuple[int, int, str, float]]]]:
        """Language, confidence, whether it is running text, and segments of each text.

        Lines in a row whose common words are in one language are compared as one; they are a segment of their own if the
        nearest profile is of that language too, else they are in the language of their text.
        """
        p, runs, flat, owner = self.p, [], [], []
        for d, text in enumerate(texts):
            own, running = self.lines(text)
            parts: list[list] = []
            for i, low, lang in own:
                if parts and (lang is None or parts[-1][2] in (None, lang)):
                    parts[-1][1] = i
                    parts[-1][2] = parts[-1][2] or lang
                    parts[-1][3].append(low)
                else:
                    parts.append([i, i, lang, [low]])
            runs.append((parts, running))
            flat += [" ".join(x[3]) for x in parts] or [text.lower()]
            owner += [d] * (len(parts) or 1)
        if not p.langs:
            return [(None, 0.0, r, []) for _, r in runs]
        found, whole = [], np.zeros((len(texts), p.size), np.int64)
        for a in range(0, len(flat), self.block):
            counts = _counts(flat[a : a + self.block], p)
            found.append(_distances(counts, p))
            ids, starts = np.unique(owner[a : a + self.block], return_index=True)
            whole[ids] += np.add.reduceat(counts, starts, axis=0)
        of_run = np.concatenate(found) if found else np.zeros((0, len(p.langs)))
        of_text = _distances(whole, p)
        run_best, text_best = of_run.argmin(axis=1), of_text.argmin(axis=1)
        empty = whole.sum(axis=1) == 0
        out, at = [], 0
        for d, (parts, running) in enumerate(runs):
            n = int(text_best[d])
            # A text in several languages lies between their profiles: its runs tell whether they are known.
            far = of_text[d, n] > p.farthest and of_run[at : at + (len(parts) or 1)].min() > p.farthest
            lang = None if empty[d] else UNKNOWN if far else p.langs[n]
            segments: list[list] = []
            for k, (first, last, named, _) in enumerate(parts):
                best_n = int(run_best[at + k])
                own = best_n if p.langs[best_n] == named and of_run[at + k, best_n] <= p.farthest else n
                name = lang if own == n else named
                conf = confidence(of_run[at + k], own) if name != UNKNOWN else 0.0
                if segments and segments[-1][2] == name:
                    segments[-1][1] = last
                    segments[-1][3].append(conf)
                else:
                    segments.append([first, last, name, [conf]])
            at += len(parts) or 1
            sure = confidence(of_text[d], n) if lang not in (None, UNKNOWN) else 0.0
            out.append((lang, round(sure, 4), running, [(a, b, x, round(sum(c) / len(c), 4)) for a, b, x, c in segments]))
        return out


def _tagged(profiles: Profiles, common: dict[str, frozenset[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(profiles, common)
        names = [f.name for f in _SEGMENT.fields]
        segment = pa.list_(pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                tags = tagger.tag([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([t[0] for t in tags], pa.string()), pa.array([t[1] for t in tags], pa.float64()),
                    pa.array([t[2] for t in tags], pa.bool_()), pa.array([[dict(zip(names, s)) for s in t[3]] for t in tags], segment),
                ], names=_SCHEMA.fieldNames())

    return run


def identify(docs: DataFrame, common_words: DataFrame, profiles: Profiles | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id``, ``label`` (the given one as a code, null if it names no known language),
    ``lang``, ``confidence``, ``running`` (whether it is running text) and ``segments`` (first_line, last_line, lang,
    confidence) of its body lines.

    One Arrow pass over whole texts, no shuffle. ``lang`` is null where a text has no letters of the profiles (so for
    null and empty texts, which are not running). Null ids stay, repeated rows repeat, other columns are ignored.
    """
    common = common_word_sets(common_words)
    profiles = profiles or fit_profiles(docs, common_words, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), label_code(F.col(lang_col)).alias("label"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_tagged(profiles, common), _SCHEMA)


def relabelled(tagged: DataFrame) -> DataFrame:
    """(doc_id, lang) of running texts whose label is missing or wrong, and of each language of mixed ones."""
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    running = tagged.where(F.col("running") & F.col("lang").isNotNull()).select("doc_id", "label", "lang", langs.alias("langs"))
    mixed = F.size("langs") > 1
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    rows = running.where(mixed | wrong).select("doc_id", F.explode(F.when(mixed, F.col("langs")).otherwise(F.array("lang"))).alias("lang"))
    return rows.distinct()
