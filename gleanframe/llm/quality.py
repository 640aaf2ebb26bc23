"""Per-document text statistics, exact per-language ranks and outlier scores that tell prose from lists, tables and junk."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, running_positions
from . import prose
from .labels import label_code

STATISTICS = ("n_words", "mean_word_len", "symbol_ratio", "end_punct_share", "common_share", "sentence_share")

#: Language of documents that give no evidence of one.
DEFAULT_LANGUAGE = "en"
#: Most entries of the common-word table (a dictionary); it is an error to pass more.
MAX_COMMON_WORDS = 100_000
#: A value held by at least this share of a statistic's documents counts as hot; there are at most its reciprocal of them.
HOT_SHARE = 0.001
#: Values of a document that is half prose. What lies farther out in its language, all of these taken together, is junk.
HALF_PROSE = {"sentence_share": 0.5, "common_share": 0.22}
#: Share of words in sentences from which an outlier is prose all the same.
PROSE_SHARE = 2 / 3

# Characters that count as symbols.
SYMBOLS = "#$%&*+/<=>@[\\]^_`{|}~¤¦§¨©¬®¯°±´¶·¸¹²³º¼½¾¿¡×÷ˆ˜€™†‡•‰�"

_STATS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("group_lang", T.StringType()),
    *[T.StructField(s, T.DoubleType()) for s in STATISTICS],
])


def common_word_sets(common_words: DataFrame) -> dict[str, frozenset[str]]:
    """The dictionary of frequent words by language, on the driver; its size is checked."""
    rows = common_words.select("lang", "word").dropna().limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"common_words has more than {MAX_COMMON_WORDS} entries")
    out: dict[str, set[str]] = {}
    for lang, word in rows:
        out.setdefault(lang, set()).add(word.lower())
    return {k: frozenset(v) for k, v in sorted(out.items())}


class LineReader:
    """Counts of one text by its lines; used wherever running text must be told from the rest."""

    def __init__(self, common: dict[str, frozenset[str]]):
        self.langs = list(common)
        self.by_word: dict[str, tuple[int, ...]] = {}
        for i, lang in enumerate(self.langs):
            for w in common[lang]:
                self.by_word[w] = (*self.by_word.get(w, ()), i)
        self.any_common = frozenset(w for w in self.by_word if len(w) > 1)

    def sentence(self, line: str, tokens: list[str]) -> bool:
        """Whether the line, split at white space in lower case, is running text or a notice."""
        known = self.any_common
        return prose.is_sentence(line, tokens, sum([t in known for t in tokens])) or prose.notice(line)

    def read(self, text: str) -> tuple[str | None, list[float | None]]:
        """The language with most common words (or None) and the statistics, in the order of STATISTICS."""
        counts = [0] * len(self.langs)
        by_word, known = self.by_word, self.any_common
        n_chars = n_common = n_lines = n_ended = counted = inside = n_words = 0
        for line in text.split("\n"):
            s = line.strip()
            if not s:
                continue
            tokens = s.lower().split()
            size = len(tokens)
            n_words += size
            n_chars += sum(map(len, tokens))
            common = [t for t in tokens if t in by_word]
            n_common += len(common)
            for t in common:
                for i in by_word[t]:
                    counts[i] += 1
            if prose.surrounding(s):
                continue
            n_lines += 1
            n_ended += prose.ends_sentence(s)
            counted += size
            if prose.is_sentence(s, tokens, sum([t in known for t in common])) or prose.notice(s):
                inside += size
        best = max(counts, default=0)
        lang = self.langs[counts.index(best)] if best >= 3 and best >= 0.08 * n_words else None
        n_symbols = sum(map(text.count, SYMBOLS))
        return lang, [
            float(n_words),
            round(n_chars / n_words, 3) if n_words else 0.0,
            round(n_symbols / len(text), 4) if text else 0.0,
            round(n_ended / n_lines, 4) if n_lines else 1.0,
            round(n_common / n_words, 4) if n_words else 0.0,
            round(inside / counted, 4) if counted else 1.0,
        ]


def _statistics(common: dict[str, frozenset[str]], default: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader(common)
        for b in batches:
            langs, cols = [], [[] for _ in STATISTICS]
            for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lang, values = reader.read(text or "")
                langs.append(lang or label or default)
                for c, v in zip(cols, values):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), *[pa.array(c, pa.float64()) for c in cols], *b.columns[3:]],
                names=names,
            )

    return run


def text_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", default_lang: str = DEFAULT_LANGUAGE, with_key: bool = False) -> DataFrame:
    """One row per document with its statistics; one Arrow pass over whole texts, no shuffle.

    Columns: ``doc_id``, ``group_lang`` (language by common words, else by label, else ``default_lang``) and STATISTICS.
    ``n_words`` counts strings between white space. ``mean_word_len`` is in characters, ``symbol_ratio`` the share of
    characters that are in SYMBOLS. ``end_punct_share`` and
    ``sentence_share`` leave out the lines around a body (menus, notices, bylines); the latter is the share of the
    remaining words that stand in sentence lines. Null and empty texts give 0 words and shares of 0, 1, 0 and 1
    (nothing speaks against them). Null ids stay. Other columns are ignored, whatever their names. Repeated rows repeat.
    With ``with_key`` the hash of the text is added as ``text_key``.
    """
    common = common_word_sets(common_words)
    label = label_code(F.col(lang_col)) if lang_col else F.lit(None).cast("string")
    key = [F.xxhash64(F.col(text_col)).alias("text_key")] if with_key else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), label.alias("label"), *key)
    schema = T.StructType([*_STATS_SCHEMA.fields, *[T.StructField("text_key", T.LongType()) for _ in key]])
    return rows.mapInArrow(_statistics(common, default_lang, schema.fieldNames()), schema)


def _long(stats: DataFrame, statistics: tuple[str, ...]) -> DataFrame:
    """One row a document and statistic; NaN is a value above all others."""
    return stats.select(
        "row", "group_lang", F.col("once") if "once" in stats.columns else F.lit(1).alias("once"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(s).alias("value")) for i, s in enumerate(statistics)])).alias("_x"),
    ).select("row", "group_lang", "once", "_x.stat", "_x.value")


def value_tails(stats: DataFrame, statistics: tuple[str, ...] = STATISTICS) -> DataFrame:
    """Left and right empirical tail of each value of each statistic within its language, exactly.

    ``stats`` (row, group_lang, the statistics) must be materialised. Values are counted before they move, so equal
    values, however many, are one row of the sort; the distinct values are range-partitioned, summed within partitions
    and shifted by partition offsets (``running_positions``). Rows: ``group_lang``, ``stat``, ``value``, ``n``
    (documents with it), ``texts`` (the language's documents that count), ``left``, ``right``. Where ``stats`` has
    ``once`` (1 for one copy of a text, 0 for the others), ranks are over the copies that count.
    """
    cells = materialize(_long(stats, statistics).groupBy("group_lang", "stat", "value").agg(F.count("*").alias("n"), F.sum("once").alias("texts")), "cells")
    ranked = running_positions(cells, ["group_lang", "stat"], ["value"], "cell-ranks", weight="texts")
    return materialize(ranked.select(
        "group_lang", "stat", "value", "n", F.col("_total").alias("texts"),
        ((F.col("_before") + F.col("texts")) / F.col("_total")).alias("left"),
        ((F.col("_total") - F.col("_before")) / F.col("_total")).alias("right"),
    ), "ranked")


def tail_probabilities(stats: DataFrame, statistics: tuple[str, ...] = STATISTICS, tails: DataFrame | None = None) -> DataFrame:
    """(row, stat, left, right): the tails of each document's values (``value_tails``, or those given).

    Hot values (at least HOT_SHARE of a statistic's documents, so at most 1/HOT_SHARE a statistic) return to the
    documents by broadcast, all others by a shuffled join of bounded groups.
    """
    ranked = value_tails(stats, statistics) if tails is None else tails
    long = _long(stats, statistics)
    total = (ranked.agg(F.sum("n")).first()[0] or 0) / len(statistics)
    hot = max(1.0, total * HOT_SHARE)
    ranked = ranked.select(F.col("group_lang").alias("_l"), F.col("stat").alias("_s"), F.col("value").alias("_v"), "n", "left", "right")
    on = F.col("group_lang").eqNullSafe(F.col("_l")) & (F.col("stat") == F.col("_s")) & F.col("value").eqNullSafe(F.col("_v"))
    keep = ["row", "stat", "left", "right"]
    tagged = long.join(F.broadcast(ranked.where(F.col("n") >= hot)), on, "left")
    common = tagged.where(F.col("_s").isNotNull()).select(*keep)
    rest = tagged.where(F.col("_s").isNull()).select("row", "group_lang", "stat", "value").join(ranked.where(F.col("n") < hot), on).select(*keep)
    return common.unionByName(rest)


def reference_scores(tails: DataFrame, statistics: tuple[str, ...], reference: dict[str, float]) -> DataFrame:
    """(group_lang, cut): the score that a document with the values of ``reference`` would have in each language.

    The sum of negative log left tails. A value that all documents exceed has the tail it would have as one more document.
    """
    sums = []
    for s, value in reference.items():
        left = F.max(F.when((F.col("stat") == statistics.index(s)) & (F.col("value") <= F.lit(value)), F.col("left")))
        sums.append(-F.log(F.coalesce(left, 1 / (F.max("texts") + 1))))
    return tails.groupBy("group_lang").agg(sum(sums[1:], sums[0]).alias("cut"))


def outlier_scores(stats: DataFrame, statistics: tuple[str, ...] = STATISTICS, reference: dict[str, float] = HALF_PROSE) -> DataFrame:
    """``stats`` with ``outlier_score`` and ``junk_score``, both sums of negative log tail probabilities.

    ``outlier_score`` is the largest of three sums: all left tails, all right tails, and per statistic the tail on the
    side of its skew (empirical-cumulative outlier detection). ``junk_score`` sums the left tails of the statistics in
    ``reference`` and takes off what a document with the reference's values would score in that language, so that 0
    parts what is less prose than the reference from what is more, whatever share of a language is junk. Documents are
    ranked within ``group_lang``; where ``stats`` has ``text_key``, copies of a text count once there, so that what is
    repeated can't become the rule by that. An empty table stays empty.
    """
    stats = materialize(stats.withColumn("row", F.monotonically_increasing_id()), "stats")
    counted = stats
    if "text_key" in stats.columns:
        firsts = stats.groupBy("group_lang", "text_key").agg(F.min("row").alias("row")).select("row", F.lit(1).alias("_first"))
        stats = materialize(stats.join(firsts, "row", "left").withColumn("once", F.coalesce("_first", F.lit(0))).drop("_first", "text_key"), "stats-once")
        counted = stats.where("once = 1")
    skews = counted.groupBy("group_lang").agg(*[F.coalesce(F.skewness(s), F.lit(0.0)).alias(s) for s in statistics])
    ranked = value_tails(stats, statistics)
    cuts = reference_scores(ranked, statistics, reference)
    wide = tail_probabilities(stats, statistics, ranked).groupBy("row").agg(
        F.sum(-F.log("left")).alias("_left"), F.sum(-F.log("right")).alias("_right"),
        F.sum(F.when(F.col("stat").isin(*map(statistics.index, reference)), -F.log("left"))).alias("_junk"),
        *[F.max(F.when(F.col("stat") == i, -F.log(c))).alias(f"_{c}{i}") for i in range(len(statistics)) for c in ("left", "right")],
    )
    signs = skews.select(F.col("group_lang").alias("_g"), *[F.col(s).alias(f"_skew{i}") for i, s in enumerate(statistics)])
    signs = signs.join(cuts, F.col("_g").eqNullSafe(F.col("group_lang"))).drop("group_lang")
    # One row a language: the number of languages is bounded by the common-word table and the known labels.
    joined = stats.join(F.broadcast(signs), F.col("group_lang").eqNullSafe(F.col("_g"))).join(wide, "row")
    auto = sum((F.when(F.col(f"_skew{i}") < 0, F.col(f"_left{i}")).otherwise(F.col(f"_right{i}")) for i in range(1, len(statistics))), F.when(F.col("_skew0") < 0, F.col("_left0")).otherwise(F.col("_right0")))
    return joined.select(*[c for c in stats.columns if c not in ("row", "once")], F.round(F.greatest("_left", "_right", auto), 6).alias("outlier_score"), F.round(F.col("_junk") - F.col("cut"), 6).alias("junk_score"))


def prose_quality(docs: DataFrame, common_words: DataFrame, statistics: tuple[str, ...] = STATISTICS, **columns) -> DataFrame:
    """Statistics, outlier scores and ``is_prose`` of each document.

    A document isn't prose if its ``junk_score`` is 0 or more: in its language it lies at least as far out as a
    document that is half prose would. A check follows: at least PROSE_SHARE of the words in sentences is prose.
    ``statistics`` are those that go into ``outlier_score``, the ones of HALF_PROSE among them; ``is_prose`` doesn't
    depend on the others. See ``text_statistics`` for odd input.
    """
    scored = outlier_scores(text_statistics(docs, common_words, with_key=True, **columns), statistics)
    return scored.withColumn("is_prose", (F.col("junk_score") < 0) | (F.col("sentence_share") >= PROSE_SHARE))
