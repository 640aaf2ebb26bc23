"""Queries of the text-data operators, by problem, and the SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import body, labels, language, mixing, packing, quality, repeats, residue
from .tokens import VOCABULARY, token_counts
from ..runtime import materialize

#: Most rows of the table of containers; it is a setting, not data.
MAX_CONTAINERS = 1000


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.prose_quality(_t(spark, d, "documents"), _t(spark, d, "common_words"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Outliers by the statistics that decide; the others need no ranks here."""
    found = quality.prose_quality(_t(spark, d, "documents"), _t(spark, d, "common_words"), tuple(quality.HALF_PROSE))
    return found.where(~F.col("is_prose")).select("doc_id")


def p1_tails(spark: SparkSession, d: str) -> DataFrame:
    """Exact tails of each document's length, words and mean word length among the documents of its label."""
    words = F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)))
    stats = _t(spark, d, "documents").select(F.col("doc_id").alias("row"), F.col("lang").alias("group_lang"), F.length("text").cast("double").alias("chars"), words.cast("double").alias("words"))
    stats = materialize(stats.withColumn("word_len", F.round(F.col("chars") / (F.col("words") + 1), 6)), "simple-stats")
    tails = quality.tail_probabilities(stats, ("chars", "words", "word_len"))
    return tails.select(F.col("row").alias("doc_id"), "stat", F.round("left", 9).alias("left_tail"), F.round("right", 9).alias("right_tail"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_lines(_t(spark, d, "documents"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeats.without_repeated_lines(_t(spark, d, "documents"))


def p2_clean_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same for lines that are repeated by their letters, near-duplicates left in."""
    return repeats.without_repeated_lines(_t(spark, d, "documents"), near=False)


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every field that holds residue, with the reason and the covered share."""
    docs = residue.residue(_t(spark, d, "documents"), "doc_id", ("text",)).select(F.lit("documents").alias("tbl"), "*")
    items = residue.residue(_t(spark, d, "content_items"), "item_id", ("text", "content")).select(F.lit("content_items").alias("tbl"), "*")
    return docs.unionByName(items)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_reasons(spark, d).select("tbl", "row_id").distinct()


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """The rows of both tables that remain as content."""
    docs = residue.without_residue(_t(spark, d, "documents"), "doc_id").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"))
    items = residue.without_residue(_t(spark, d, "content_items"), "item_id", ("text", "content"))
    return docs.unionByName(items.select(F.lit("content_items").alias("tbl"), F.col("item_id").alias("row_id")))


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    rows = _t(spark, d, "containers").dropna().limit(MAX_CONTAINERS + 1).collect()
    if len(rows) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} containers")
    return {r["container"]: r["capacity"] for r in rows}


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(token_counts(_t(spark, d, "documents"), {"doc_id": "doc_id"}, "text", VOCABULARY), "token-sizes")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    placed = packing.pack(_sizes(spark, d), _capacities(spark, d)["main"])
    return placed.where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("doc_id")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each kind."""
    sizes = _sizes(spark, d)
    kinds = [packing.pack(sizes, c, f"pack-{k}").select(F.lit(k).alias("container"), "*") for k, c in sorted(_capacities(spark, d).items())]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used and room left, by kind of container."""
    sizes = _sizes(spark, d)
    kinds = [packing.fill_report(packing.pack(sizes, c, f"pack-{k}"), c).select(F.lit(k).alias("container"), "*") for k, c in sorted(_capacities(spark, d).items())]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def p6_violations(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: containers above their capacity, and documents whose pieces aren't their tokens. No rows."""
    sizes, capacities = _sizes(spark, d), _capacities(spark, d)
    goal = spark.createDataFrame(list(capacities.items()), "container string, capacity long")
    placed = materialize(p6_pack(spark, d), "placed")
    full = placed.where(F.col("container_no").isNotNull()).groupBy("container", "container_no").agg(F.sum("size").alias("held"))
    over = full.join(F.broadcast(goal), "container").where(F.col("held") > F.col("capacity")).select("container", F.col("container_no").alias("id"))
    whole = placed.groupBy("container", "doc_id").agg(F.sum("size").alias("held"))
    lost = whole.join(sizes, "doc_id").where(F.col("held") != F.col("n_tokens")).select("container", F.col("doc_id").alias("id"))
    return over.unionByName(lost)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = _t(spark, d, "mix_targets")
    return mixing.mix_shares(mixing.mix(_t(spark, d, "documents"), targets), targets)


def p7_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 256 characters that each source gets: the apportionment alone, over sizes that SQL can tell."""
    docs = _t(spark, d, "documents").select(repeats.site_of(F.col("source"), F.col("url")).alias("source"), F.length("text").alias("n"))
    wanted = mixing.read_targets(_t(spark, d, "mix_targets"))
    goal = spark.createDataFrame([(s,) for s in wanted], "source string")
    held = {r["source"]: r["t"] for r in docs.join(F.broadcast(goal), "source").groupBy("source").agg(F.sum("n").alias("t")).where("t > 0").collect()}
    quotas = mixing.block_quotas(held, wanted, sum(held.values()))
    return spark.createDataFrame([(s, q) for s, q in quotas.items() if q], "source string, quota long")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = body.boilerplate(_t(spark, d, "content_items"))
    return found.select("item_id", "field", F.explode("lines").alias("line_no"))


def p5_body(spark: SparkSession, d: str) -> DataFrame:
    """The main body of both fields of each item."""
    return body.main_body(_t(spark, d, "content_items"))


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each page of markup."""
    return body.page_bodies(_t(spark, d, "pages"))


def p8_label_codes(spark: SparkSession, d: str) -> DataFrame:
    """The given labels as codes."""
    return _t(spark, d, "documents").select("doc_id", labels.label_code(F.col("lang")).alias("label"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document and of its segments."""
    return language.identify(_t(spark, d, "documents"), _t(spark, d, "common_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.relabelled(p8_languages(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_quality": p1_quality,
    "p1_tails": p1_tails,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p2_clean_exact": p2_clean_exact,
    "p3_found": p3_found,
    "p3_reasons": p3_reasons,
    "p3_kept": p3_kept,
    "p5_found": p5_found,
    "p5_body": p5_body,
    "p5_pages": p5_pages,
    "p6_found": p6_found,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_violations": p6_violations,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_quotas": p7_quotas,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
    "p8_label_codes": p8_label_codes,
}

# Site of a document: its source, else the host of its url.
_SITE = r"coalesce(nullif(trim(source), ''), nullif(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:@]+)', 1)), ''))"

# Occurrences g of the lines that five documents of a site have.
_REPEATED = rf"""WITH l AS (
  SELECT doc_id, {_SITE} AS site, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT doc_id, site, line_no, regexp_replace(replace(lower(line), 'ß', 'ss'), '[^\p{{L}}\p{{M}}]+', '', 'g') AS key FROM l WHERE site IS NOT NULL
), g AS (
  SELECT doc_id, line_no FROM k WHERE key <> '' AND (site, key) IN (SELECT (site, key) FROM k WHERE key <> '' GROUP BY site, key HAVING count(DISTINCT doc_id) >= 5)
)"""

ORACLE: dict[str, str] = {
    "p1_tails": """
WITH w AS (
  SELECT doc_id, lang, CAST(length(text) AS DOUBLE) AS chars, CAST(len(regexp_extract_all(text, '[^ ]+')) AS DOUBLE) AS words FROM documents
), v AS (
  SELECT doc_id, lang, 0 AS stat, chars AS v FROM w UNION ALL SELECT doc_id, lang, 1, words FROM w UNION ALL SELECT doc_id, lang, 2, round(chars / (words + 1), 6) FROM w
)
SELECT doc_id, stat, round(cume_dist() OVER (PARTITION BY lang, stat ORDER BY v), 9) AS left_tail, round(cume_dist() OVER (PARTITION BY lang, stat ORDER BY v DESC), 9) AS right_tail FROM v
""",
    "p2_found": rf"""
{_REPEATED} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM g
""",
    "p2_clean_exact": rf"""
{_REPEATED}, d AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS removed FROM g GROUP BY doc_id), a AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT a.doc_id, string_agg(line, chr(10) ORDER BY a.line_no) AS text FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.line_no = g.line_no WHERE g.doc_id IS NULL GROUP BY a.doc_id
)
SELECT documents.doc_id, CASE WHEN d.removed IS NULL THEN documents.text ELSE coalesce(t.text, '') END AS text, coalesce(d.removed, 0) AS removed
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id LEFT JOIN t ON documents.doc_id = t.doc_id
""",
    "p7_quotas": rf"""
WITH h AS (SELECT {_SITE} AS source, sum(length(text)) AS t FROM documents GROUP BY ALL HAVING sum(length(text)) > 0),
g AS (SELECT h.source, weight, t, CAST(ceil(max_repeats * t / 256.0) AS BIGINT) AS cap FROM h JOIN mix_targets m ON h.source = m.source WHERE weight > 0 AND max_repeats > 0),
n AS (SELECT CAST(floor(sum(t) / 256.0 + 0.5) AS BIGINT) AS seats FROM g),
q AS (SELECT source, weight / (2 * k + 1) AS v FROM (SELECT source, weight, unnest(range(least(cap, seats))) AS k FROM g, n)),
r AS (SELECT source, row_number() OVER (ORDER BY v DESC, source) AS place FROM q)
SELECT source, count(*) AS quota FROM r, n WHERE place <= seats GROUP BY source
""",
    "p6_violations": "SELECT '' AS container, CAST(0 AS BIGINT) AS id WHERE false",
    "p8_label_codes": r"""
WITH n(label, name) AS (VALUES ('en', 'en eng english'), ('de', 'de deu ger german deutsch'), ('fr', 'fr fra fre french français francais'), ('es', 'es spa spanish español espanol castellano'),
  ('it', 'it ita italian italiano'), ('pt', 'pt por portuguese português portugues'), ('nl', 'nl nld dut dutch nederlands'))
SELECT doc_id, n.label FROM (SELECT doc_id, lower(regexp_extract(trim(lang), '^([\p{L}]+)(?:[-_][\p{L}0-9]{2,8})*$', 1)) AS head FROM documents) d
LEFT JOIN n ON list_contains(string_split(n.name, ' '), d.head) AND d.head <> ''
""",
}
