"""Robots rules: parsed once per body, applied by first match in order."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..runtime import materialize, small_or_plain


def parse_rules(body: str | None, agent: str = "*") -> list[tuple[str, bool]]:
    """(path prefix, allowed) in order, of the first group that names ``agent`` exactly; nothing for no or empty body.

    An empty Disallow allows all. Paths are percent-quoted as addresses are when matched.
    """
    rules: list[tuple[str, bool]] = []
    agents: list[str] = []
    collecting = taken = False
    for raw in (body or "").splitlines():
        key, sep, value = raw.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), unquote(value.strip())
        if not sep:
            if not raw.strip() and collecting:
                taken = taken or (agent in agents and bool(rules))
                agents, collecting = [], False
            continue
        if key == "user-agent":
            if collecting:
                taken = taken or agent in agents
                agents, collecting = [], False
            agents.append(value.lower() if value != "*" else "*")
        elif key in ("allow", "disallow") and agents:
            collecting = True
            if agent in agents and not taken:
                allowed = key == "allow" or not value
                rules.append((quote(urlunparse(urlparse(value))), allowed))
    return rules


def sitemap_directives(robots: DataFrame, base_col: str = "base", body_col: str = "body") -> DataFrame:
    """(base, pos, sitemap): the sitemaps that robots bodies name, resolved against their base; null bodies name none."""
    lines = robots.select(F.col(base_col).alias("base"), F.posexplode(F.split(body_col, r"\r?\n|\r")).alias("pos", "line"))
    value = F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(.*?)\s*$", 1)
    found = lines.where(F.col("line").rlike(r"(?i)^\s*sitemap:")).select("base", "pos", value.alias("value"))
    absolute = F.when(F.col("value").rlike("^https?://"), F.col("value")).when(F.col("value").startswith("/"), F.concat(urls.origin(F.col("base")), F.col("value"))).otherwise(F.concat(F.col("base"), F.lit("/"), F.col("value")))
    return found.select("base", "pos", absolute.alias("sitemap"))


def rules_table(robots: DataFrame, base_col: str = "base", body_col: str = "body", agent: str = "*") -> DataFrame:
    """(host, rule_idx, prefix, allowed) of all bodies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, i, p, a) for h, body in zip(b["host"], b["body"]) for i, (p, a) in enumerate(parse_rules(body, agent))]
            yield pd.DataFrame(rows, columns=["host", "rule_idx", "prefix", "allowed"])

    picked = robots.select(F.lower(urls.netloc(F.col(base_col))).alias("host"), F.col(body_col).alias("body"))
    return picked.mapInPandas(run, "host string, rule_idx int, prefix string, allowed boolean")


def target(url: Column) -> Column:
    """What rules are matched against: the path (at least ``/``) and the query."""
    path, query = urls.path(url), urls.query(url)
    return F.concat(F.when(path == "", F.lit("/")).otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def allowed_by(url: Column, body: str | None, agent: str = "*") -> Column:
    """Whether one robots body allows an address of any host: one expression, no join. Null addresses are allowed."""
    at, out = target(url), F.lit(True)
    for prefix, ok in reversed(parse_rules(body, agent)):
        out = F.when(at.startswith(prefix) | F.lit(prefix == "*"), F.lit(ok)).otherwise(out)
    return F.coalesce(out, F.lit(True))


def allowed(rows: DataFrame, robots: DataFrame, url_col: str = "url", agent: str = "*", **columns) -> DataFrame:
    """``rows`` with ``allowed``: the first rule of the address's host whose prefix its path and query start with.

    No rule, no body or no host allows. The rules come to the rows by host, broadcast if they are few: a hot host's
    rows stay where they are. The rules of one host are read in order on the row, so nothing is regrouped.
    """
    table = rules_table(robots, agent=agent, **columns)
    by_host = table.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rule_idx", "prefix", "allowed"))).alias("_rules"))
    by_host = small_or_plain(materialize(by_host.withColumnRenamed("host", "_host"), "robots-rules"))
    url = F.col(url_col)
    at = target(url)
    joined = rows.join(by_host, F.lower(urls.netloc(url)) == F.col("_host"), "left")
    first = F.filter("_rules", lambda r: F.startswith(at, r["prefix"]) | (r["prefix"] == "*"))
    return joined.withColumn("allowed", F.coalesce(F.try_element_at(first, F.lit(1))["allowed"], F.lit(True))).drop("_host", "_rules")
