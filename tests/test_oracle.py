"""Every core query with SQL gives the SQL's rows, names and kinds of types on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from gleanframe.plans import queries as core


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


def rows_of(names, rows):
    order = [names.index(n) for n in sorted(names)]
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_rows(spark, db, data, name):
    df = core.QUERIES[name](spark, data)
    sql = db.sql(core.ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_runs(spark, data, name):
    assert core.QUERIES[name](spark, data).count() > 0


def test_full_walk_like_brute_force(spark, tmp_path):
    links = {0: [1], 1: [2], 2: [3, 0], 3: [4], 4: [5, 1], 5: [6], 6: [7], 7: [7]}
    rows = [(i, f"http://a.example/{i}", "".join(f'<a href="/{j}">x</a>' for j in to)) for i, to in links.items()] + [(8, "http://b.example/0", '<a href="/1">x</a>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    near = {i: set(to) | {j for j, back in links.items() if i in back} for i, to in links.items()}
    depth, level = {0: 0}, [0]
    while level:
        level = sorted({j for i in level for j in near[i]} - set(depth))
        depth |= {j: depth[min(i for i in near[j] if i in depth)] + 1 for j in level}
    expected = {f"http://a.example/{i}": n for i, n in depth.items()} | {"http://b.example/0": 0, "http://b.example/1": 1}
    assert {r.url: r.depth for r in core.QUERIES["crawl_bfs_full"](spark, str(tmp_path)).collect()} == expected and max(depth.values()) > 4
