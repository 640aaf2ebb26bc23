"""The queries run over the smallest tables, give the columns they must, and agree with SQL where there is some."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from gleanframe.llm import queries as llm

COLUMNS = {
    "p1_found": ["doc_id"], "p2_found": ["doc_id", "line_no"], "p3_found": ["tbl", "row_id"], "p5_found": ["item_id", "field", "line_no"], "p6_found": ["doc_id"], "p8_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_runs(spark, data, name):
    df = llm.QUERIES[name](spark, data)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(set(map(tuple, rows))) == len(rows)
    if name in llm.ORACLE:
        con = duckdb.connect()
        for p in Path(data).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        sql = con.sql(llm.ORACLE[name])
        at = [sql.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, rows)) == sorted(tuple(r[i] for i in at) for r in sql.fetchall())


def test_prose_agrees_with_hand_labels(spark, data):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = {r.doc_id: r.is_prose for r in llm.QUERIES["p1_quality"](spark, data).collect()}
    assert all(got[i] == bool(q) for i, q in labels.items() if i in got)
