from __future__ import annotations

import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from gleanframe import runtime


def brute(rows):
    total, before, out = defaultdict(int), defaultdict(int), {}
    for g, k, w in rows:
        total[g] += w
    for g, k, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        out[(g, k)] = (before[g], total[g])
        before[g] += w
    return out


@pytest.mark.parametrize("weight", [None, "w"])
def test_positions_with_a_hot_group(spark, weight):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), k, rng.randint(0, 5)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, w long")
    got = {(r.g, r.k): (r._before, r._total) for r in runtime.running_positions(df, ["g"], ["k"], "t", weight).collect()}
    assert got == brute([(g, k, w if weight else 1) for g, k, w in rows])


def test_positions_of_an_empty_table(spark):
    assert runtime.running_positions(spark.createDataFrame([], "g string, k long"), ["g"], ["k"], "t").count() == 0


def test_small_or_plain(spark):
    df = spark.range(10)
    assert "broadcast" in runtime.small_or_plain(df)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in runtime.small_or_plain(df, 5)._jdf.queryExecution().toString().lower()


class _Session:
    """As much of a session as ``shared_dir`` asks."""

    def __init__(self, folder, master):
        self.conf = type("C", (), {"get": staticmethod(lambda k, d=None: folder)})()
        own = type("S", (), {"get": staticmethod(lambda k, d=None: None)})()
        self.sparkContext = type("X", (), {"master": master, "getConf": staticmethod(lambda: own)})()


def test_shared_folder():
    assert runtime.shared_dir(_Session("hdfs:///shared", "yarn")) == "hdfs:///shared"
    assert runtime.shared_dir(_Session(None, "local[2]")).startswith("file:///")
    with pytest.raises(RuntimeError):
        runtime.shared_dir(_Session(None, "yarn"))


def test_entry(spark, data):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["page_id", "link", "norm"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
