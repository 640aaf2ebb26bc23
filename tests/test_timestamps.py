from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanframe.operators import timestamps as ts


def iso(us):
    return None if us is None else (datetime(1970, 1, 1) + timedelta(microseconds=us)).isoformat()


@pytest.mark.parametrize(
    ("value", "tz", "expected"),
    [
        ("2022-02-09T09:26:15+02:00", "Asia/Tokyo", "2022-02-09T07:26:15"), ("2025-02-27", "Europe/Paris", "2025-02-26T23:00:00"), ("20240912T174201Z", None, "2024-09-12T17:42:01"),
        ("1714656799862", None, "2024-05-02T13:33:19.862000"), ("1658423718781092", None, "2022-07-21T17:15:18.781092"), ("1751377201.5", None, "2025-07-01T13:40:01.500000"), ("0", None, "1970-01-01T00:00:00"),
        ("2024-W39-4", None, "2024-09-26T00:00:00"), ("2021-366", None, None), ("2020-366", None, "2020-12-31T00:00:00"), ("Sun, 31 Mar 2024 00:34:00 +0100", None, "2024-03-30T23:34:00"),
        ("2024-10-27 02:30", "Europe/Berlin", "2024-10-27T00:30:00"), ("2024-03-31 02:30", "Europe/Berlin", "2024-03-31T01:30:00"), ("2024-01-01T24:00:00Z", None, "2024-01-02T00:00:00"),
        ("  2025-03-28T04:09:02,001+09:00\n", None, "2025-03-27T19:09:02.001000"), ("2025-06-24T05:26:40.123456789Z", None, "2025-06-24T05:26:40.123456"), ("26 de octubre de 2023", None, "2023-10-26T00:00:00"),
        ("August 31, 2023, 12:21 a.m.", None, "2023-08-31T00:21:00"), ("1. März 2025, 04:00", None, "2025-03-01T04:00:00"), ("2024-05-01 10:00:00 CEST", "UTC", "2024-05-01T08:00:00"),
        ("", None, None), (None, None, None), ("yesterday", None, None), ("2024-", None, None), ("0000-00-00", None, None), ("20241345", None, None), ("2023-02-29", None, None), ("12:30", None, None), ("2024-01-01 25:00", None, None), ("2024-01-01 10:00 XYZ", None, None),
    ],
)
def test_clear_values(value, tz, expected):
    a, b = ts.day_month_readings(value, tz)
    assert a == b and iso(a) == expected


def test_ambiguous_values():
    assert [iso(x) for x in ts.day_month_readings("03/04/2024", None)] == ["2024-04-03T00:00:00", "2024-03-04T00:00:00"]
    assert [iso(x) for x in ts.day_month_readings("25.12.24", None)] == ["2024-12-25T00:00:00", None]
    assert ts.day_month_readings("31/31/2022", None) == (None, None)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789-/:. TZWaeJnuprsmd+,", max_size=30))
def test_never_crashes(value):
    ts.day_month_readings(value, "Europe/Paris")


@settings(max_examples=100, deadline=None)
@given(st.datetimes(min_value=datetime(1971, 1, 1), max_value=datetime(2099, 1, 1)))
def test_round_trip(moment):
    us = (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    for text in (moment.isoformat() + "Z", moment.strftime("%Y/%m/%d %H:%M:%S.%f") + " UTC"):
        assert ts.day_month_readings(text, "Asia/Tokyo") == (us, us)


def test_arrays_of_readings():
    assert [iso(x) for x in ts.readings("03/04/2024", "Asia/Tokyo")] == ["2024-04-02T15:00:00", "2024-04-03T00:00:00", "2024-03-03T15:00:00", "2024-03-04T00:00:00"]
    assert [iso(x) for x in ts.readings("2024-03-04", "Asia/Tokyo")] == ["2024-03-03T15:00:00", "2024-03-04T00:00:00"]
    assert [iso(x) for x in ts.readings("25/12/2024", None)] == ["2024-12-25T00:00:00"] * 2 + [None] * 2
    assert len(ts.readings("2024-03-04", None)) == len(ts.readings("2024-03-04T00:00:00Z", "Asia/Tokyo")) == 1
    assert ts.readings("31/31/2022", "Asia/Tokyo") == ts.readings(None, None) == []


def test_the_path_decides(spark, monkeypatch):
    rows = [(i, v, u, "s", None, None, None) for i, (v, u) in enumerate([("03/04/2024", "http://a.example/"), ("2024-01-01", "http://a.example/"), ("25/12/2024", "http://b.example/")])]
    want = run(spark, rows)
    assert want == {0: "2024-04-02T22:00:00.000000Z", 1: "2023-12-31T23:00:00.000000Z"}
    read = [ts.readings("03/04/2024", "Europe/Berlin")]
    at, have, cost = ts._arrays(ts.pa.table({"readings": ts.pa.array(read, ts.pa.list_(ts.pa.int64())), "known": ts.pa.array([0], ts.pa.int32()), "usual": ts.pa.array([-1], ts.pa.int32())}))
    assert cost.tolist() == [[0.0, ts.PRIOR, ts.PRIOR, 2 * ts.PRIOR]] and have.all()
    free = ts.np.zeros(4)
    assert ts._path(at, have, cost, free, free).tolist() == [0] and ts._path(at, have, cost * 0, free, ts.np.array([9.0, 9.0, 9.0, 0.0])).tolist() == [3]


SITES = [("a.example", "Europe/Berlin", "dmy"), ("b.example", "America/New_York", "mdy"), (None, None, None)]


def run(spark, rows, block=ts.BLOCK, sites=SITES):
    df = spark.createDataFrame(rows, "id long, v string, url string, src string, tz string, day_order string, _site string")
    s = spark.createDataFrame(sites, "site string, tz string, day_order string")
    read = ts.interpret(df, s, "t/v", "id", "v", "url", "src")
    return {r.row_id: r.utc for r in ts.choose(read, block).collect()}


def test_site_order_zone_and_odd_input(spark):
    rows = [
        (1, "03/04/2024", "https://www.A.example/x", "s", "x", "x", "x"), (2, "03/04/2024", "http://b.example:80/", "s", None, None, None), (3, "25/12/2024", "http://b.example/", "s", None, None, None),
        (4, None, "http://a.example/", None, None, None, None), (5, "2024-01-01", None, None, None, None, None), (6, " ", "x", "s", None, None, None),
    ]
    assert run(spark, rows) == {1: "2024-04-02T22:00:00.000000Z", 2: "2024-03-04T05:00:00.000000Z", 5: "2024-01-01T00:00:00.000000Z"}
    assert run(spark, []) == {}
    assert run(spark, rows[4:5], sites=[]) == {5: "2024-01-01T00:00:00.000000Z"}


def best_path(values):
    """Brute force over all assignments of an order to each record of a site that isn't known."""
    read = [ts.day_month_readings(v, None) for v in values]
    read = [r for r in read if r != (None, None)]
    best = None
    for path in itertools.product((0, 1), repeat=len(read)):
        cost = sum(0 if r[p] is not None else ts.UNREADABLE for r, p in zip(read, path))
        for (a, p), (b, q) in itertools.pairwise(zip(read, path)):
            cost += ts.SWITCH * (p != q) + ts.BACKWARD * (a[p] is not None and b[q] is not None and b[q] < a[p])
        best = cost if best is None else min(best, cost)
    return best


def cost_of(values, got):
    """The least cost of a path that gives these instants."""
    read = [r for r in (ts.day_month_readings(v, None) for v in values) if r != (None, None)]
    best = None
    for path in itertools.product((0, 1), repeat=len(read)):
        if [iso(r[p]) for r, p in zip(read, path) if r[p] is not None] != [datetime.fromisoformat(g[:-1]).isoformat() for g in got]:
            continue
        cost = sum(0 if r[p] is not None else ts.UNREADABLE for r, p in zip(read, path))
        for (a, p), (b, q) in itertools.pairwise(zip(read, path)):
            cost += ts.SWITCH * (p != q) + ts.BACKWARD * (a[p] is not None and b[q] is not None and b[q] < a[p])
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_give_the_best_path(spark, block):
    rng = random.Random(5)
    rows, values = [], {}
    for g in range(4):
        values[g] = [f"{rng.randint(1, 14):02d}/{rng.randint(1, 14):02d}/2024" if rng.random() < 0.8 else f"2024-{rng.randint(1, 12):02d}-05" for _ in range(11)]
        rows += [(100 * g + i, v, "http://unknown.example/", f"s{g}", None, None, None) for i, v in enumerate(values[g])]
    got = run(spark, rows, block)
    for g, vs in values.items():
        assert cost_of(vs, [got[i] for i in sorted(got) if i // 100 == g]) == pytest.approx(best_path(vs))


def test_writing_decides_where_nothing_else_does(spark):
    got = run(spark, [(1, "03/04/2024 5:05 PM", "http://unknown.example/", "s", None, None, None), (2, "03.04.2024", "http://unknown.example/", "t", None, None, None)])
    assert got == {1: "2024-03-04T17:05:00.000000Z", 2: "2024-04-03T00:00:00.000000Z"}
    assert [ts.usual_order(v) for v in ("03/04/2024", "03.04.24", "3/4/2024 1:02 am", "2024-03-04")] == [-1, 0, 1, -1]


def test_evidence_in_a_source_decides(spark):
    vs = ["25/03/2024", "04/05/2024", "05/06/2024", "26/07/2024"]
    got = run(spark, [(i, v, "http://unknown.example/", "s", None, None, None) for i, v in enumerate(vs)])
    assert got[1].startswith("2024-05-04") and got[2].startswith("2024-06-05")
