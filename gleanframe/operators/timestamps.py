"""Mixed timestamp formats and zones brought to one UTC instant each.

Every value gets an array of all its valid readings, one a format: day or month first, wall clock of the site or UTC.
A Viterbi path over each source's records in order then picks the format of each, with penalties for switching formats
and for going back in time; what is known of a site is the cost of doing otherwise. Sources are cut into blocks of bounded
length: blocks are summarised by their cost matrices, the matrices are chained, and each block is solved with the costs
at both its ends, which gives exactly the path over the whole source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import site as url_site
from ..runtime import materialize, running_positions

#: Records of one source that are solved together; longer sources are cut and joined exactly.
BLOCK = 50_000
#: Costs: another order of day and month, or another clock, than at the record before; an instant before the last one; a
#: value that a format can't read; a reading against the site's known order, or in UTC where the site's zone is known; one
#: against the usual order beside a 12-hour clock (month first) or between full stops (day first).
SWITCH, BACKWARD, UNREADABLE, PRIOR, UNUSUAL = 3.0, 1.0, 8.0, 20.0, 1.5
#: Formats: day or month first, in the site's clock or in UTC.
FORMATS = ("day first, local", "day first, UTC", "month first, local", "month first, UTC")
#: Most rows of the table of sites that is sent to the executors.
MAX_SITES = 200_000

# Month names and abbreviations in seven languages, in calendar order; a form may serve several languages.
MONTHS = (
    "jan january januar jänner janvier janv enero ene gennaio gen janeiro januari",
    "feb february februar février févr fevrier febrero febbraio fevereiro fev februari",
    "mar march märz maerz mrz mars marzo março marco maart mrt",
    "apr april avril avr abril abr aprile",
    "may mai mayo maggio mag maio mei",
    "jun june juni juin junio giugno giu junho",
    "jul july juli juillet juil julio luglio lug julho",
    "aug august août aout agosto ago augustus",
    "sep sept september septembre septiembre settembre set setembro",
    "oct october oktober okt octobre octubre ottobre ott outubro out",
    "nov november novembre noviembre novembro",
    "dec december dezember dez décembre decembre déc diciembre dic dicembre dezembro",
)
# Zone abbreviations, those of RFC 822 and the usual ones of other parts of the world, in hours from UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
    "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3, "ist": 5.5, "jst": 9, "kst": 9, "awst": 8, "acst": 9.5, "acdt": 10.5,
    "aest": 10, "aedt": 11, "nzst": 12, "nzdt": 13, "hst": -10, "akst": -9, "akdt": -8, "brt": -3, "art": -3, "cot": -5,
}

_MONTH = {name: i + 1 for i, names in enumerate(MONTHS) for name in names.split()}
_TIME = r"(?P<h>\d{1,2})[:.h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?\s?[Mm]\.?)?"
_ZONE = r"(?:\s*(?P<z>[Zz]|[A-Za-z]{2,4}|(?:UTC|GMT)?[+\-−]\d{2}:?(?:\d{2})?))?(?:\s*\[[^\]]*\])?"
_ISO = re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?")
_NUMERIC = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}})(?:(?:[Tt]|,?\s+){_TIME}{_ZONE})?")
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt ](?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?P<ap>)" + _ZONE)
_DAY_NAME = r"(?:[^\W\d_]{2,12}\.?,?\s+)?"
_DAY_MONTH = re.compile(rf"{_DAY_NAME}(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er|º|\.º)?\s+(?:de\s+|of\s+|di\s+)?(?P<mon>[^\W\d_]{{3,12}})\.?,?\s+(?:de\s+|del\s+)?(?P<y>\d{{4}})(?:,?\s+(?:at\s+|um\s+|à\s+|om\s+|às\s+|alle\s+|a\s+las\s+)?{_TIME}(?:\s+Uhr)?{_ZONE})?")
_MONTH_DAY = re.compile(rf"{_DAY_NAME}(?P<mon>[^\W\d_]{{3,12}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_ZONE})?")
_WEEK = re.compile(r"(?P<y>\d{4})-?[Ww](?P<w>\d{2})(?:-?(?P<wd>[1-7]))?")
_ORDINAL = re.compile(r"(?P<y>\d{4})-(?P<n>\d{3})")
_YEAR_MONTH = re.compile(r"(?P<y>\d{4})[-/](?P<m>\d{1,2})")
_NUMBER = re.compile(r"(?P<i>\d{1,17})(?:[.,](?P<f>\d+))?")

_EPOCH = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)


@lru_cache(maxsize=4096)
def _zone(name: str | None) -> ZoneInfo | None:
    """None stands for UTC, also for names no zone has."""
    try:
        return ZoneInfo(name) if name and name != "UTC" else None
    except Exception:
        return None


def _micros(local: datetime, offset: int | None, tz: str | None) -> int | None:
    """UTC microseconds of a wall-clock time; the earlier of two, and the offset before a gap, by fold 0."""
    naive = (local - _EPOCH) // _US
    if offset is not None:
        out = naive - offset * 1_000_000
    elif (zone := _zone(tz)) is None:
        out = naive
    else:
        out = naive - int(local.replace(tzinfo=zone, fold=0).utcoffset() / _US)
    return out if -62_135_596_800_000_000 <= out <= 253_402_300_799_999_999 else None


def _offset(z: str | None) -> int | None | bool:
    """Seconds from UTC; None where there is no zone, False where it isn't one."""
    if not z:
        return None
    low = z.lower().replace("−", "-")
    if low in ZONES:
        return int(ZONES[low] * 3600)
    low = low.removeprefix("utc").removeprefix("gmt")
    if low[:1] not in ("+", "-"):
        return False
    digits = low[1:].replace(":", "")
    h, m = int(digits[:2]), int(digits[2:] or 0)
    if h > 18 or m > 59:
        return False
    return (-1 if low[0] == "-" else 1) * (h * 3600 + m * 60)


def _clock(g: dict) -> tuple[int, int, int, int] | None:
    """Hour, minute, second and microsecond of a match; None if there is no such time."""
    if not g.get("h"):
        return 0, 0, 0, 0
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"] in "Pp" else 0)
    if h == 24 and mi == s == 0 and not (g["f"] or "").strip("0"):
        return 24, 0, 0, 0
    if h > 23 or mi > 59 or s > 59:
        return None
    return h, mi, s, int(((g["f"] or "") + "000000")[:6])


def _moment(y: int, m: int, d: int, g: dict, tz: str | None) -> int | None:
    offset, clock = _offset(g.get("z")), _clock(g)
    if offset is False or clock is None:
        return None
    h, mi, s, us = clock
    try:
        local = datetime(y, m, d, h % 24, mi, s, us)
        return _micros(local + timedelta(days=1) if h == 24 else local, offset, tz)
    except (ValueError, OverflowError):
        return None


def readings(value: str | None, tz: str | None) -> list[int | None]:
    """All readings of a value in UTC microseconds: one if all FORMATS agree, two (local, UTC) if only the clock
    matters, else one a format, None where that format has none; empty if no format reads the value."""
    local = day_month_readings(value, tz)
    if local == (None, None):
        return []
    utc = local if _zone(tz) is None else day_month_readings(value, None)
    if local[0] != local[1]:
        return [local[0], utc[0], local[1], utc[1]]
    return [local[0]] if utc == local else [local[0], utc[0]]


def day_month_readings(value: str | None, tz: str | None) -> tuple[int | None, int | None]:
    """Readings of a value: (day first, month first) in UTC microseconds; both the same where the order is clear.

    Null, blank, relative and impossible values have none. A value without zone is local time of ``tz`` (null: UTC).
    """
    if not value or not (v := value.strip()):
        return None, None
    if v[0].isdigit():
        if v.isdigit() and len(v) not in (4, 8) or (v.replace(".", "", 1).isdigit() and "." in v and len(v.split(".")[0]) > 8):
            m = _NUMBER.fullmatch(v)
            if not m:
                return None, None
            whole = m["i"]
            size = len(whole.lstrip("0"))
            frac = int(((m["f"] or "") + "000000")[:6])
            us = int(whole) * 1_000_000 + frac if size <= 11 else int(whole) * 1000 + frac // 1000 if size <= 14 else int(whole)
            us = us if us <= 253_402_300_799_999_999 else None
            return us, us
        if m := _ISO.fullmatch(v):
            us = _moment(int(m["y"]), int(m["m"]), int(m["d"]), m.groupdict(), tz)
            return us, us
        if m := _NUMERIC.fullmatch(v):
            g = m.groupdict()
            y = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
            a, b = int(g["a"]), int(g["b"])
            return _moment(y, b, a, g, tz), _moment(y, a, b, g, tz)
        us = None
        try:
            if len(v) in (4, 8) and v.isdigit():
                us = _moment(int(v[:4]), int(v[4:6] or 1), int(v[6:] or 1), {}, tz)
            elif m := _COMPACT.fullmatch(v):
                us = _moment(int(m["y"]), int(m["m"]), int(m["d"]), m.groupdict(), tz)
            elif m := _YEAR_MONTH.fullmatch(v):
                us = _moment(int(m["y"]), int(m["m"]), 1, {}, tz)
            elif m := _WEEK.fullmatch(v):
                day = date.fromisocalendar(int(m["y"]), int(m["w"]), int(m["wd"] or 1))
                us = _moment(day.year, day.month, day.day, {}, tz)
            elif m := _ORDINAL.fullmatch(v):
                day = date(int(m["y"]), 1, 1) + timedelta(days=int(m["n"]) - 1)
                us = _moment(day.year, day.month, day.day, {}, tz) if day.year == int(m["y"]) else None
            elif (m := _DAY_MONTH.fullmatch(v)) and (mon := _MONTH.get(m["mon"].lower())):
                us = _moment(int(m["y"]), mon, int(m["d"]), m.groupdict(), tz)
        except (ValueError, OverflowError):
            us = None
        return us, us
    for pattern in (_DAY_MONTH, _MONTH_DAY):
        if (m := pattern.fullmatch(v)) and (mon := _MONTH.get(m["mon"].lower())):
            us = _moment(int(m["y"]), mon, int(m["d"]), m.groupdict(), tz)
            return us, us
    return None, None


_READ = T.StructType([
    T.StructField("grp", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("known", T.IntegerType()),
    T.StructField("readings", T.ArrayType(T.LongType())), T.StructField("usual", T.IntegerType()),
])


def usual_order(value: str) -> int:
    """0 if the day usually comes first in numeric dates written so, 1 if the month, -1 if the writing doesn't tell."""
    m = _NUMERIC.fullmatch(value.strip())
    return -1 if m is None else 1 if m["ap"] else 0 if m["sep"] == "." else -1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = b.column(3).to_pylist()
        found = [readings(v, tz) for v, tz in zip(values, b.column(4).to_pylist())]
        usual = [usual_order(v) if len(r) == len(FORMATS) else -1 for v, r in zip(values, found)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.int64())), pa.array(usual, pa.int32())], names=_READ.fieldNames())


def interpret(rows: DataFrame, sites: DataFrame, group: str, id_col: str, value_col: str, url_col: str, source_col: str | None, local: bool = True) -> DataFrame:
    """All readings of one column: (grp, row_id, known, readings, usual), rows without a reading left out.

    ``group`` names the column's results; a source is a value of ``source_col`` (if any) and a site. ``known`` is 0
    for sites that write the day first, 1 for the month, -1 if the table of sites doesn't tell. With ``local`` a value
    without zone is read in the site's zone, else in UTC. Null ids, urls and sources stay (a null source is a source).
    """
    host = url_site(F.col(url_col))
    own = F.coalesce(host, F.lit(""))
    if source_col:
        own = F.concat(F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.lit("\t"), own)
    picked = rows.select(F.concat(F.lit(group + "\t"), own).alias("grp"), F.col(id_col).cast("long").alias("row_id"), F.col(value_col).cast("string").alias("value"), host.alias("host"))
    known = sites.select(F.lower(F.trim("site")).alias("_site"), F.col("tz").alias("_tz"), F.col("day_order").alias("_order")).dropna(subset=["_site"]).dropDuplicates(["_site"])
    if known.limit(MAX_SITES + 1).count() <= MAX_SITES:
        known = F.broadcast(known)
    joined = picked.where(F.trim("value") != "").join(known, F.col("host") == F.col("_site"), "left")
    order = F.when(F.col("_order") == "dmy", 0).when(F.col("_order") == "mdy", 1).otherwise(-1).cast("int").alias("known")
    read = joined.select("grp", "row_id", order, "value", (F.col("_tz") if local else F.lit(None).cast("string")).alias("tz")).mapInArrow(_read, _READ)
    return read.where(F.size("readings") > 0)


_N = len(FORMATS)
#: SWITCH for each of order and clock that differ, format by format.
_SWITCHES = SWITCH * np.array([[(i // 2 != j // 2) + (i % 2 != j % 2) for j in range(_N)] for i in range(_N)], float)


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Instants (rows x formats), whether they exist, and the cost of each format by itself."""
    column = t.column("readings").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    values, valid = flat.fill_null(0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    place = starts[:, None] + np.where(sizes == _N, np.arange(_N)[:, None], np.where(sizes == 2, (np.arange(_N) % 2)[:, None], 0)).T
    at, have = values[place], valid[place]
    cost = np.where(have, 0.0, UNREADABLE)
    known = t.column("known").to_numpy()
    ordered = (sizes == _N) & (known >= 0)
    cost[ordered[:, None] & (np.arange(_N) // 2 != known[:, None])] += PRIOR
    usual = t.column("usual").to_numpy()
    cost[(usual >= 0)[:, None] & (np.arange(_N) // 2 != usual[:, None])] += UNUSUAL
    clocked = at[:, ::2] != at[:, 1::2]
    cost[:, 1::2] += PRIOR * clocked
    return at, have, cost


def _steps(at: np.ndarray, have: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Cost of going from format i at one record to format j at the next, the next one's own cost included."""
    back = (at[1:, None, :] < at[:-1, :, None]) & have[1:, None, :] & have[:-1, :, None]
    return back * BACKWARD + _SWITCHES + cost[1:, None, :]


def _through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs over a then b (... x formats x formats)."""
    return (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2)


def _chain(steps: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Least cost from each format at a block's first record to each at its last: steps are joined two by two."""
    start = np.where(np.eye(_N, dtype=bool), own[:, None], 1e15)
    while len(steps) > 1:
        even = len(steps) // 2 * 2
        steps = np.concatenate([_through(steps[:even:2], steps[1:even:2]), steps[even:]])
    return _through(start, steps[0]) if len(steps) else start


_SUMMARY = "grp string, block long, first array<long>, first_have array<boolean>, last array<long>, last_have array<boolean>, costs array<double>"


def _summarise(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    t = table.sort_by("_before")
    at, have, cost = _arrays(t)
    m = _chain(_steps(at, have, cost), cost[0])
    row = [t.column("grp")[0].as_py(), t.column("block")[0].as_py(), at[0].tolist(), have[0].tolist(), at[-1].tolist(), have[-1].tolist(), m.reshape(-1).tolist()]
    return pa.table({n.split()[0]: [v] for n, v in zip(_SUMMARY.split(", "), row)})


_ENDS = "grp string, block long, entry array<double>, leave array<double>"


def _ends(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Costs that reach each block of one source from before and from after it."""
    rows = table.sort_by("block").to_pylist()
    costs = [np.array(r["costs"]).reshape(_N, _N) for r in rows]
    links = []
    for a, b in zip(rows, rows[1:]):
        pair = np.array([a["last"], b["first"]]), np.array([a["last_have"], b["first_have"]])
        links.append(_steps(*pair, np.zeros((2, _N)))[0])
    entry = [np.zeros(_N)]
    for m, link in zip(costs, links):
        end = (entry[-1][:, None] + m).min(axis=0)
        into = (end[:, None] + link).min(axis=0)
        entry.append(into - into.min())
    leave = [np.zeros(_N)]
    for m, link in zip(costs[:0:-1], links[::-1]):
        start = (m + leave[-1]).min(axis=1)
        out = (link + start).min(axis=1)
        leave.append(out - out.min())
    leave.reverse()
    return pa.table({"grp": [r["grp"] for r in rows], "block": pa.array([r["block"] for r in rows], pa.int64()), "entry": [x.tolist() for x in entry], "leave": [x.tolist() for x in leave]})


_PICKED = "grp string, row_id long, utc string"


def _path(at: np.ndarray, have: np.ndarray, cost: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """The cheapest format of each record; ties keep the format, then take the first."""
    n = len(at)
    # Records that all formats read alike take part only as neighbours in time: the path is sought over the others.
    clear = (at == at[:, :1]).all(axis=1) & have.all(axis=1) & (cost == cost[:, :1]).all(axis=1)
    before = np.zeros((n, _N))
    before[1:] = BACKWARD * ((at[1:] < at[:-1]) & have[1:] & have[:-1])  # exact where the record before is clear
    after = np.zeros((n, _N))
    after[:-1] = BACKWARD * ((at[1:] < at[:-1]) & have[1:] & have[:-1])  # exact where the next one is clear
    open_ = np.flatnonzero(~clear)
    path = np.zeros(n, np.int64)
    if not len(open_):
        path[:] = int(np.argmin(entry + leave))
        return path
    prev_clear = np.ones(n, bool)
    prev_clear[1:] = clear[:-1]
    next_clear = np.ones(n, bool)
    next_clear[:-1] = clear[1:]
    node = cost + np.where(prev_clear[:, None], before, 0.0) + np.where(next_clear[:, None], after, 0.0)
    costs = (entry if open_[0] == 0 else (entry[:, None] + _SWITCHES).min(axis=0)) + node[open_[0]]
    cur = costs.tolist()
    came: list[list[int]] = []
    a, b = open_[:-1], open_[1:]
    pairs = BACKWARD * ((at[b][:, None, :] < at[a][:, :, None]) & have[b][:, None, :] & have[a][:, :, None]) + _SWITCHES
    apart = np.diff(open_) > 1
    pairs[apart] = _SWITCHES
    pairs = pairs + node[b][:, None, :]
    for step in pairs.tolist():
        new, back = [], []
        for j in range(_N):
            best, by = cur[j] + step[j][j], j
            for i in range(_N):
                if (x := cur[i] + step[i][j]) < best:
                    best, by = x, i
            new.append(best)
            back.append(by)
        cur = new
        came.append(back)
    end = leave if open_[-1] == n - 1 else (_SWITCHES + leave).min(axis=1)
    state = int(np.argmin(np.array(cur) + end))
    for k in range(len(open_) - 1, -1, -1):
        path[open_[k]] = state
        if k:
            state = came[k - 1][state]
    return path


def _solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    t = table.sort_by("_before")
    at, have, cost = _arrays(t)
    ends = [np.array(t.column(c)[0].as_py() or [0.0] * _N) for c in ("entry", "leave")]
    path = _path(at, have, cost, *ends)
    r = np.arange(len(at))
    ok = have[r, path]
    text = np.char.add(np.datetime_as_string(at[r, path][ok].astype("datetime64[us]"), unit="us"), "Z")
    keep = pa.array(ok)
    return pa.table({"grp": t.column("grp").filter(keep), "row_id": t.column("row_id").filter(keep), "utc": pa.array(text.tolist(), pa.string())})


def choose(read: DataFrame, block: int = BLOCK) -> DataFrame:
    """One reading of each value: (grp, row_id, utc), ``utc`` as ``YYYY-MM-DDTHH:MM:SS.ffffffZ``.

    All that decides are the costs on top of this module: PRIOR outweighs what order and time can say about a value, so
    where the site's order is known it holds, and a value it makes impossible gives no row. Repeated rows are records of
    their own; an empty table gives an empty result.
    """
    placed = running_positions(materialize(read, "readings"), ["grp"], ["row_id"], "reading-positions")
    placed = materialize(placed.withColumn("block", F.floor(F.col("_before") / F.lit(block))), "reading-blocks")
    many = placed.where(F.col("_total") > block)
    narrow = ["grp", "block", "_before", "known", "readings", "usual"]
    summary = many.select(*narrow).groupBy("grp", "block").applyInArrow(_summarise, _SUMMARY)
    # One row a block of a long source.
    ends = materialize(summary.groupBy("grp").applyInArrow(_ends, _ENDS), "block-ends")
    ends = ends.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "entry", "leave")
    nothing = [F.lit(None).cast("array<double>").alias(c) for c in ("entry", "leave")]
    alone = placed.where(F.col("_total") <= block).select("row_id", *narrow, *nothing)
    cut = many.join(ends, (F.col("grp") == F.col("_g")) & (F.col("block") == F.col("_b"))).select("row_id", *narrow, "entry", "leave")
    return alone.unionByName(cut).groupBy("grp", "block").applyInArrow(_solve, _PICKED)
