"""Hot keys and timestamps against plain Python, and their edge cases."""

import datetime as dt
import math
import random
import re
from collections import defaultdict
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.timestamps import ZONE_MINUTES, normalise_timestamps, utc_micros
from shelfmark.operators import hotkeys
from shelfmark.operators.hotkeys import key_profiles
from shelfmark import runtime
from shelfmark.runtime import table

KEYS = {"k": "a", "m": "b"}


def profiles(df, share=0.0):
    return key_profiles(df, {n: F.col(c) for n, c in KEYS.items()}, F.col("v"), F.col("t"), share)


@pytest.mark.parametrize("shuffled", [False, True])
def test_quantiles_are_exact_with_a_hot_key(spark, monkeypatch, shuffled):
    moved = []
    if shuffled:  # the path of more keys than may be broadcast: the values of the hot key are never joined by shuffle
        monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(hotkeys, "HOT_ROWS", 500)
        write = hotkeys.write_scratch

        def watched(df, label, by=None):
            out, path = write(df, label, by)
            if label == "value-counts" and by is None:
                moved.extend(r.key_value for r in out.select("key_value").distinct().collect())
            return out, path

        monkeypatch.setattr(hotkeys, "write_scratch", watched)
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.choice(["x", None, "y"]), rng.choice([None, rng.randrange(-(10**6), 10**12)]), f"t{rng.randrange(99):02}") for i in range(3000)]
    got = {(r.field_name, r.key_value): r for r in profiles(spark.createDataFrame(rows, "a string, b string, v long, t string")).collect()}
    by = defaultdict(list)
    for a, b, v, t in rows:
        by["k", a].append((v, t))
        if b is not None:
            by["m", b].append((v, t))
    assert got.keys() == by.keys()
    for key, vs in by.items():
        r, values = got[key], sorted(v for v, _ in vs if v is not None)
        assert (r.row_count, r.value_count, r.total_value or 0) == (len(vs), len(values), sum(values))
        assert (r.first_stamp, r.last_stamp) == (min(t for _, t in vs), max(t for _, t in vs))
        if shuffled:
            assert "hot" not in moved and "k0" in moved
        if values:
            assert r.p50_value == values[math.ceil(0.5 * len(values)) - 1] and r.p90_value == values[math.ceil(0.9 * len(values)) - 1]


@pytest.mark.parametrize("total", [None, 1000, 3000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_equals_a_join(spark, monkeypatch, how, total):
    monkeypatch.setattr(runtime, "HOT_ROWS", 2000 if total == 1000 else 100)
    rows = spark.createDataFrame([(i % 9 if i % 3 else 100, i) for i in range(3000)] + [(None, -1)] * 5, "k long, x long")
    side = spark.createDataFrame([(k, k * 2) for k in (0, 1, 4, 7, 100, 500)], "k long, y long")
    plain, got = rows.join(side, "k", how), runtime.hot_join(rows, side, "k", how, runtime.hot_keys(rows, "k", total))
    assert got.columns == plain.columns and got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    if total != 1000:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and "broadcast" in plan


def test_scratch_of_a_scope_is_dropped(spark):
    with runtime.scratch_scope(spark):
        df, path = runtime.write_scratch(spark.range(3), "x")
        assert df.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_profile_edges(spark):
    schema = "a string, b string, v long, t string, n long, value long, field_name string"
    assert profiles(spark.createDataFrame([], schema)).count() == 0
    one = profiles(spark.createDataFrame([("x", None, None, None, 1, 1, "z")] * 2, schema)).collect()
    assert [(r.key_value, r.row_count, r.value_count, r.p50_value, r.first_stamp) for r in one] == [("x", 2, 0, None, None)]
    wide = profiles(spark.createDataFrame([("x", None, v, "t", 1, 1, "z") for v in (0, 2**62, 2**62 - 1)], schema)).first()
    assert (wide.p50_value, wide.p90_value) == (2**62 - 1, 2**62)
    share = profiles(spark.createDataFrame([("x", None, 1, "t", 1, 1, "z")] * 3 + [(None, None, 1, "t", 1, 1, "z")] * 297, schema), 0.01)
    assert [r.key_value for r in share.collect()] == ["x"]


CASES = [
    ("2018:01:05 08:10:10", "Europe/Berlin", (2018, 1, 5, 7, 10, 10, 0)),
    ("2018:07:05 08:10:10.256829", "Europe/Berlin", (2018, 7, 5, 6, 10, 10, 256829)),
    ("  2015:10:14 17:31:35\x00", "UTC", (2015, 10, 14, 17, 31, 35, 0)),
    ("2012:12:14 02:03:40+05:30", "Asia/Taipei", (2012, 12, 13, 20, 33, 40, 0)),
    ("2019-10-15T01:07:00.8793136-04:00", None, (2019, 10, 15, 5, 7, 0, 879313)),
    ("2015-04-27T14:50:54-07", None, (2015, 4, 27, 21, 50, 54, 0)),
    ("2021-05-16T05:05:48z", None, (2021, 5, 16, 5, 5, 48, 0)),
    ("20240930T221626Z", None, (2024, 9, 30, 22, 16, 26, 0)),
    ("2020-12-31 22:43", "Europe/London", (2020, 12, 31, 22, 43, 0, 0)),
    ("30.11.2016 20:04:42", "UTC", (2016, 11, 30, 20, 4, 42, 0)),
    ("12/09/2013 9:05:55 AM", "UTC", (2013, 12, 9, 9, 5, 55, 0)),
    ("12/18/2008 12:20:37 PM", "UTC", (2008, 12, 18, 12, 20, 37, 0)),
    ("04/09/2020 12:13:21 AM", "UTC", (2020, 4, 9, 0, 13, 21, 0)),
    ("4 Sep 2008 11:12:49", "UTC", (2008, 9, 4, 11, 12, 49, 0)),
    ("Fri Dec 14 07:05:33 2012", "UTC", (2012, 12, 14, 7, 5, 33, 0)),
    ("Tue Mar 15 12:01:56 CET 2016", None, (2016, 3, 15, 11, 1, 56, 0)),
    ("Sun Mar  3 15:42:15 2024", "UTC", (2024, 3, 3, 15, 42, 15, 0)),
    ("Sat, 15 Mar 2014 16:27:17 +0545", None, (2014, 3, 15, 10, 42, 17, 0)),
    ("Sun, 11 Jul 2010 03:59:08 GMT", None, (2010, 7, 11, 3, 59, 8, 0)),
    ("2024-07-08 09:40:16 BST", None, (2024, 7, 8, 8, 40, 16, 0)),
    ("2012-10-20 13:46:45 EDT", None, (2012, 10, 20, 17, 46, 45, 0)),
    ("1590190055", None, (2020, 5, 22, 23, 27, 35, 0)),
    ("1215638041.44", None, (2008, 7, 9, 21, 14, 1, 440000)),
    ("1495202913131", None, (2017, 5, 19, 14, 8, 33, 131000)),
    ("1476581319612432", None, (2016, 10, 16, 1, 28, 39, 612432)),
    ("2018:10:28 02:30:00", "Europe/Berlin", (2018, 10, 28, 0, 30, 0, 0)),  # twice: the earlier
    ("2018:03:25 02:30:00", "Europe/Berlin", (2018, 3, 25, 1, 30, 0, 0)),  # skipped: the offset before
]
NO_CASES = ["", " ", "-", "n/a", "unknown", "0000:00:00 00:00:00", "    :  :     :  :  ", "2009:03:13", "2022-12-01", "2015:02:30 10:00:00", "2015:13:01 10:00:00", "2015:01:01 24:00:00", "2015:01:01 10:60:00", "2015:01:01 10:00:60", "12/18/2008 13:20:37 PM", "2015-01-01 10:00:00 XYZ", "2015:01:01 10:00:00+99:00", "9" * 30, "x" * 100_000]


def test_formats(spark):
    rows = [(t, z, i) for i, (t, z, _) in enumerate(CASES)] + [(t, "UTC", -1) for t in NO_CASES] + [(None, "UTC", -1), ("2018:01:05 08:10:10", None, -1)]
    got = spark.createDataFrame(rows, "t string, z string, i int").select("i", "t", utc_micros(F.col("t"), F.col("z")).alias("u")).collect()
    for r in got:
        if r.i < 0:
            assert r.u is None, r.t
        else:
            assert r.u == int(dt.datetime(*CASES[r.i][2], tzinfo=dt.timezone.utc).timestamp()) * 10**6 + CASES[r.i][2][6], r.t


MONTH = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def plain(text, zone):
    """A separate reading of the formats in the test tables."""
    t = text.strip(" \t\r\n\0")
    if re.fullmatch(r"\d+(\.\d+)?", t):
        whole, _, part = t.partition(".")
        unit = 10**6 if len(whole) <= 11 else 10**3 if len(whole) <= 14 else 1
        return int(whole) * unit + int((part + "000000")[:6]) * unit // 10**6
    tz = None
    if m := re.search(r"(?<=\d)\s*([+-])(\d\d):?(\d\d)?$", t):
        if ":" in t[: m.start()]:
            tz, t = dt.timezone((1 if m[1] == "+" else -1) * dt.timedelta(hours=int(m[2]), minutes=int(m[3] or 0))), t[: m.start()]
    elif m := re.search(r"(?<=\d) ?([A-Za-z]{1,4})( \d{4})?$", t):
        if m[1].upper() not in ("AM", "PM"):
            tz, t = dt.timezone(dt.timedelta(minutes=ZONE_MINUTES[m[1].lower()])), t[: m.start()] + (m[2] or "")
    frac = 0
    if m := re.search(r"(:\d\d)\.(\d+)", t):
        frac, t = int((m[2] + "000000")[:6]), t[: m.start() + 3] + t[m.end() :]
    for f in ("%Y:%m:%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y%m%dT%H%M%S", "%d.%m.%Y %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%d %b %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%a %b %d %H:%M:%S %Y"):
        try:
            d = dt.datetime.strptime(t, f)
        except ValueError:
            continue
        local = d.replace(tzinfo=tz or ZoneInfo(zone), fold=0)
        return int((local - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds()) * 10**6 + frac if tz else int(local.timestamp()) * 10**6 + frac
    return None


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_tables_against_plain_reading(spark, sf):
    d = f"/root/testdata/{sf}"
    columns = ["datetime_original", "datetime_digitized", "mtime"]
    files, roots = table(spark, d, "files"), table(spark, d, "scan_roots")
    got = {(r.file_id, r.field_name): r.utc_us for r in normalise_timestamps(files, roots, columns).collect()}
    zones = sorted(((r.path_prefix, r.time_zone) for r in roots.collect()), key=lambda x: -len(x[0]))
    want = {}
    for r in files.select("file_id", "path", *columns).collect():
        zone = next(z for p, z in zones if r.path.startswith(p))
        for c in columns:
            if r[c] is not None and (u := plain(r[c], zone)) is not None:
                want[r.file_id, c] = u
    assert got == want


def test_timestamp_edges(spark):
    roots = spark.createDataFrame([("/a/", "UTC"), ("/a/b/", "Nowhere/Land"), (None, "UTC"), ("/c/", None)], "path_prefix string, time_zone string")
    schema = "file_id long, path string, x string, field_name string, utc_us long, _zone string"
    rows = [(1, "/a/1", "2020-01-01 00:00", "f", 5, "z"), (1, "/a/1", "2020-01-01 00:00", "f", 5, "z"), (2, "/a/b/2", "2020-01-01 00:00", None, None, None), (3, None, "2020-01-01T00:00:00Z", None, None, None), (4, "/c/1", "2020-01-01 00:00", None, None, None), (None, "/a/1", None, None, None, None)]
    got = sorted((r.file_id, r.utc_us) for r in normalise_timestamps(spark.createDataFrame(rows, schema), roots, ["x"]).collect())
    us = 1577836800 * 10**6
    assert got == [(1, us), (1, us), (2, us), (3, us)]
    assert normalise_timestamps(spark.createDataFrame([], schema), roots, ["x"]).count() == 0
