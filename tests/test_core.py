"""Core operators on small literals, brute-force comparisons and plan checks."""

import datetime
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark import runtime
from shelfmark.functions import dates, metadata, naming, paths
from shelfmark.functions.classify import classify
from shelfmark.functions.hashes import hex_to_long, long_to_hex, valid_hex
from shelfmark.operators import events, graph, ledger, overlap, pairs, survivor
from shelfmark.plans import incremental, organise
from shelfmark.sources import readers, sinks
from shelfmark.streaming import ingest


def values(spark, texts, fn, schema="x string"):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], f"{schema}, i int")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sanitised_labels(spark):
    cases = {
        "20200112三貂嶺 小蜂": "三貂嶺_小蜂", "20100815 倩家": "倩家", "2012 Trip": "Trip", "20200711(2d) 貢寮": "貢寮", "2023-06-15 Kyoto": "Kyoto",
        "20080614~23 NICE 出差": "NICE_出差", "2019-10-19&20 屈尺": "屈尺", "101_煙火": "101_煙火", "2010_2012 years": "years", "E:\\": "", "": "",
        "2023-06-15 20230615 x": "x", "20230615": "", "a__b  c": "a_b_c", "20101 odd": "20101_odd", "x" * 60: "x" * 40,
    }
    assert values(spark, [*cases, None], naming.sanitize_event) == [*cases.values(), ""]


def test_range_tails_need_the_last_day(spark):
    rows = [("20020413_19 walk", "2002-04-19"), ("20020413_19 walk", "2002-04-20"), ("20020628-3 walk", "2002-07-03"), ("20021230_2 walk", "2003-01-02"), ("20020413_19 walk", None)]
    df = spark.createDataFrame(rows, "n string, d string")
    assert [r.y for r in df.select(naming.sanitize_event(F.col("n"), F.to_date("d")).alias("y")).collect()] == ["walk", "19_walk", "walk", "walk", "19_walk"]


def test_folder_kinds(spark):
    assert all(values(spark, ["", None, "2023", "2023-06", "20230615", "12345", "100CANON", "100EOS5D.done", "DCIM", "IMG_1234", "P1010001", "E:\\"], naming.is_unorganised))
    assert not any(values(spark, ["Kyoto", "Japan_Trip", "Wedding 2023", "Grandma 90th", "三貂嶺"], naming.is_unorganised))
    assert all(values(spark, ["Raw_Files", "照片", "手機 Sony DCIM", "Temp2011", "200609", "V50 小鐵", "Sony_TX5", "Exports", "my iPhone"], naming.is_container))
    assert not any(values(spark, ["Old_Believers_Trip", "backup_plan_for_japan", "墾丁凱撒"], naming.is_container))
    assert values(spark, ["IMG_9606.jpg", "DSC03639.JPG", "image00017.jpg", None], naming.is_camera_name) == [True, True, False, False]


def test_filename_dates(spark):
    cases = {
        "PXL_20211103_080910123.jpg": "2021-11-03 08:09:10", "IMG_20230615_143022.jpg": "2023-06-15 14:30:22", "Screenshot_2023-06-15-14-30-22.png": "2023-06-15 14:30:22",
        "IMG-20230615-WA0001.jpg": "2023-06-15 00:00:00", "Signal-2023-06-15-143022.jpg": "2023-06-15 14:30:22", "Signal-2023-06-15.jpg": "2023-06-15 00:00:00",
        "VID_20230615.mp4": "2023-06-15 00:00:00", "20230615_123456.jpg": "2023-06-15 00:00:00", "20230615-001.jpg": "2023-06-15 00:00:00",
        "IMG_20231315_143022.jpg": None, "DSC_0001.jpg": None, "x20230615_123.jpg": None, "IMG_202306151.jpg": None, "": None,
    }
    got = values(spark, list(cases), lambda c: dates.filename_datetime(c).cast("string"))
    assert got == list(cases.values())


def test_date_ladder(spark):
    schema = "datetime_original string, filename string, datetime_digitized string, mtime string, camera_model string, file_type string"
    rows = [
        ("2020:01:01 10:00:00", "a.jpg", None, None, "X", "CAMERA_JPEG"), ("2020:01:01 10:00:00", "IMG_20200102_000000.jpg", None, None, None, "CAMERA_JPEG"),
        ("2020:01:01 10:00:00", "IMG_20200110_000000.jpg", None, None, None, "CAMERA_JPEG"), ("2020:01:01 10:00:00", "IMG_20200103_000000.jpg", None, None, None, "CAMERA_JPEG"),
        (None, "VID_20200110_000000.mp4", None, None, None, "VIDEO"), ("1980:01:01 00:00:00", "IMG_20200110_000000.jpg", None, None, "X", "HEIC"),
        (None, "a.jpg", "2019-05-05T01:02:03", None, None, "HEIC"), ("2030:01:01 00:00:00", "a.jpg", None, "2018-01-01T23:30:00+00:00", "X", "RAW"), (None, "a.jpg", None, "junk", "X", "RAW"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [(str(r.dt)[:10], r.date_source, r.date_confidence) for r in organise.date_ladder(df, F.to_date(F.lit("2024-01-01")), "Asia/Taipei").collect()]
    assert got == [
        ("2020-01-01", "exif_original", "HIGH"), ("2020-01-01", "exif_original", "HIGH"), ("2020-01-10", "filename", "LOW"), ("2020-01-01", "exif_original", "MEDIUM"),
        ("2020-01-10", "filename", "MEDIUM"), ("2020-01-10", "filename", "LOW"), ("2019-05-05", "exif_digitized", "MEDIUM"), ("2018-01-02", "mtime", "LOW"), ("None", "none", None),
    ]


def test_modified_times_do_not_follow_the_session(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = values(spark, ["2018-01-01T23:30:00+00:00", "2018-11-04T05:30:00Z", "2018-01-01T10:00:00.250", "2018-01-01", "junk"], lambda c: dates.modified_datetime(c, "Asia/Taipei").cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2018-01-02 07:30:00", "2018-11-04 13:30:00", "2018-01-01 10:00:00.25", "2018-01-01 00:00:00", None]


def test_classes(spark):
    rows = [("/a/x.CR2", None, None), ("/a/x.mp4", None, None), ("/a/x.HEIC", None, None), ("/a/x.png", None, None), ("/a/Thumbs/x.jpg", None, None), ("/a/thumbs.jpg", "Adobe Lightroom 5", None), ("/a/x.jpg", None, 4000), ("/a/web/x.jpg", None, 4000), ("/a/x_sm.jpg", None, 4000), ("/a/x.jpg", None, 800), ("/a/x.jpg", "WhatsApp", 800), (None, None, None)]
    df = spark.createDataFrame(rows, "p string, s string, w int")
    first = [r.c for r in df.select(classify(F.col("p"), F.col("s")).alias("c")).collect()]
    second = [r.c for r in df.select(classify(F.col("p"), F.col("s"), F.col("w"), True).alias("c")).collect()]
    assert first == ["RAW", "VIDEO", "HEIC", "UNKNOWN", "RESIZED_JPEG", "DEV_JPEG", "CAMERA_JPEG", "CAMERA_JPEG", "CAMERA_JPEG", "CAMERA_JPEG", "CAMERA_JPEG", "UNKNOWN"]
    assert second[6:11] == ["CAMERA_JPEG", "RESIZED_JPEG", "RESIZED_JPEG", "UNKNOWN", "RESIZED_JPEG"]


def test_metadata_fields(spark):
    df = spark.createDataFrame([({"Rating": "4.9", "Subject": '[" a ", "", "b"]', "FocalLength": "50 mm", "GPSLatitude": "1.5", "GPSLongitude": "2", "GPSAltitude": "0", "ImageWidth": "0", "ExifImageWidth": "640"},), ({"Rating": "x", "Keywords": " one ", "GPSLatitude": "1.5", "ImageWidth": "junk"},), ({},)], "t map<string,string>")
    t = F.col("t")
    got = [tuple(r) for r in df.select(metadata.rating(t), metadata.keywords(t), metadata.focal_length(t), metadata.gps(t)["lat"], metadata.gps(t)["alt"], metadata.dimensions(t)["width"]).collect()]
    assert got == [(4, '["a","b"]', 50.0, 1.5, None, 640), (None, '["one"]', None, None, None, 0), (None, None, None, None, None, 0)]
    assert values(spark, [3723.0, 63.0, 3.2, None], metadata.duration_text, "x double") == ["1h 02m 03s", "1m 03s", "3s", None]


def test_paths(spark):
    assert values(spark, ["D:\\a\\b\\c.jpg", "/a/b.jpg", "x.jpg"], paths.ancestors) == [["D:\\a", "D:\\a\\b"], ["/a"], []]
    assert values(spark, ["D:\\a\\b.jpg", "/a/b", "x"], paths.parent) == ["D:\\a", "/a", None]
    assert values(spark, ["IMG.a.jpg", ".hidden", "plain"], paths.stem) == ["IMG.a", ".hidden", "plain"]
    assert values(spark, ["/a_b/x", "/aXb/x", "/a_b"], lambda c: paths.within(c, F.lit("/a_b"))) == [True, False, False]
    assert values(spark, ["D:\\e\\share\\x.jpg", "D:\\e\\x.jpg"], naming.derivative_root) == ["d:\\e", None]


def test_hash_round_trip(spark):
    texts = [" FFFFFFFFFFFFFFFF ", "8000000000000000", "0000000000000001", "none", "", None, "12345"]
    valid = values(spark, texts, lambda c: valid_hex(c, 16))
    assert valid == ["f" * 16, "8" + "0" * 15, "0" * 15 + "1", None, None, None, None]
    assert values(spark, valid[:3], lambda c: long_to_hex(hex_to_long(c))) == valid[:3]


@pytest.mark.parametrize("hot", [4096, 2])
@pytest.mark.parametrize("radius", [0, 1, 2, 4, 6, 8])
def test_hamming_pairs_match_brute_force(spark, monkeypatch, radius, hot):
    monkeypatch.setattr(pairs, "HOT_CODE", hot)
    rng = random.Random(radius)
    keys = [0, 1, 3, 0xF, 0xFF, 1 << 63, 2**64 - 1, 2**64 - 2] + [(i * 0x9E3779B97F4A7C15) % 2**64 for i in range(60)]
    keys += [k ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 10))) for k in keys for _ in range(2)]
    signed = sorted({k - 2**64 if k >> 63 else k for k in keys})
    df = spark.createDataFrame([(k,) for k in signed + [None]], "k long")
    near = {(a, b, ((a ^ b) & 2**64 - 1).bit_count()) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & 2**64 - 1).bit_count() <= radius}
    assert {tuple(r) for r in pairs.hamming_pairs(df, None, "k", radius).collect()} == near
    left = spark.createDataFrame([(k,) for k in signed[::3]], "k long")
    both = {(a, b) for a in signed[::3] for b in signed if ((a ^ b) & 2**64 - 1).bit_count() <= radius}
    got = [(r.key_a, r.key_b) for r in pairs.hamming_pairs(left, df, "k", radius).collect()]
    assert set(got) == both and len(got) == len(both)


def components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 80)] + [(500, x) for x in range(501, 560)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges + [(7, 7), (None, 3), (9999, 9999), (2, 1)], "a long, b long")
    assert {r.node: r.component for r in graph.connected_components(df, "a", "b").collect()} == components(edges)
    assert graph.connected_components(df.where("false"), "a", "b").count() == 0


FILES = "file_id long, path string, filename string, extension string, file_type string, status string, width int, height int, size_bytes long, sha256 string, phash string, datetime_original string, datetime_digitized string, mtime string, camera_model string, date_source string, date_confidence string"


def file_row(i, path, **k):
    name = path.replace("\\", "/").split("/")[-1]
    d = {"file_id": i, "path": path, "filename": name, "extension": name.split(".")[-1].lower(), "file_type": "CAMERA_JPEG", "status": "scanned", "width": 4000, "height": 3000, "size_bytes": 5_000_000, "sha256": None, "phash": None, "datetime_original": None, "datetime_digitized": None, "mtime": None, "camera_model": None, "date_source": None, "date_confidence": None}
    return tuple((d | k).values())


CAMERAS = "camera_id long, make string, model string, owner string"
DUPES = "dup_id long, file_id_a long, file_id_b long, dup_type string, hamming_distance int, keep_file_id long, status string, resolved_at string"
OVERRIDES = "source_folder string, event_name string, date_override string, per_day_split int, confirmed_subject int"


def test_redundant_copies(spark):
    t = "2020:01:01 10:00:00"
    rows = [
        file_row(1, "/a/IMG_1.jpg", width=6000, height=4000, datetime_original=t), file_row(2, "/b/IMG_1.jpg", width=1920, height=1280, datetime_original=t),
        file_row(3, "/c/IMG_1.jpg", width=1000, height=1000, datetime_original=t),  # a crop stays
        file_row(4, "/a/IMG_7001.jpg", datetime_original=t, phash="00000000000000aa"), file_row(5, "/a/image00017.jpg", width=100, height=75, datetime_original=t, phash="00000000000000aa"),
        file_row(6, "/a/IMG_8001.jpg", datetime_original=t, phash="00000000000000aa"),  # a burst stays
        file_row(7, "/e/trip/share/DSC_5.jpg"), file_row(8, "/e/trip/Jpeg/DSC_5.jpg", file_type="RAW"),
    ]
    files = spark.createDataFrame(rows, FILES)
    got = survivor.redundant_copies(files, survivor.with_rank(files, spark.createDataFrame([], CAMERAS)))
    assert {r.file_id: r.keeper for r in got.collect()} == {2: 1, 5: 4, 7: 8}


def test_near_clusters(spark):
    files = spark.createDataFrame([file_row(i, f"/a/{i}.jpg", phash=f"{min(i, 20):016x}", sha256="s" if i in (2, 3) else None) for i in range(1, 30)], FILES)
    ranked = survivor.with_rank(files, spark.createDataFrame([], CAMERAS))
    links = [(1, 1, 2, 1), (2, 2, 4, None), (3, 4, 5, 3), (4, 1, 3, 1), (5, 21, 22, 0), (6, 7, 7, 0)]
    dupes = spark.createDataFrame([(d, a, b, "NEAR", h, None, "pending", None) for d, a, b, h in links], DUPES)
    got = {r.file_id: (r.cluster_id, r.min_hamming) for r in survivor.near_clusters(files, dupes, ranked).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 4: (1, 0)}  # 3 loses to 2 by hash, 21 and 22 are junk


def test_twin_folders_and_merge(spark):
    rows = [file_row(i, f"D:\\Lib\\Trip\\sub\\IMG_{i}.jpg", sha256=f"s{i}") for i in range(6)] + [file_row(10 + i, f"D:\\Lib\\Backup_Trip\\sub\\IMG_{i}.jpg", sha256=f"s{i}") for i in range(6)] + [file_row(30, "D:\\Lib\\Backup_Trip\\x.jpg")]
    files = spark.createDataFrame(rows, FILES)
    got = overlap.folder_overlaps(files, spark.createDataFrame([("D:\\Lib\\",)], "path_prefix string")).collect()
    found = {(r.folder_a, r.folder_b): (r.shared_count, r.coverage_a, r.coverage_b, r.keeper) for r in got}
    assert found["D:\\Lib\\Backup_Trip", "D:\\Lib\\Trip"] == (6, 1.0, 1.0, "b") and ("D:\\Lib\\Backup_Trip\\sub", "D:\\Lib\\Trip\\sub") not in found
    reviewed = spark.createDataFrame([("D:\\Lib\\Backup_Trip", "D:\\Lib\\Trip", "b", "reviewed")], "folder_a string, folder_b string, keeper string, status string")
    losers, unique = overlap.merge_losers(files, reviewed)
    assert {r.file_id: r.keeper for r in losers.collect()} == {10 + i: i for i in range(6)} and unique.first().unique_count == 1


def test_no_nested_loops_in_folder_joins(spark):
    files = spark.createDataFrame([file_row(1, "/a/b/c.jpg", sha256="x")], FILES)
    plan = overlap.twin_folders(overlap.subtree_members(files))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_resolved_events(spark):
    roots = spark.createDataFrame([("D:\\Raw\\",), ("D:\\Storage\\",)], "path_prefix string")
    rows = [("D:\\Raw\\20050814 蒙古\\0808\\a.jpg",), ("D:\\Raw\\100CANON\\a.jpg",), ("D:\\Storage\\Albums\\x.jpg",), ("/srv/Kyoto/151CANON/a.jpg",), ("D:\\Library\\Masters\\2020\\a.jpg",)]
    got = {r.folder: r.event_folder for r in events.resolve_folders(spark.createDataFrame(rows, "path string"), roots, "D:\\Library").collect()}
    assert got == {"D:\\Raw\\20050814 蒙古\\0808": "D:\\Raw\\20050814 蒙古", "D:\\Raw\\100CANON": "D:\\Raw", "D:\\Storage\\Albums": "D:\\Storage", "/srv/Kyoto/151CANON": "/srv/Kyoto", "D:\\Library\\Masters\\2020": None}


def test_plan_invariants(spark):
    rows = [
        file_row(1, "D:\\Raw\\Kyoto\\IMG_1.jpg", sha256="a", datetime_original="2020:05:01 10:00:00", camera_model="X2"), file_row(2, "D:\\Raw\\Backup\\Kyoto\\deeper\\IMG_1.jpg", sha256="a", datetime_original="2020:05:01 10:00:00", width=100, height=75),
        file_row(3, "D:\\Raw\\Kyoto\\IMG_2.jpg", sha256="b", datetime_original="2020:05:03 10:00:00", camera_model="X2"), file_row(4, "D:\\Raw\\Kyoto\\v.mp4", file_type="VIDEO", mtime="2020-05-02T00:00:00+00:00"),
        file_row(5, "D:\\Raw\\thumbs\\t.jpg", file_type="RESIZED_JPEG", sha256="c"), file_row(6, "D:\\Raw\\u.bin", file_type="UNKNOWN"), file_row(7, "D:\\Raw\\e.jpg", status="error"),
        file_row(8, "D:\\Raw\\上海\\q.jpg", mtime="2023-01-01T00:00:00+00:00"), file_row(9, "D:\\Raw\\Kyoto\\n.jpg", sha256="n1"), file_row(10, "D:\\Raw\\Kyoto\\m.jpg", sha256="n1"),
    ]
    files = spark.createDataFrame(rows, FILES)
    dupes = spark.createDataFrame([(1, 1, 2, "EXACT", 0, None, "pending", None), (2, 9, 10, "EXACT", 0, None, "pending", None), (3, 10, 9, "NEAR", 1, 10, "reviewed", None)], DUPES)
    over = spark.createDataFrame([("D:\\Raw\\上海", None, "2015-04-02", 0, 0)], OVERRIDES)
    plan = organise.plan(files, dupes, over, spark.createDataFrame([(1, None, "X2", "self")], CAMERAS), spark.createDataFrame([("D:\\Raw\\",)], "path_prefix string"), F.to_date(F.lit("2024-01-01")))
    got = {r.file_id: r for r in plan.collect()}
    assert got.keys() == {1, 2, 3, 4, 5, 8, 9, 10} and plan.count() == len(got)
    assert got[1].target_path == "Library/Masters/2020/2020-05-01(3d) Kyoto/IMG_1.jpg" and got[3].target_path.startswith("Library/Masters/2020/2020-05-01(3d) Kyoto/")
    assert got[4].target_path == "Library/Masters/2020/2020-05-01(3d) Kyoto/Videos/2020-05-01_0000.MP4"
    assert (got[2].op_type, got[2].stage_reason, got[2].dupe_of_file_id) == ("STAGE_DELETE", "redundant_copy", 1)
    assert got[5].stage_reason == "resized_jpeg" and "2015" in got[8].target_path and "上海" in got[8].target_path
    assert {got[9].op_type, got[10].op_type} == {"MOVE", "STAGE_DELETE"}  # the safety net keeps one
    empty = organise.plan(files.where("false"), dupes.where("false"), over.where("false"), spark.createDataFrame([], CAMERAS), None, F.to_date(F.lit("2024-01-01")))
    assert empty.count() == 0


def test_additions_keep_the_library(spark):
    lib = "Library/Masters/2023/2023-06-15(3d) Kyoto"
    rows = [file_row(1, f"{lib}/a.jpg", status="done", sha256="a"), file_row(2, f"{lib}/b.jpg", status="done", sha256="b"), file_row(3, "new/x.jpg", sha256="a"), file_row(4, "src/Kyoto/y.jpg", sha256="y"), file_row(5, "other/Walk/z.jpg", sha256="z", datetime_original="2023:06:16 10:00:00", camera_model="TestCam"), file_row(6, "other/Walk/w.jpg", sha256="w", datetime_original="2024:01:01 10:00:00")]
    files = spark.createDataFrame(rows, FILES)
    ops = spark.createDataFrame([(i, i, "MOVE", f"src/Kyoto/{i}.jpg", f"{lib}/{i}.jpg", "done") for i in (1, 2)], "op_id long, file_id long, op_type string, source_path string, target_path string, status string")
    args = (files, ops, spark.createDataFrame([], OVERRIDES), spark.createDataFrame([(1, None, "TestCam", "self")], CAMERAS), None, F.to_date(F.lit("2025-01-01")))
    got = {r.file_id: (r.op_type, r.target_path, r.dupe_of_file_id) for r in incremental.plan_additions(*args).collect()}
    assert got[3] == ("STAGE_DELETE", "Library/_staging/to_delete/exact_dupe/3_x.jpg", 1)
    assert got[4][1] == f"{lib}/y.jpg" and got[5][1] == f"{lib}/z.jpg" and got[6][1] == "Library/Others/Walk/2024/w.jpg"
    assert got.keys() == {3, 4, 5, 6}


def test_ledger(spark):
    files = spark.createDataFrame([(1, "/l/a.jpg", "CAMERA_JPEG", "done"), (2, "/l/b_conflict_1.jpg", "CAMERA_JPEG", "done"), (3, "/c", "UNKNOWN", "scanned"), (4, "/d", "RAW", "error"), (5, "/e", "RAW", "scanned"), (6, "/f", "RAW", "scanned")], "file_id long, path string, file_type string, status string")
    ops = spark.createDataFrame([(1, "MOVE", "done"), (2, "MOVE", "done"), (5, "MOVE", "in_progress")], "file_id long, op_type string, status string")
    states = {r.file_id: r.state for r in ledger.reconcile_states(files, ops).collect()}
    assert states == {1: "MOVED", 2: "CONFLICT", 3: "UNTOUCHED", 4: "ERROR", 5: "SKIPPED", 6: "UNACCOUNTED"}
    assert {r.file_id: r.state for r in ledger.reconcile_states(files, ops, strict=True).collect()}[5] == "UNACCOUNTED"
    sheet = {r.state: r.files for r in ledger.balance_sheet(ledger.reconcile_states(files, ops)).collect()}
    assert sum(sheet.values()) == 6 and sheet["STAGED"] == 0
    moved = ledger.move_folder(spark.createDataFrame([(1, "D:\\a_b\\x", "done"), (2, "D:\\aXb\\x", "done"), (3, "D:\\a_b\\y", "scanned")], "file_id long, path string, status string"), "D:\\a_b", "E:\\n")
    assert [(r.file_id, r.new_path) for r in moved.collect()] == [(1, "E:\\n\\x")]
    s = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.0), ("c", 1, 0.0)], "rel string, size long, mtime double")
    d = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.1), ("z", 1, 0.0)], "rel string, size long, mtime double")
    assert {r.rel: r.action for r in ledger.clone_actions(s, d).collect()} == {"a": "keep", "b": "copy", "c": "copy", "z": "prune"}
    f = spark.createDataFrame([(1, "a.jpg", "s"), (2, "b.jpg", "s"), (3, "c.jpg", None)], "file_id long, filename string, sha256 string")
    u = spark.createDataFrame([("/n/b.jpg", "b.jpg", "s"), ("/n/q.jpg", "q.jpg", "s")], "path string, filename string, sha256 string")
    found, lost = ledger.relocate(f, u)
    assert {r.file_id: r.path for r in found.collect()} == {2: "/n/b.jpg", 1: "/n/q.jpg"} and [r.file_id for r in lost.collect()] == [3]
    states_ = spark.createDataFrame([("in_progress", False, True), ("confirmed", False, False), ("confirmed", True, False)], "s string, a boolean, b boolean")
    assert [r.n for r in states_.select(ledger.next_status(F.col("s"), F.col("a"), F.col("b")).alias("n")).collect()] == ["done", "skipped", "confirmed"]


def test_conflict_numbers(spark):
    rows = spark.createDataFrame([(1, "L/a.jpg"), (2, "L/a.jpg"), (3, "L/b"), (4, "L/b")], "file_id long, target_path string")
    got = {r.file_id: r.target_path for r in organise.number_conflicts(rows, spark.createDataFrame([("L/b",)], "target_path string")).collect()}
    assert got == {1: "L/a.jpg", 2: "L/a_conflict_1.jpg", 3: "L/b_conflict_1", 4: "L/b_conflict_2"}


def test_conflict_numbers_are_the_smallest_free_ones(spark):
    rng = random.Random(4)
    names = ["L/a.jpg", "L/b", "L/a_conflict_2.jpg", "L/x.y/c"]
    wanted = [(i, rng.choice(names)) for i in range(40)]
    taken = {"L/a.jpg", "L/a_conflict_1.jpg", "L/a_conflict_4.jpg", "L/a_conflict_05.jpg", "L/b_conflict_3", "L/x.y/c_conflict_1", "L/b_conflict_1.jpg"}
    asked, want, used = {t for _, t in wanted}, {}, set(taken)
    for t in sorted(asked):
        files = sorted(i for i, x in wanted if x == t)
        if t not in taken:
            want[files.pop(0)] = t
        head, dot, tail = t.rpartition(".") if "." in t.rsplit("/", 1)[1] else (t, "", "")
        for i in files:
            n = 1
            while (place := f"{head}_conflict_{n}{dot}{tail}") in used | asked:
                n += 1
            used.add(place)
            want[i] = place
    df = spark.createDataFrame(wanted, "file_id long, target_path string")
    got = {r.file_id: r.target_path for r in organise.number_conflicts(df, spark.createDataFrame([(t,) for t in taken], "target_path string")).collect()}
    assert got == want and len(set(got.values())) == 40
    assert organise.number_conflicts(df.limit(0), df.limit(0)).count() == 0


def test_long_ranges_match(spark):
    day = datetime.date
    ev = spark.createDataFrame([("long", "b", day(2018, 1, 1), day(2020, 6, 18), []), ("short", "b", day(2019, 5, 1), day(2019, 5, 3), []), ("turned", "b", day(2019, 5, 3), day(2019, 5, 1), [])], "dir string, base string, date_lo date, date_hi date, lineage array<string>")
    rows = spark.createDataFrame([(1, "", "b", day(2020, 6, 18)), (2, "", "b", day(2019, 5, 2)), (3, "", "b", day(2020, 6, 19)), (4, "", "c", day(2019, 5, 2)), (5, "", "b", None)], "file_id long, source string, base string, day date")
    assert {r.file_id: r.dir for r in events.match_events(rows, ev).collect()} == {1: "long", 2: "long"}


def test_number_rows(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(10**6), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v long, _i long")
    want, seen = {}, {}
    for g, v, i in sorted((r for r in rows if r[0]), key=lambda r: (r[1], r[2])):
        seen[g] = want[i] = seen.get(g, 0) + 1
    got = runtime.number_rows(df, "n", "v", "_i", group="g")
    assert got.columns == ["g", "v", "_i", "n"] and {r["_i"]: r.n for r in got.collect()} == want
    assert [r["_i"] for r in runtime.number_rows(df, "n", -F.col("v"), F.col("_i")).orderBy("n").collect()] == [i for _, _, i in sorted(rows, key=lambda r: (-r[1], r[2]))]
    assert runtime.number_rows(df.limit(0), "n", "v", group="g").count() == 0


def test_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    edges = [(1, i) for i in range(2, 200)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 200)} | {i: 300 for i in range(300, 341)}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "file_id long, path string, status string")
    new = spark.createDataFrame([(3, "a", "n"), (4, "c", "n"), (5, "c", "m"), (6, None, "k"), (7, None, "k")], "file_id long, path string, status string")
    assert sorted(r.file_id for r in sinks.insert_new(old, new, "path").collect()) == [4, 6, 7]
    assert {r.file_id: r.status for r in sinks.patch(old, spark.createDataFrame([(2, None)], "file_id long, status string"), "file_id").collect()} == {1: "x", 2: None}
    assert {r.file_id: r.status for r in sinks.patch(old, spark.createDataFrame([(2, "done")], "file_id long, status string"), "file_id").collect()} == {1: "x", 2: "done"}
    with pytest.raises(ValueError):
        sinks.patch(old, spark.createDataFrame([(2, 1)], "file_id long, secret int"), "file_id")
    with pytest.raises(KeyError):
        sinks.delete_keys(old, spark.createDataFrame([(9,)], "file_id long"), "file_id")
    out = str(tmp_path / "log")
    sinks.append(old.withColumn("phase", F.lit("scan")), out, ["phase"])
    for _ in range(2):
        sinks.replace_partition(old.withColumn("phase", F.lit("audit")), out, "phase", "audit")
    assert spark.read.parquet(out).groupBy("phase").count().collect().__len__() == 2 and spark.read.parquet(out).count() == 4


def test_listing_and_rows(spark, tmp_path):
    for p in ("a/IMG_1.jpg", "a/.hidden/x.jpg", "_staging/y.jpg", "b/notes.txt", "b/100% +c.CR2"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    listing = readers.list_files(spark, str(tmp_path))
    got = sorted(r.path for r in listing.collect())
    assert got == sorted(str(tmp_path / p) for p in ("a/IMG_1.jpg", "b/100% +c.CR2"))
    tags = readers.extract_batches(listing, lambda ps: {p: {"Model": "X", "ImageWidth": 10} for p in ps}, 1)
    rows = {r.filename: r for r in readers.file_rows(listing, tags).collect()}
    assert rows["IMG_1.jpg"].file_type == "CAMERA_JPEG" and rows["IMG_1.jpg"].width == 10 and rows["100% +c.CR2"].file_type == "RAW"
    assert {r.sha256 for r in readers.hash_contents(listing.unionByName(spark.createDataFrame([("/none", 1, None)], listing.schema))).collect()} == {None} | {hashlib.sha256(p.encode()).hexdigest() for p in ("a/IMG_1.jpg", "b/100% +c.CR2")}
    failed = readers.extract_batches(listing, readers.command_tool(["sh", "-c", "sleep 5"], 0.1)).collect()
    assert all(r.tags == {} and "Timeout" in r.error for r in failed) and len(failed) == 2
    assert "RuntimeError" in readers.extract_batches(listing, readers.command_tool(["false"])).first().error
    seen = spark.createDataFrame([(got[0], "scanned")], "path string, status string")
    assert readers.unseen(listing, seen).count() == 1


def test_configuration():
    c = readers.Config.load('{"db": "x", "input_dirs": ["/", "/a/b", "/a", "/a/b"], "target_dir": "/a/b/out", "other": 1}')
    kinds = [m for _, m in c.problems()]
    assert any("root of a drive" in m for m in kinds) and any("twice" in m for m in kinds) and any("overlaps" in m for m in kinds) and any("inside" in m for m in kinds)
    with pytest.raises(ValueError):
        readers.Config.load('{"db": "x"}')
    assert readers.library_path(None, c, None) == "x" and readers.library_path("f", c, None) == "f"


def test_stream_equals_batch(spark, tmp_path):
    schema = "file_id long, status string"
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for i in range(3):
        spark.createDataFrame([(i * 10 + k, "new") for k in range(4)], schema).coalesce(1).write.mode("append").parquet(src)
        stream = ingest.new_rows(spark, src, spark.createDataFrame([], schema).schema, 1)
        ingest.run_batches(stream, lambda df: df.withColumn("seen", F.lit(True)), out, check).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 12 and got.select("file_id").distinct().count() == 12


def test_windowed_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type").write.parquet(src)
    stream = ingest.new_rows(spark, src, spark.read.parquet(src).schema)
    q = ingest.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) as n from win").first().n == 1000


def test_rank_zip_and_match_prefer_order(spark):
    ev = spark.createDataFrame([("d1", "Masters", "2023-06-15", "2023-06-17", ["s"]), ("d2", "Masters", "2023-06-16", "2023-06-20", ["s", "t"]), ("d3", "Others", None, None, ["u"])], "dir string, base string, lo string, hi string, lineage array<string>").selectExpr("dir", "base", "date(lo) date_lo", "date(hi) date_hi", "lineage")
    rows = spark.createDataFrame([(1, "s", "Masters", "2023-06-16"), (2, "s", "Masters", "2024-01-01"), (3, "t", "Others", None), (4, "zz", "Masters", "2023-06-20"), (5, "zz", "Others", "2023-06-16"), (6, "u", "Masters", None)], "file_id long, source string, base string, d string").selectExpr("file_id", "source", "base", "date(d) day")
    assert {r.file_id: r.dir for r in events.match_events(rows, ev).collect()} == {1: "d1", 3: "d2", 4: "d2", 6: "d3"}


def test_queries_have_unique_columns(spark, sf001):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    df = names["a01_status_type_counts"](spark, sf001)
    assert len(set(df.columns)) == len(df.columns) and entry.entry(spark).count() > 0


def test_nulls_everywhere(spark):
    files = spark.createDataFrame([tuple([i] + [None] * 16) for i in (1, 2)], FILES).withColumns({"path": F.lit("/a/x.jpg"), "filename": F.lit("x.jpg"), "status": F.lit("scanned"), "file_type": F.lit("CAMERA_JPEG")})
    ranked = survivor.with_rank(files, spark.createDataFrame([], CAMERAS))
    dupes = spark.createDataFrame([(1, 1, 2, "EXACT", None, None, None, None), (None, None, 2, None, None, None, None, None)], DUPES)
    assert [(r.file_id, r.keeper) for r in survivor.exact_losers(dupes, ranked).collect()] == [(2, 1)]
    assert survivor.redundant_copies(files, ranked).count() == 0
    counts = defaultdict(int)
    for r in organise.audit_dates(files, F.to_date(F.lit("2024-01-01"))).collect():
        counts[r.date_source] += 1
    assert counts == {"none": 2}


def test_near_links_hold_the_pairs_of_frequent_keys(spark):
    keys = [0] * 9 + [3] + [0xFF00] * 10 + [(1 << 40) - 1, None]
    rows = list(enumerate(keys, 1))
    got = pairs.near_links(spark.createDataFrame(rows, "i long, k long"), "k", "i", 8).collect()
    first = {k: min(i for i, x in rows if x == k) for k in keys if k is not None}
    far = {(r.file_id_a, r.file_id_b): r.hamming_distance for r in got}
    assert len(far) == len(got)
    rep = {i: i for i, k in rows if k is not None} | {b: a for (a, b), h in far.items() if h == 0}
    known = lambda i, j: 0 if rep[i] == rep[j] else far.get((min(rep[i], rep[j]), max(rep[i], rep[j])))
    for i, x in rows[:-1]:
        for j, y in rows[:-1]:
            apart = (x ^ y).bit_count()
            assert known(i, j) == (apart if apart <= 8 else None)
    assert all(rep[i] == first[k] for i, k in rows[:-1])


def test_new_exact_links_join_frequent_hashes(spark):
    files = spark.createDataFrame([(i, "x") for i in range(1, 13)] + [(20, "y"), (21, "y"), (22, "z"), (23, None)], "file_id long, sha256 string")
    known = spark.createDataFrame([(1, 2, "EXACT", 0), (3, 1, "NEAR", 0), (21, 20, "EXACT", 0)], "file_id_a long, file_id_b long, dup_type string, hamming_distance int")
    got = pairs.new_exact_links(known, files).collect()
    assert {(r.file_id_a, r.file_id_b) for r in got} == {(1, i) for i in range(3, 13)}
    assert {(r.dup_type, r.hamming_distance) for r in got} == {("EXACT", 0)}


def test_near_library_links_equal_brute_force(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    flip = lambda k, n: k ^ sum(1 << b for b in rng.sample(range(64), n))
    new = dict(enumerate([flip(k, n) for k in seeds for n in (0, 3, 5)] + [seeds[0]] * 9, 1))
    library = dict(enumerate([flip(k, n) for k in seeds for n in (0, 2, 4)] + [seeds[1]] * 9, 100))
    frame = lambda d: spark.createDataFrame([(i, f"{k:016x}") for i, k in d.items()], "file_id long, phash string")
    got = incremental.near_library_links(frame(new), frame(library)).collect()
    of_new, of_library = {r.new_id: r.library_id for r in got if r.kind == "new"}, {r.library_id: r.new_id for r in got if r.kind == "library"}
    near = {(r.new_id, r.library_id): r.hamming_distance for r in got if r.kind == "near"}
    every = {(i, j): (x ^ y).bit_count() for i, x in new.items() for j, y in library.items()}
    assert {(i, j): near[p] for i, j in every if (p := (of_new.get(i, i), of_library.get(j, j))) in near} == {p: h for p, h in every.items() if h <= 8}
    assert any(h > 4 for h in near.values())


def test_photo_events_cover_all_photo_types_and_lineage(spark):
    from shelfmark.queries.pipeline import photo_events

    at = "2020:01:05 10:00:00"
    rows = [(1, "RAW", "/x/a.cr2", at), (2, "CAMERA_JPEG", "/x/b.jpg", at), (3, "DEV_JPEG", "/x/c.jpg", at), (4, "HEIC", "/x/d.heic", at), (5, "VIDEO", "/x/e.mp4", at), (6, "RAW", "/ev/two/f.cr2", at), (7, "RAW", "/x/g.cr2", "2021:01:01 00:00:00"), (8, "HEIC", "/ev/two/h.heic", None)]
    files = spark.createDataFrame(rows, "file_id long, file_type string, path string, datetime_original string")
    overrides = spark.createDataFrame([("/ev/one", "2020-01-01"), ("/ev/two", "2019-06-01"), ("/ev/three", None)], "source_folder string, date_override string")
    assert {(r.file_id, r.dir) for r in photo_events(files, overrides).collect()} == {(i, "/ev/one") for i in (1, 2, 3, 4)} | {(6, "/ev/two"), (8, "/ev/two")}
