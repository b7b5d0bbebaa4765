"""File operations, pixels and default selections."""

import numpy as np
from pyspark.sql import functions as F

from shelfmark.functions.images import perceptual_hash, phash_of, sharpness
from shelfmark.operators import survivor
from shelfmark.sources import fsops


def test_moves_never_overwrite_and_can_be_undone(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("x.jpg", "y.jpg"):
        (tmp_path / "a" / n).write_text(n)
    target = str(tmp_path / "lib" / "x.jpg")
    ops = spark.createDataFrame([(1, str(tmp_path / "a" / "x.jpg"), target), (2, str(tmp_path / "a" / "y.jpg"), target), (3, str(tmp_path / "none"), str(tmp_path / "lib" / "none"))], "op_id long, source_path string, target_path string").coalesce(1)
    got = {r.op_id: (r.status, r.detail) for r in fsops.execute(ops).collect()}
    assert got == {1: ("done", target), 2: ("done", str(tmp_path / "lib" / "x_conflict_1.jpg")), 3: ("skipped", "")}
    assert {p.read_text() for p in (tmp_path / "lib").iterdir()} == {"x.jpg", "y.jpg"}
    assert {r.op_id: r.status for r in fsops.execute(ops.where("op_id = 1")).collect()} == {1: "done"}  # again: nothing to do
    back = ops.where("op_id = 1")
    assert fsops.undo(back).first().status == "done" and (tmp_path / "a" / "x.jpg").read_text() == "x.jpg"


def test_clone_is_verified(spark, tmp_path):
    src = tmp_path / "s.bin"
    src.write_bytes(b"content")
    good = fsops.digest(str(src))
    rows = spark.createDataFrame([(1, str(src), str(tmp_path / "c" / "1"), good), (2, str(src), str(tmp_path / "c" / "2"), "0" * 64), (3, str(src), str(tmp_path / "c" / "3"), None), (4, str(tmp_path / "none"), str(tmp_path / "c" / "4"), None)], "op_id long, source_path string, target_path string, sha256 string")
    assert {r.op_id: r.status for r in fsops.clone(rows).collect()} == {1: "done", 2: "error", 3: "done", 4: "error"}
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["1", "3"]


def test_pixels(spark):
    rng = np.random.default_rng(1)
    smooth = np.add.outer(np.arange(32), np.arange(32)).ravel().tolist()
    noise = rng.integers(0, 255, 1024).tolist()
    brighter = [p + 3 for p in noise]
    df = spark.createDataFrame([(0, smooth), (1, noise), (2, brighter), (3, None), (4, []), (5, [1, 2, 3])], "i int, p array<int>")
    got = df.select("i", perceptual_hash("p").alias("h"), sharpness("p").alias("s")).orderBy("i").collect()
    assert got[1].h == got[2].h == phash_of(noise) and len(got[0].h) == 16 and got[0].h != got[1].h
    assert got[1].s > got[0].s and [r.h for r in got[3:]] == [None] * 3 and [r.s for r in got[3:]] == [None] * 3


def test_default_selection(spark):
    ranked = spark.createDataFrame([(1, "a.jpg", 1), (2, "a.png", 2), (3, "b.jpg", 1), (4, "c.jpg", 2), (5, "d.jpg", 1), (6, "e.jpg", 1)], "file_id long, filename string, r int").withColumn("keep_rank", F.struct("r", (-F.col("file_id")).alias("first")))
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "file_id long, cluster_id long")
    scores = spark.createDataFrame([(3, 10.0), (4, 5.0), (5, 10.0)], "file_id long, sharpness double")
    got = {r.file_id: r.keep for r in survivor.default_selection(clusters, ranked, scores).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}
