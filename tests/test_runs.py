"""Runs, undo, synchronisation and decisions on small tables."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import decisions, execution, overlap
from shelfmark.plans import organise
from shelfmark.sources import fsops, schema, sinks

OPS = "op_id long, file_id long, op_type string, source_path string, target_path string, status string, error_msg string, executed_at string, u string"
FILES = "file_id long, path string, status string, updated_at string, datetime_original string, camera_model string, software string, file_type string, size_bytes long, place string"
LINKS = "dup_id long, file_id_a long, file_id_b long, dup_type string, hamming_distance int, keep_file_id long, status string, resolved_at string, cluster_id long"


def file_row(i, path, status="confirmed", at="2020:01:01", model="X2", kind="RAW"):
    return (i, path, status, None, at, model, "Lr", kind, 1, "clash")


def op(i, f, kind="MOVE", status="confirmed", s=None, t=None):
    return (i, f, kind, s or f"/s/{f}", t or f"/t/{f}", status, None, "2020" if status == "done" else None, "clash")


def test_run_records_and_undo(spark):
    ops = spark.createDataFrame([op(1, 1), op(2, 2), op(3, 3, status="in_progress"), op(4, 4, status="in_progress"), op(5, 5, "STAGE_DELETE"), op(6, 6, status="done"), op(7, 7, status="planned")], OPS)
    files = spark.createDataFrame([file_row(i, f"/s/{i}") for i in range(1, 6)] + [file_row(6, "/t/6", "done"), file_row(7, "/s/7")], FILES)
    run = execution.run_list(ops, files)
    assert [(r.op_id, r.status) for r in run.collect()] == [(1, "confirmed"), (2, "confirmed"), (3, "in_progress"), (4, "in_progress"), (5, "confirmed")]
    assert execution.preflight(run).count() == 0
    disk = spark.createDataFrame([("/s/1",), ("/t/3",), ("/s/4",), ("/s/5",), ("/t/6",)], "path string")
    came = execution.run_outcomes(run, disk)
    assert {r.op_id: r.status for r in came.collect()} == {1: "done", 2: "skipped", 3: "done", 4: "done", 5: "done"}
    ops2, files2 = execution.record_run(ops, files, came, F.lit("now"))
    assert ops2.columns == ops.columns and files2.columns == files.columns
    assert {r.op_id: (r.status, r.executed_at, r.error_msg) for r in ops2.collect()} == {1: ("done", "now", None), 2: ("skipped", None, "source not found"), 3: ("done", "now", None), 4: ("done", "now", None), 5: ("done", "now", None), 6: ("done", "2020", None), 7: ("planned", None, None)}
    assert {r.file_id: (r.path, r.status) for r in files2.where("file_id in (1, 2, 7)").collect()} == {1: ("/t/1", "done"), 2: ("/s/2", "confirmed"), 7: ("/s/7", "confirmed")}
    assert tuple(execution.conserved(files, files2).first()) == (7, 7, 0)
    assert [(r.level, r.file_id) for r in execution.run_log(came, "execute", F.lit("now")).collect()] == [("WARN", 2)]
    from shelfmark.operators.ledger import undo_list

    back = execution.undo_outcomes(undo_list(ops2, files2), spark.createDataFrame([("/t/1",), ("/t/3",), ("/s/3",), ("/t/5",), ("/t/6",)], "path string"))
    assert {r.op_id: r.status for r in back.collect()} == {1: "confirmed", 3: "error", 4: "skipped", 5: "confirmed", 6: "confirmed"}
    ops3, files3 = execution.record_run(ops2, files2, back, F.lit("later"))
    assert {r.op_id: (r.status, r.executed_at) for r in ops3.collect()} == {1: ("confirmed", None), 2: ("skipped", None), 3: ("done", "now"), 4: ("done", "now"), 5: ("confirmed", None), 6: ("confirmed", None), 7: ("planned", None)}
    assert {r.file_id: r.path for r in files3.where("file_id in (1, 3)").collect()} == {1: "/s/1", 3: "/t/3"}
    phases = spark.createDataFrame([("execute", "complete", "a", "b", None), ("plan", "complete", "a", "b", "{}")], "phase_name string, status string, started_at string, completed_at string, summary_json string")
    assert execution.phase_after_undo(phases, ops3, back, F.lit("x")).where("status = 'pending'").count() == 0
    clean = back.where("op_id = 1")
    open_ = execution.phase_after_undo(phases, ops3.where("status <> 'done'"), clean, F.lit("x"))
    assert {r.phase_name: r.status for r in open_.collect()} == {"execute": "pending", "plan": "complete"}
    run_ = {r.phase_name: tuple(r) for r in execution.set_phase(phases, "plan", "running", F.lit("x"), "{1}").collect()}
    assert run_["plan"] == ("plan", "running", "x", "b", "{1}") and run_["execute"][1] == "complete"
    none = execution.run_outcomes(execution.run_list(ops.limit(0), files), disk)
    assert execution.record_run(ops, files, none, F.lit("x"))[0].exceptAll(ops).count() == 0


def test_volumes(spark):
    df = spark.createDataFrame([("C:\\a\\b", "c:\\x"), ("D:/a", "/b"), ("\\\\srv\\share\\x", "\\\\srv\\other\\y"), ("rel/a", None)], "source_path string, target_path string")
    assert {(r.source_volume, r.target_volume) for r in execution.preflight(df).collect()} == {("d:", "/"), ("\\\\srv\\share", "\\\\srv\\other")}


def test_undo_keeps_the_order_of_one_file(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in "abc")
    (tmp_path / "c").write_text("x")
    rows = spark.createDataFrame([(1, 5, a, b, "2020-01-01"), (2, 5, b, c, "2020-01-02"), (3, 6, a + "/none", b + "9", "2020-01-01")], "op_id long, file_id long, source_path string, target_path string, executed_at string")
    assert {r.op_id: r.status for r in fsops.undo(rows).collect()} == {1: "done", 2: "done", 3: "skipped"} and (tmp_path / "a").read_text() == "x"
    (tmp_path / "c").write_text("y")
    assert fsops.undo(spark.createDataFrame([(9, 9, a, c, "2021")], rows.schema)).first().status == "error" and (tmp_path / "c").exists()


def test_sync(spark):
    files = spark.createDataFrame([file_row(1, "/lib/a_b/x", "done"), file_row(2, "/lib/a_b/y", "done"), file_row(3, "/lib/a_b/z"), file_row(4, "/lib/aXb/x", "done"), file_row(5, "/lib/a_b", "done")], FILES)
    disk = spark.createDataFrame([("/lib/new/x",), ("/lib/aXb/x",), ("/lib/new",)], "path string")
    got = execution.sync_relocated(files, "/lib/a_b", "/lib/new", disk)
    assert {r.file_id: (r.new_path, r.outcome) for r in got.collect()} == {1: ("/lib/new/x", "relocated"), 2: ("/lib/new/y", "not_on_disk"), 3: ("/lib/new/z", "not_done"), 5: ("/lib/new", "relocated")}
    assert execution.sync_relocated(files, "/lib/aXb", "/lib/new", disk).count() == 0 and execution.sync_relocated(files, "/lib/a_b", "/lib/other", disk).count() == 0
    assert [(r.file_id, r.op_type, r.target_path) for r in execution.sync_operations(got, F.lit("t")).orderBy("file_id").collect()] == [(1, "RENAME", "/lib/new/x"), (5, "RENAME", "/lib/new")]
    assert {r.file_id: r.path for r in execution.sync_files(files, got, F.lit("t")).collect()}[2] == "/lib/a_b/y"
    assert execution.sync_deleted(files, "/lib", disk).count() == 0
    gone = execution.sync_deleted(files, "/lib", disk, True)
    assert {r.file_id: r.outcome for r in gone.collect()} == {1: "deleted", 2: "deleted", 3: "not_done", 4: "still_there", 5: "deleted"}


def test_selections_and_clearing(spark):
    links = [(1, 1, 2, "NEAR", 1, None, "pending", None, 0), (2, 2, 3, "NEAR", 1, 2, "reviewed", "old", 0), (3, 5, 4, "NEAR", 0, None, "pending", None, 0), (4, 6, 7, "EXACT", 0, None, "pending", None, 0), (5, 1, 6, "NEAR", 1, None, "pending", None, 0), (6, 8, 9, "NEAR", 1, None, "pending", None, 0)]
    d = spark.createDataFrame(links, LINKS)
    ranked = spark.createDataFrame([(i, i) for i in range(1, 12)], "file_id long, r int").withColumn("keep_rank", F.struct("r", (-F.col("file_id")).alias("first")))
    sel = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, False), (4, 4, True), (5, 4, False), (8, 8, True), (9, 8, True), (10, 10, False), (11, 10, False)], "file_id long, cluster_id long, kept boolean")
    got = {(r.file_id_a, r.file_id_b): (r.status, r.keep_file_id) for r in decisions.record_selection(d, sel, ranked, F.lit("now")).collect()}
    assert got == {(1, 2): ("reviewed", None), (2, 3): ("reviewed", 2), (5, 4): ("reviewed", 4), (6, 7): ("pending", None), (1, 6): ("pending", None), (8, 9): ("reviewed", None)}
    none = decisions.record_selection(d.limit(0), sel, ranked, F.lit("now"))
    assert sorted((r.file_id_a, r.file_id_b, r.keep_file_id) for r in none.collect()) == [(2, 3, 2), (4, 5, 4)]
    cleared = decisions.clear_decisions(d, sel)
    assert {r.dup_id: (r.status, r.keep_file_id, r.resolved_at) for r in cleared.collect()}[2] == ("pending", None, None) and cleared.exceptAll(decisions.clear_decisions(cleared, sel)).count() == 0


def test_overlap_decisions(spark):
    o = spark.createDataFrame([(1, "/a", "/b", 5, "a", "pending", None), (2, "/c", "/d", 9, "a", "reviewed", "t")], "overlap_id long, folder_a string, folder_b string, shared_count long, keeper string, status string, reviewed_at string")
    assert [r.overlap_id for r in decisions.pending_overlaps(o, False).collect()] == [2, 1] and [r.overlap_id for r in decisions.pending_overlaps(o).collect()] == [1]
    done = decisions.decide_overlaps(o, spark.createDataFrame([(1, "b")], "overlap_id long, keeper string"), F.lit("now"))
    assert tuple(done.where("overlap_id = 1").first()) == (1, "/a", "/b", 5, "b", "reviewed", "now")
    assert tuple(decisions.reopen_overlaps(done, o.select("overlap_id")).where("overlap_id = 2").first()) == (2, "/c", "/d", 9, "a", "pending", None)
    for change in (decisions.decide_overlaps, decisions.reopen_overlaps):
        with pytest.raises(KeyError):
            change(o, spark.createDataFrame([(7, "a")], "overlap_id long, keeper string"), *([F.lit("n")] if change is decisions.decide_overlaps else []))


def test_true_twins_lose_in_the_plan(spark):
    rows = [(i, f"/r/2019 Trip/{i}.jpg", f"{i}.jpg", f"{i:064x}", "hashed") for i in range(1, 21)] + [(100 + i, f"/r/backup/2019 Trip copy/{i}.jpg", f"{i}.jpg", f"{i:064x}", "hashed") for i in range(1, 21)] + [(200, "/r/backup/2019 Trip copy/only.jpg", "only.jpg", "f" * 64, "hashed")]
    files = spark.createDataFrame(rows, "file_id long, path string, filename string, sha256 string, status string").withColumns({"file_type": F.lit("CAMERA_JPEG"), "extension": F.lit("jpg"), "datetime_original": F.lit("2019:05:01 10:00:00"), "datetime_digitized": F.lit(None).cast("string"), "mtime": F.lit(None).cast("string"), "camera_model": F.lit("X"), "width": F.lit(10), "height": F.lit(10), "size_bytes": F.lit(5).cast("long"), "phash": F.lit(None).cast("string"), "date_source": F.lit(None).cast("string"), "date_confidence": F.lit(None).cast("string")})
    roots = spark.createDataFrame([(1, "/r", "UTC")], "root_id int, path_prefix string, time_zone string")
    twins = overlap.folder_overlaps(files, roots)
    assert sorted((r.folder_a, r.folder_b, r.shared_count, r.b_only_count, r.keeper) for r in twins.collect()) == [("/r/2019 Trip", f, 20, 1, "a") for f in ("/r/backup", "/r/backup/2019 Trip copy")]
    links = spark.createDataFrame([], "dup_id long, file_id_a long, file_id_b long, dup_type string, hamming_distance int, keep_file_id long, status string")
    none = spark.createDataFrame([], "source_folder string, event_name string, date_override string, per_day_split int, confirmed_subject int")
    cameras = spark.createDataFrame([], "model string, owner string")
    plan = organise.plan(files, links, none, cameras, roots, F.to_date(F.lit("2026-01-01")), overlaps=twins.withColumn("status", F.lit("reviewed")))
    staged = {r.file_id: (r.stage_reason, r.dupe_of_file_id) for r in plan.where("op_type = 'STAGE_DELETE'").collect()}
    assert staged == {100 + i: ("folder_merge_loser", i) for i in range(1, 21)}


def test_scan_records(spark, tmp_path):
    states = spark.createDataFrame([("/a", 1, 1, 1, "s", "e"), ("/b", 1, 0, 0, "s", None)], "directory string, files_found long, files_scanned long, completed int, started_at string, completed_at string")
    change = spark.createDataFrame([("/a", 5, 2, False), ("/b", 2, 2, True), ("/c", 3, 0, False)], "directory string, files_found long, files_scanned long, completed boolean")
    got = {r.directory: tuple(r)[1:] for r in execution.scan_state(states, change, F.lit("now")).collect()}
    assert got == {"/a": (5, 2, 0, "s", "e"), "/b": (2, 2, 1, "s", "now"), "/c": (3, 0, 0, "now", None)}
    ops = spark.createDataFrame([(5, 1, "MOVE")], "op_id long, file_id long, op_type string")
    assert [tuple(r) for r in execution.append_numbered(ops, spark.createDataFrame([(9, "M"), (3, "M")], "file_id long, op_type string"), "op_id", "file_id").orderBy("op_id").collect()] == [(6, 3, "M"), (7, 9, "M")]
    assert {r.rel: r.state for r in execution.verify_copies(spark.createDataFrame([("a", "AB"), ("b", "x"), ("c", "y"), ("d", None)], "rel string, sha256 string"), spark.createDataFrame([("a", "ab"), ("b", "z"), ("d", "q")], "rel string, sha256 string")).collect()} == {"a": "verified", "b": "tampered", "c": "missing", "d": "unknown"}
    folders = spark.createDataFrame([("/a/x", 3), ("/a/<y>", 5), ("/b/z", 7), ("/b/w", 7)], "folder string, files long")
    sinks.write_html(folders, str(tmp_path / "page"))
    assert [r.value for r in spark.read.text(str(tmp_path / "page")).collect()] == ["<h2>/b (14)</h2>", "<li>/b/w: 7</li>", "<li>/b/z: 7</li>", "<h2>/a (8)</h2>", "<li>/a/&lt;y&gt;: 5</li>", "<li>/a/x: 3</li>"]


def test_schema_upgrades(spark):
    old = spark.createDataFrame([(1, "/a", "scanned")], "file_id long, path string, status string")
    new = schema.upgrade(old, schema.FILES, 1)
    assert new.columns == [c.name for c in schema.FILES.columns] and new.first().path == "/a" and new.first().rating is None
    with pytest.raises(ValueError):
        schema.upgrade(old, schema.FILES, schema.FILES.version + 1)
    with pytest.raises(ValueError):
        schema.upgrade(spark.createDataFrame([(1, "/a", "odd")], old.schema), schema.FILES, 1).count()
    assert schema.violations(spark.createDataFrame([(1, "/a", "odd")], old.schema), schema.FILES).count() == 1
