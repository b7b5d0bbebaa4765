"""Ledger operators: current state, conservation, consistency, identity repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.classify import DATED_TYPES
from shelfmark.functions.naming import base_and_event, event_label, has_residue
from shelfmark.functions.paths import base_name, rebase, stem, within
from shelfmark.operators.pairs import rank_zip

STATES = ("MOVED", "STAGED", "CONFLICT", "DELETED", "SKIPPED", "ERROR", "UNTOUCHED", "UNACCOUNTED")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the greatest by ``order`` and then by all columns; rows
    delivered twice count once. Nulls are least."""
    rank = F.struct(*[F.col(c) for c in (*order, *[c for c in rows.columns if c not in order])])
    return rows.groupBy(key).agg(F.max(rank).alias("_x")).select(*[F.col(f"_x.{c}").alias(c) for c in rows.columns])


def worklist(operations: DataFrame, files: DataFrame, status: str = "confirmed", year: str | None = None, camera: str | None = None, software: str | None = None, file_type: str | None = None, op_type: str | None = None) -> DataFrame:
    """Operations of one status with their files, filtered like a run: year is a
    text prefix of the date, camera and software are case-insensitive parts."""
    keep = ["op_id", "file_id", "op_type", "source_path", "target_path", "executed_at"]
    rows = operations.where(F.col("status") == status).select(*keep).join(files.select("file_id", "path", "file_type", "camera_model", "software", "datetime_original", "size_bytes"), "file_id")
    if year:
        rows = rows.where(F.substring("datetime_original", 1, 4) == year)
    for column, text in (("camera_model", camera), ("software", software)):
        if text:
            rows = rows.where(F.lower(column).contains(text.lower()))
    if file_type:
        rows = rows.where(F.col("file_type") == file_type)
    if op_type:
        rows = rows.where(F.col("op_type") == op_type)
    return rows


def undo_list(operations: DataFrame, files: DataFrame, **filters) -> DataFrame:
    """Done operations, the last executed first."""
    return worklist(operations, files, "done", **filters).orderBy(F.desc("executed_at"), F.desc("op_id"))


def reconcile_states(files: DataFrame, operations: DataFrame, strict: bool = False) -> DataFrame:
    """(file_id, state): what became of each file. ``strict`` leaves operations
    in progress unaccounted; else they count as waiting."""
    done = F.col("status") == "done"
    waiting = ["planned", "confirmed", "pending", "skipped"] + ([] if strict else ["in_progress"])
    ops = operations.groupBy("file_id").agg(
        F.bool_or(F.col("status") == "error").alias("failed"),
        F.bool_or(done & (F.col("op_type") == "DELETE")).alias("deleted"),
        F.bool_or(done & (F.col("op_type") == "MOVE")).alias("moved"),
        F.bool_or(done & (F.col("op_type") == "STAGE_DELETE")).alias("staged"),
        F.bool_or(F.col("status").isin(*waiting)).alias("waiting"),
        F.count("*").alias("n"),
    )
    r = files.select("file_id", "path", "file_type", "status").join(ops, "file_id", "left")
    conflict = stem(base_name(F.col("path"))).rlike(r"_conflict_\d+$")
    state = (
        F.when((F.col("status") == "error") | F.col("failed"), "ERROR").when(F.col("deleted"), "DELETED")
        .when(F.col("moved") & conflict, "CONFLICT").when(F.col("moved"), "MOVED").when(F.col("staged"), "STAGED")
        .when(F.col("waiting"), "SKIPPED").when(F.col("n").isNull() & (F.col("file_type") == "UNKNOWN"), "UNTOUCHED").otherwise("UNACCOUNTED")
    )
    return r.select("file_id", state.alias("state"))


def balance_sheet(states: DataFrame) -> DataFrame:
    """(state, files) with a row for every state, zeros included."""
    every = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(states.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("files"))


def missing_on_disk(files: DataFrame, states: DataFrame, listing: DataFrame) -> DataFrame:
    """(file_id, path) of files that are said to be in place but are not listed."""
    placed = files.select("file_id", "path").join(states.where(F.col("state").isin("MOVED", "STAGED", "CONFLICT")).select("file_id"), "file_id")
    return placed.join(listing.select("path"), "path", "left_anti").select("file_id", "path")


def orphan_operations(operations: DataFrame, files: DataFrame) -> DataFrame:
    return operations.join(files.select("file_id"), "file_id", "left_anti")


def dangling_duplicates(duplicates: DataFrame, files: DataFrame) -> DataFrame:
    """(dup_id, missing): links that name files that do not exist, and by which columns."""
    names = ("file_id_a", "file_id_b", "keep_file_id")
    long = duplicates.select("dup_id", F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(n).alias("file_id")) for n in names])).alias("x")).select("dup_id", "x.c", "x.file_id").where("file_id is not null").distinct()
    return long.join(files.select("file_id"), "file_id", "left_anti").groupBy("dup_id").agg(F.array_join(F.sort_array(F.collect_set("c")), ",").alias("missing"))


def target_collisions(operations: DataFrame) -> DataFrame:
    """(target_path, files): targets that more than one file was moved to."""
    done = operations.where("op_type = 'MOVE' and status = 'done' and target_path is not null")
    return done.select("target_path", "file_id").distinct().groupBy("target_path").agg(F.count("*").alias("files")).where("files > 1")


def label_residue(operations: DataFrame, *statuses: str) -> DataFrame:
    """(op_id, file_id, label) of moves whose event label still carries a date."""
    rows = operations.where((F.col("op_type") == "MOVE") & F.col("status").isin(*statuses)).select("op_id", "file_id", event_label(F.col("target_path")).alias("label"))
    return rows.where(has_residue(F.col("label")))


def empty_twins(operations: DataFrame) -> DataFrame:
    """(event, empty_base): event folders under two bases of which one lost all its files to staging."""
    base, event = base_and_event(F.col("target_path"))
    rows = operations.where("status = 'done' and op_type in ('MOVE', 'STAGE_DELETE') and target_path is not null").select("op_type", base.alias("base"), event.alias("event")).where("base is not null and event is not null").distinct()
    g = rows.groupBy("event").agg(F.collect_set(F.when(F.col("op_type") == "MOVE", F.col("base"))).alias("moved"), F.collect_set(F.when(F.col("op_type") != "MOVE", F.col("base"))).alias("staged"))
    return g.where(F.size("moved") > 0).select("event", F.explode(F.array_except("staged", "moved")).alias("empty_base"))


def audit(files: DataFrame, operations: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(name, severity, offenders): all consistency checks in one frame."""
    dated = F.col("file_type").isin(*DATED_TYPES)
    checks = (
        ("orphan_operations", "ERROR", orphan_operations(operations, files)),
        ("dangling_duplicates", "ERROR", dangling_duplicates(duplicates, files)),
        ("self_referential_duplicate", "ERROR", duplicates.where("file_id_a = file_id_b")),
        ("target_path_collision", "ERROR", target_collisions(operations)),
        ("event_name_residue_done", "ERROR", label_residue(operations, "done")),
        ("event_name_residue_pending", "WARN", label_residue(operations, "planned", "confirmed")),
        ("cross_base_empty_twin", "WARN", empty_twins(operations)),
        ("low_confidence_dates", "WARN", files.where(dated & (F.col("date_confidence").isNull() | (F.col("date_confidence") == "LOW")))),
    )
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("offenders")).select(F.lit(n).alias("name"), F.lit(s).alias("severity"), "offenders") for n, s, df in checks])


def relocate(stale: DataFrame, unknown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moved files (file_id, path) and lost ones (file_id): stale rows (file_id,
    filename, sha256) matched with unknown listed files (path, filename, sha256),
    one to one within a hash, equal names first."""
    found = rank_zip(stale, unknown, "sha256", "filename", "file_id", "path")
    return found, stale.select("file_id").join(found.select("file_id"), "file_id", "left_anti")


def stale_rows(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Hashed files that are not in error and whose path is not listed."""
    return files.where("sha256 is not null and status <> 'error'").join(listing.select("path"), "path", "left_anti")


def prune(lost: DataFrame, files: DataFrame, operations: DataFrame, duplicates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without lost files that are not done, and what depends on them."""
    gone = files.join(lost.select("file_id"), "file_id", "left_semi").where("status <> 'done'").select("file_id")
    links = duplicates.join(gone.select(F.col("file_id").alias("file_id_a")), "file_id_a", "left_anti").join(gone.select(F.col("file_id").alias("file_id_b")), "file_id_b", "left_anti")
    return files.join(gone, "file_id", "left_anti"), operations.join(gone, "file_id", "left_anti"), links.select(*duplicates.columns)


def move_folder(files: DataFrame, old: str, new: str) -> DataFrame:
    """(file_id, old_path, new_path) of done files at or below ``old`` (exact
    text, no wildcards, either separator) under ``new``."""
    inside = (F.col("path") == old) | within(F.col("path"), F.lit(old))
    rows = files.where((F.col("status") == "done") & inside)
    return rows.select("file_id", F.col("path").alias("old_path"), rebase(F.col("path"), F.lit(old), F.lit(new)).alias("new_path"))


def clone_actions(source: DataFrame, destination: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(rel, action): copy, keep or prune, from two listings (rel, size, mtime in
    seconds). A file is copied if it is missing or differs in size or by more than ``tolerance`` seconds."""
    d = destination.select("rel", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.lit(True).alias("_there"))
    j = source.select("rel", "size", "mtime", F.lit(True).alias("_here")).join(d, "rel", "full")
    same = (F.col("size") == F.col("_s")) & (F.abs(F.col("mtime") - F.col("_m")) <= tolerance)
    return j.select("rel", F.when(F.col("_here").isNull(), "prune").when(F.coalesce(F.col("_there") & same, F.lit(False)), "keep").otherwise("copy").alias("action"))


def next_status(status: Column, source_there: Column, target_there: Column) -> Column:
    """The state of an operation after a restart: one in progress whose source is
    gone and whose target is there is done; with no source at all it is skipped."""
    return F.when((status == "in_progress") & ~source_there & target_there, "done").when(status.isin("confirmed", "in_progress") & ~source_there, "skipped").otherwise(status)


def common_root(files: DataFrame, path: str = "path") -> DataFrame:
    """(root): the longest folder above all paths, "" if there is none. The least
    and the greatest text decide it, so one row of two values is aggregated."""
    r = files.agg(F.min(path).alias("a"), F.max(path).alias("b"))
    pa, pb = F.split("a", r"[\\/]"), F.split("b", r"[\\/]")
    n = F.least(F.size(pa), F.size(pb)) - 1
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & (F.slice(pa, 1, k) == F.slice(pb, 1, k)))
    depth = F.coalesce(F.array_max(same), F.lit(0))
    sep = F.when(F.col("a").contains("\\"), F.lit("\\")).otherwise(F.lit("/"))
    return r.select(F.when(depth > 0, F.call_function("array_join", F.slice(pa, 1, depth), sep)).otherwise("").alias("root"))
