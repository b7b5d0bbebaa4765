"""Running, undoing and recording operations: each step is a function of tables.

What touches the disk is in ``sources.fsops``; here the run list is made, the
outcomes are judged or taken over, and new versions of the tables come out. A
listing is a frame of the paths that exist (column path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import parts, rebase, within
from shelfmark.operators.ledger import next_status, worklist
from shelfmark.runtime import number_rows

#: Operations that a run takes up: confirmed ones, and those that a crash left in progress.
RUNNABLE = ("confirmed", "in_progress")


def run_list(operations: DataFrame, files: DataFrame, **filters) -> DataFrame:
    """Operations to be run with their files, moves before stagings, then by op_id."""
    rows = [worklist(operations, files, s, **filters).withColumn("status", F.lit(s)) for s in RUNNABLE]
    return rows[0].unionByName(rows[1]).orderBy("op_type", "op_id")


def volume(path: Column) -> Column:
    """The drive or share of a path, in lower case; "/" for other absolute paths and "" for relative ones."""
    drive = F.regexp_extract(path, r"^([A-Za-z]:|\\\\[^\\/]+\\[^\\/]+)", 1)
    return F.when(drive != "", F.lower(drive)).when(path.startswith("/"), "/").otherwise("")


def preflight(run: DataFrame) -> DataFrame:
    """(source_volume, target_volume, operations): moves that no rename can do,
    as source and target lie on different volumes. An empty result lets a run start."""
    pairs = run.where("target_path is not null").groupBy(volume(F.col("source_path")).alias("source_volume"), volume(F.col("target_path")).alias("target_volume")).agg(F.count("*").alias("operations"))
    return pairs.where("source_volume <> target_volume")


def _there(rows: DataFrame, column: str, listing: DataFrame, out: str) -> DataFrame:
    seen = listing.select(F.col("path").alias(column)).distinct().withColumn(out, F.lit(True))
    return rows.join(seen, column, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def run_outcomes(run: DataFrame, listing: DataFrame) -> DataFrame:
    """(op_id, file_id, op_type, status, place): what a run over the listed files
    comes to. One in progress whose source is gone and whose target is there is
    done; without a source an operation is skipped; all others are done.
    Targets that are taken are numbered by ``organise.number_conflicts``."""
    both = _there(_there(run, "source_path", listing, "_source"), "target_path", listing, "_target")
    after = next_status(F.col("status"), F.col("_source"), F.col("_target"))
    return both.select("op_id", "file_id", "op_type", F.when(after.isin(*RUNNABLE), "done").otherwise(after).alias("status"), F.col("target_path").alias("place"))


def undo_outcomes(run: DataFrame, listing: DataFrame) -> DataFrame:
    """(op_id, file_id, op_type, status, place) of done operations (with the
    file's present path) turned round: skipped if the file is not where it
    should be, error if its old place is taken, else confirmed again."""
    both = _there(_there(run, "path", listing, "_here"), "source_path", listing, "_taken")
    status = F.when(~F.col("_here"), "skipped").when(F.col("_taken") & (F.col("source_path") != F.col("path")), "error").otherwise("confirmed")
    return both.select("op_id", "file_id", "op_type", status.alias("status"), F.col("source_path").alias("place"))


def record_run(operations: DataFrame, files: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New versions of both tables after a run or an undo. A done operation gets
    its time, and its file becomes done at its new place; one that was turned
    round loses the time, and its file is confirmed at its old place. Skipped
    and failed undo steps change nothing. Rows delivered twice change alike."""
    o = outcomes.select("op_id", F.col("status").alias("_s"), F.col("place").alias("_p"), "file_id").dropDuplicates(["op_id"])
    kept = F.coalesce((F.col("status") == "done") & F.col("_s").isin("skipped", "error"), F.lit(False))
    status = F.when(F.col("_s").isNull() | kept, F.col("status")).otherwise(F.col("_s"))
    new = {
        "status": status,
        "executed_at": F.when(F.col("_s").isNull() | kept, F.col("executed_at")).when(F.col("_s") == "done", now).when(F.col("_s") == "confirmed", F.lit(None)).otherwise(F.col("executed_at")),
        "error_msg": F.when((F.col("_s") == "skipped") & ~kept, F.lit("source not found")).otherwise(F.col("error_msg")),
    }
    ops = operations.join(o.drop("file_id"), "op_id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in operations.columns])
    # a file with several outcomes takes that of its last operation
    moved = o.where("_s in ('done', 'confirmed')").groupBy("file_id").agg(F.max_by(F.struct("_s", "_p"), "op_id").alias("_x"))
    put = {"status": F.coalesce(F.col("_x._s"), F.col("status")), "path": F.coalesce(F.col("_x._p"), F.col("path")), "updated_at": F.when(F.col("_x").isNotNull(), now).otherwise(F.col("updated_at"))}
    return ops, files.join(moved, "file_id", "left").select(*[put[c].alias(c) if c in put else F.col(c) for c in files.columns])


def run_log(outcomes: DataFrame, phase: str, now: Column) -> DataFrame:
    """(phase, level, message, file_id, path, logged_at) of outcomes that need a look."""
    level = F.when(F.col("status") == "error", "ERROR").when(F.col("status") == "skipped", "WARN")
    rows = outcomes.withColumn("level", level).where("level is not null")
    return rows.select(F.lit(phase).alias("phase"), "level", F.concat_ws(" ", "op_type", "status").alias("message"), "file_id", F.col("place").alias("path"), now.alias("logged_at"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """(op_type, status, operations)."""
    return outcomes.groupBy("op_type", "status").agg(F.count("*").alias("operations"))


def conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(files_before, files_after, lost): a run neither makes nor loses files."""
    count = lambda df, name: df.agg(F.count_if(F.col("status") != "error").alias(name))
    lost = before.where("status <> 'error'").select("file_id").join(after.select("file_id"), "file_id", "left_anti").agg(F.count("*").alias("lost"))
    return count(before, "files_before").crossJoin(count(after, "files_after")).crossJoin(lost)  # one row each


def set_phase(phases: DataFrame, name: str, status: str, now: Column, summary: str | None = None) -> DataFrame:
    """The phase table (phase_name, status, started_at, completed_at,
    summary_json) with one transition: running sets the start, complete the end."""
    hit = F.col("phase_name") == name
    new = {"status": F.lit(status), "summary_json": F.lit(summary).cast("string")} | ({"started_at": now} if status == "running" else {"completed_at": now} if status == "complete" else {})
    return phases.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in phases.columns])


def phase_after_undo(phases: DataFrame, operations: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The execute phase is open again if nothing is done any more and no step failed."""
    clean = outcomes.where("status in ('error', 'skipped')").limit(1).count() == 0
    if clean and outcomes.limit(1).count() and operations.where("status = 'done'").limit(1).count() == 0:
        return set_phase(phases, "execute", "pending", now)
    return phases


def scan_state(states: DataFrame, change: DataFrame, now: Column) -> DataFrame:
    """Folders of a scan (directory, files_found, files_scanned, completed,
    started_at, completed_at) with the counts of ``change`` (directory,
    files_found, files_scanned, completed). The first start stays, and so does
    an earlier end unless this scan is complete."""
    c = change.groupBy("directory").agg(F.max("files_found").alias("_f"), F.max("files_scanned").alias("_s"), F.max(F.col("completed").cast("int")).alias("_c"))
    j = states.join(c, "directory", "full")
    done = F.coalesce(F.col("_c") == 1, F.lit(False))
    return j.select(
        "directory", F.coalesce("_f", "files_found").alias("files_found"), F.coalesce("_s", "files_scanned").alias("files_scanned"), F.coalesce("_c", F.col("completed").cast("int")).alias("completed"),
        F.coalesce("started_at", now).alias("started_at"), F.when(done, now).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def append_numbered(existing: DataFrame, new: DataFrame, id_: str, *order: str) -> DataFrame:
    """``new`` rows with ids that go on from the greatest of ``existing``, in the given order."""
    last = existing.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_last"))
    rows = number_rows(new.drop(id_), "_n", *order).crossJoin(last)  # one row
    return rows.withColumn(id_, F.col("_last") + F.col("_n")).select(*[c for c in existing.columns if c in rows.columns or c == id_])


def sync_relocated(files: DataFrame, old: str, new: str, listing: DataFrame) -> DataFrame:
    """(file_id, old_path, new_path, outcome) of the files at or below ``old``
    after a folder or file was renamed to ``new``: relocated, not_done, or
    not_on_disk. Everything is refused (no rows) if something still lies at
    ``old`` or nothing lies at ``new``."""
    at = lambda place: (F.col("path") == place) | within(F.col("path"), F.lit(place))
    if listing.where(at(old)).limit(1).count() or not listing.where(at(new)).limit(1).count():
        return files.limit(0).select("file_id", F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.lit("").alias("outcome"))
    rows = files.where(at(old)).select("file_id", F.col("path").alias("old_path"), "status", rebase(F.col("path"), F.lit(old), F.lit(new)).alias("new_path"))
    seen = _there(rows, "new_path", listing, "_there")
    outcome = F.when(F.col("status") != "done", "not_done").when(~F.col("_there"), "not_on_disk").otherwise("relocated")
    return seen.select("file_id", "old_path", "new_path", F.coalesce(outcome, F.lit("not_done")).alias("outcome"))


def sync_deleted(files: DataFrame, place: str, listing: DataFrame, confirmed: bool = False) -> DataFrame:
    """(file_id, old_path, new_path, outcome) of the files at or below ``place``
    that were deleted by hand: deleted, not_done, or still_there. Refused (no
    rows) unless ``confirmed``; paths and states of the files do not change."""
    rows = files.where((F.col("path") == place) | within(F.col("path"), F.lit(place))) if confirmed else files.limit(0)
    seen = _there(rows.select("file_id", F.col("path").alias("old_path"), "status"), "old_path", listing, "_there")
    outcome = F.when(F.col("status") != "done", "not_done").when(F.col("_there"), "still_there").otherwise("deleted")
    return seen.select("file_id", "old_path", F.lit(None).cast("string").alias("new_path"), F.coalesce(outcome, F.lit("not_done")).alias("outcome"))


def sync_operations(synced: DataFrame, now: Column) -> DataFrame:
    """Done RENAME and DELETE operations (file_id, op_type, source_path,
    target_path, status, planned_at, executed_at) of what was synced."""
    kind = F.when(F.col("outcome") == "relocated", "RENAME").when(F.col("outcome") == "deleted", "DELETE")
    return synced.withColumn("op_type", kind).where("op_type is not null").select("file_id", "op_type", F.col("old_path").alias("source_path"), F.col("new_path").alias("target_path"), F.lit("done").alias("status"), now.alias("planned_at"), now.alias("executed_at"))


def sync_files(files: DataFrame, synced: DataFrame, now: Column) -> DataFrame:
    """``files`` with the new paths of what was relocated."""
    new = synced.where("outcome = 'relocated'").select("file_id", F.col("new_path").alias("_p"))
    put = {"path": F.coalesce("_p", "path"), "updated_at": F.when(F.col("_p").isNotNull(), now).otherwise(F.col("updated_at"))}
    return files.join(new, "file_id", "left").select(*[put[c].alias(c) if c in put else F.col(c) for c in files.columns])


def clone_summary(actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(total, copied, skipped, verified, errors, pruned, bytes_copied) of a copy
    of the library: ``actions`` are (rel, action, size), ``outcomes`` (rel, status, verified)."""
    j = actions.join(outcomes, "rel", "left")
    copied = (F.col("action") == "copy") & (F.col("status") == "done")
    return j.agg(
        F.count_if(F.col("action") != "prune").alias("total"), F.count_if(copied).alias("copied"), F.count_if(F.col("action") == "keep").alias("skipped"),
        F.count_if(copied & F.col("verified")).alias("verified"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("action") == "prune").alias("pruned"),
        F.coalesce(F.sum(F.when(copied, F.col("size"))), F.lit(0)).alias("bytes_copied"),
    )


def verify_copies(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(rel, state): every copy compared with the recorded hash: verified,
    tampered, or missing; both frames are (rel, sha256). A null hash of
    ``expected`` cannot be verified and gives unknown."""
    j = expected.select("rel", "sha256").join(found.select("rel", F.col("sha256").alias("_f"), F.lit(True).alias("_there")), "rel", "left")
    return j.select("rel", F.when(F.col("_there").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.lower("sha256") == F.lower("_f"), "verified").otherwise("tampered").alias("state"))


def in_year_folder(path: Column, year: str) -> Column:
    """Whether some folder or the name of a path is exactly the year."""
    return F.array_contains(parts(path), year)
