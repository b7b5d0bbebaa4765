"""Queries of runs, undo, synchronisation and decisions with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import naming
from shelfmark.operators import decisions, execution, overlap, survivor
from shelfmark.queries.pipeline import CLUSTERS, HASHED, MEMBERS, RANKED, REDUNDANT, WEAK, _ROLLUP, _twins_sql, hashed, ranking
from shelfmark.queries.reports import PARENT
from shelfmark.runtime import number_rows, table
from shelfmark.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2026-01-01T00:00:00+00:00"


def query(name: str, sql: str | None = None):
    def add(fn):
        names = fn.__code__.co_varnames[: fn.__code__.co_argcount]
        QUERIES[name] = lambda spark, sf_dir: fn(*(table(spark, sf_dir, n) for n in names))
        if sql:
            SQL[name] = sql
        return fn

    return add


def once(operations):
    """Operations without rows delivered twice."""
    return operations.dropDuplicates(["op_id"])


#: What lies on disk in these queries: every path of the catalogue but those of flagged files, and the targets of operations of three.
def listing(files, operations):
    return files.where("status <> 'flagged'").select("path").unionByName(operations.where("file_id % 3 = 0 and target_path is not null").select(F.col("target_path").alias("path"))).distinct()


DISK = """
ops as (select distinct on (op_id) * from operations order by op_id, executed_at desc nulls last, status),
disk as (select path from files where status <> 'flagged' union select target_path from operations where file_id % 3 = 0 and target_path is not null)"""
RUN = f"""{DISK},
run as (select o.* from ops o join files f using (file_id) where o.status in ('confirmed', 'in_progress')),
came as (select op_id, file_id, op_type, target_path as place,
  case when status = 'in_progress' and source_path not in (select path from disk) and target_path in (select path from disk) then 'done'
    when source_path not in (select path from disk) then 'skipped' else 'done' end as status from run)"""


def settled(operations):
    """One row an operation: the latest execution, then the least status."""
    rank = F.struct(F.col("executed_at").isNull().alias("n"), F.coalesce("executed_at", F.lit("")).alias("t"))
    best = operations.groupBy("op_id").agg(F.max(F.when(F.col("executed_at").isNotNull(), F.col("executed_at"))).alias("_t"))
    rows = operations.join(best, "op_id").where(F.col("executed_at").eqNullSafe(F.col("_t"))).drop("_t")
    return rows.groupBy("op_id").agg(F.min_by(F.struct(*[c for c in operations.columns if c != "op_id"]), "status").alias("x")).select("op_id", *[F.col(f"x.{c}").alias(c) for c in operations.columns if c != "op_id"])


@query("x18_run_outcomes", f"with {RUN} select op_id, file_id, status, place from came")
def _(operations, files):
    return execution.run_outcomes(execution.run_list(settled(operations), files), listing(files, operations)).select("op_id", "file_id", "status", "place")


@query("x18_recorded_run", f"""with {RUN}
select o.op_id, coalesce(c.status, o.status) as status, case when c.status = 'done' then '{NOW}' else o.executed_at end as executed_at from ops o left join came c using (op_id)""")
def _(operations, files):
    ops = settled(operations)
    came = execution.run_outcomes(execution.run_list(ops, files), listing(files, operations))
    return execution.record_run(ops, files, came, F.lit(NOW))[0].select("op_id", "status", "executed_at")


@query("x18_moved_files", f"""with {RUN}, last as (select file_id, arg_max(place, op_id) as place from came where status = 'done' group by 1)
select f.file_id, coalesce(l.place, f.path) as path, case when l.file_id is not null then 'done' else f.status end as status from files f left join last l using (file_id)""")
def _(operations, files):
    ops = settled(operations)
    came = execution.run_outcomes(execution.run_list(ops, files), listing(files, operations))
    return execution.record_run(ops, files, came, F.lit(NOW))[1].select("file_id", "path", "status")


@query("x18_run_summary", f"with {RUN} select op_type, status, count(*) as operations from came group by 1, 2")
def _(operations, files):
    return execution.run_summary(execution.run_outcomes(execution.run_list(settled(operations), files), listing(files, operations)))


@query("x18_conserved", f"""with {RUN}, last as (select file_id from came where status = 'done' group by 1)
select count(*) filter (where status <> 'error') as files_before, count(*) filter (where status <> 'error' or file_id in (select file_id from last)) as files_after, 0::bigint as lost from files""")
def _(operations, files):
    ops = settled(operations)
    came = execution.run_outcomes(execution.run_list(ops, files), listing(files, operations))
    return execution.conserved(files, execution.record_run(ops, files, came, F.lit(NOW))[1])


VOLUME = r"case when regexp_matches({0}, '^[A-Za-z]:') then lower(left({0}, 2)) when regexp_matches({0}, '^\\\\[^\\/]+[\\/][^\\/]+') then lower(regexp_extract({0}, '^\\\\[^\\/]+\\[^\\/]+')) when starts_with({0}, '/') then '/' else '' end"


@query("x18_preflight", f"""with v as (select {VOLUME.format('source_path')} as source_volume, {VOLUME.format('target_path')} as target_volume from operations where target_path is not null)
select source_volume, target_volume, count(*) as operations from v where source_volume <> target_volume group by 1, 2""")
def _(operations):
    return execution.preflight(operations)


@query("o01_run_order", f"with {DISK} select o.op_id, row_number() over (order by o.op_type, o.op_id) as place from ops o join files f using (file_id) where o.status in ('confirmed', 'in_progress')")
def _(operations, files):
    return number_rows(execution.run_list(settled(operations), files).select("op_id", "op_type"), "place", "op_type", "op_id").select("op_id", "place")


@query("x19_undo_outcomes", f"""with {DISK}
select o.op_id, case when f.path not in (select path from disk) then 'skipped' when o.source_path in (select path from disk) and o.source_path <> f.path then 'error' else 'confirmed' end as status
from ops o join files f using (file_id) where o.status = 'done'""")
def _(operations, files):
    from shelfmark.operators.ledger import worklist

    return execution.undo_outcomes(worklist(settled(operations), files, "done"), listing(files, operations)).select("op_id", "status")


@query("x24_relocated", r"""with top as (select regexp_replace(path_prefix, '[\\/]+$', '') as p from scan_roots order by root_id limit 1),
hit as (select f.* from files f, top where path = p or starts_with(path, p || '/') or starts_with(path, p || '\'))
select file_id, path as old_path, 'moved' || substr(path, length(p) + 1) as new_path, case when status <> 'done' then 'not_done' when file_id % 5 = 0 then 'not_on_disk' else 'relocated' end as outcome from hit, top""")
def _(files, scan_roots):
    old = scan_roots.orderBy("root_id").select(F.regexp_replace("path_prefix", r"[\\/]+$", "")).first()[0]
    disk = files.where("file_id % 5 <> 0").select(F.concat(F.lit("moved"), F.substr("path", F.lit(len(old) + 1))).alias("path"))
    return execution.sync_relocated(files, old, "moved", disk)


@query("x24_delete_operations", r"""with top as (select regexp_replace(path_prefix, '[\\/]+$', '') as p from scan_roots order by root_id limit 1)
select file_id, 'DELETE' as op_type, path as source_path from files, top where (path = p or starts_with(path, p || '/') or starts_with(path, p || '\')) and status = 'done' and file_id % 5 = 0""")
def _(files, scan_roots):
    old = scan_roots.orderBy("root_id").select(F.regexp_replace("path_prefix", r"[\\/]+$", "")).first()[0]
    gone = execution.sync_deleted(files, old, files.where("file_id % 5 <> 0").select("path"), True)
    return execution.sync_operations(gone, F.lit(NOW)).select("file_id", "op_type", "source_path")


CLUSTERED = f"with recursive {HASHED}, {RANKED}, {REDUNDANT}, {CLUSTERS}"
INSIDE = """
mine as (select d.*, d.dup_type = 'NEAR' and coalesce(a.cluster_id = b.cluster_id, false) as near from duplicates d left join cl a on a.file_id = d.file_id_a left join cl b on b.file_id = d.file_id_b)"""


def _clusters(files, duplicates, known_cameras):
    ranked = ranking(hashed(files), known_cameras)
    return survivor.near_clusters(ranked, duplicates, ranked, survivor.redundant_copies(ranked, ranked)), ranked


@query("x08_cleared_decisions", f"{CLUSTERED}, {INSIDE} select dup_id, case when near then 'pending' else status end as status, case when not near then keep_file_id end as keep_file_id from mine")
def _(files, duplicates, known_cameras):
    return decisions.clear_decisions(duplicates, _clusters(files, duplicates, known_cameras)[0]).select("dup_id", "status", "keep_file_id")


@query("x08_recorded_selection", f"""{CLUSTERED},
sel as (select *, file_id % 3 <> 0 as kept from cl),
tot as (select s.cluster_id, count(*) filter (where kept) as k, count(*) filter (where not kept) as d, (array_agg(file_id order by area desc, size0 desc, own desc, event desc, len, file_id) filter (where kept))[1] as keeper from sel s join ranked r using (file_id) group by 1),
s as (select sel.*, t.k, t.d, t.keeper from sel join tot t using (cluster_id) where t.k > 0),
mine as (select d.*, a.k, a.d as dropped, a.keeper, d.dup_type = 'NEAR' and coalesce(a.cluster_id = b.cluster_id, false) as near, coalesce((d.file_id_a = a.keeper and not b.kept) or (d.file_id_b = a.keeper and not a.kept), false) as of_keeper
  from duplicates d left join s a on a.file_id = d.file_id_a left join s b on b.file_id = d.file_id_b)
select dup_id, case when near and (status = 'pending' or (dropped > 0 and of_keeper)) then 'reviewed' else status end as status,
  case when near and dropped > 0 and of_keeper then keeper when near and status = 'pending' and dropped > 0 and k = 1 then keeper when near and status = 'pending' then null else keep_file_id end as keep_file_id from mine
union all select null, 'reviewed', keeper from s where not kept and not exists (select 1 from duplicates d where least(d.file_id_a, d.file_id_b) = least(s.file_id, s.keeper) and greatest(d.file_id_a, d.file_id_b) = greatest(s.file_id, s.keeper))""")
def _(files, duplicates, known_cameras):
    clusters, ranked = _clusters(files, duplicates, known_cameras)
    selection = clusters.select("file_id", "cluster_id", (F.col("file_id") % 3 != 0).alias("kept"))
    return decisions.record_selection(duplicates, selection, ranked, F.lit(NOW)).select("dup_id", "status", "keep_file_id")


@query("o05_cluster_order", f"{CLUSTERED}, c as (select cl.cluster_id, min(m.min_hamming) as min_hamming, count(*) as members from cl join cluster_min m using (cluster_id) group by 1) select *, row_number() over (order by min_hamming, members desc, cluster_id) as place from c")
def _(files, duplicates, known_cameras):
    ordered = decisions.review_order(_clusters(files, duplicates, known_cameras)[0])
    return number_rows(ordered, "place", F.col("min_hamming"), -F.col("members"), F.col("cluster_id"))


@query("k16_overlap_decisions", f"""with {HASHED}, {MEMBERS}, {_twins_sql(0.02, 1)}, {_ROLLUP}
select folder_a, folder_b, case when shared_count % 2 = 0 then 'reviewed' else 'pending' end as status, case when shared_count % 2 = 0 then 'b' else keeper end as keeper from rolled""")
def _(files, scan_roots):
    stored = overlap.folder_overlaps(hashed(files), scan_roots, **WEAK).withColumn("overlap_id", F.xxhash64("folder_a", "folder_b")).withColumns({"status": F.lit("pending"), "reviewed_at": F.lit(None).cast("string")})
    given = stored.where("shared_count % 2 = 0").select("overlap_id", F.lit("b").alias("keeper"))
    return decisions.decide_overlaps(stored, given, F.lit(NOW)).select("folder_a", "folder_b", "status", "keeper")


@query("k02_error_rows", f"""with bad as (select path, filename from files where file_id % 7 = 0)
select f.file_id, f.path, case when b.path is not null then 'error' else f.status end as status, case when b.path is not null then 'UNKNOWN' else f.file_type end as file_type, case when b.path is not null then 'unreadable' else f.error_msg end as error_msg from files f left join bad b using (path)""")
def _(files):
    failed = files.where("file_id % 7 = 0").select("path", F.lit("unreadable").alias("error_msg"))
    return sinks.record_errors(files, failed, F.lit(NOW))[0].select("file_id", "path", "status", "file_type", "error_msg")


@query("k05_scan_state", f"""with s as (select source_folder as directory, per_day_split as completed from folder_overrides), c as (select {PARENT.format('path')} as directory, count(*) as n from files where {PARENT.format('path')} is not null group by 1)
select coalesce(s.directory, c.directory) as directory, coalesce(c.n, 0) as files_found, case when c.n is not null then (c.n % 2 = 0)::int else s.completed end as completed,
 case when c.n % 2 = 0 then '{NOW}' when s.completed = 1 then 'before' end as completed_at from s full join c on s.directory = c.directory""")
def _(files, folder_overrides):
    from shelfmark.functions.paths import parent

    states = folder_overrides.select(F.col("source_folder").alias("directory"), F.lit(0).cast("long").alias("files_found"), F.lit(0).cast("long").alias("files_scanned"), F.col("per_day_split").alias("completed"), F.lit("start").alias("started_at"), F.when(F.col("per_day_split") == 1, "before").alias("completed_at"))
    change = files.select(parent(F.col("path")).alias("directory")).where("directory is not null").groupBy("directory").agg(F.count("*").alias("files_found")).select("directory", "files_found", F.col("files_found").alias("files_scanned"), (F.col("files_found") % 2 == 0).alias("completed"))
    return execution.scan_state(states, change, F.lit(NOW)).select("directory", "files_found", "completed", "completed_at")


@query("k10_numbered_operations", """with o as (select max(op_id) as last from operations) select last + row_number() over (order by file_id) as op_id, file_id, 'MOVE' as op_type from files, o where status = 'hashed'""")
def _(operations, files):
    new = files.where("status = 'hashed'").select("file_id", F.lit("MOVE").alias("op_type"))
    return execution.append_numbered(operations.select("op_id", "file_id", "op_type"), new, "op_id", "file_id")


@query("p09_in_year_folder", r"select file_id from files where list_contains(string_split_regex(path, '[\\/]'), '2019')")
def _(files):
    return files.where(execution.in_year_folder(F.col("path"), "2019")).select("file_id")


@query("f32_sanitized_cameras", r"select distinct camera_model, coalesce(nullif(substr(regexp_replace(regexp_replace(camera_model, '[^\w]', '_', 'g'), '^_+|_+$', '', 'g'), 1, 20), ''), 'Unknown') as camera from files where camera_model is null or camera_model = regexp_replace(camera_model, '[^\x00-\x7f]', '', 'g')")
def _(files):
    return files.where(F.col("camera_model").isNull() | ~F.col("camera_model").rlike(r"[^\x00-\x7f]")).select("camera_model", naming.sanitize_camera(F.col("camera_model")).alias("camera")).distinct()


@query("a40_clone_summary", """with a as (select filename as rel, max(size_bytes) as size, min(file_id) as i from files group by 1)
select count(*) filter (where i % 4 <> 0) as total, count(*) filter (where i % 4 = 1 and i % 3 <> 0) as copied, count(*) filter (where i % 4 in (2, 3)) as skipped, count(*) filter (where i % 4 = 1 and i % 3 = 1) as verified, count(*) filter (where i % 4 = 1 and i % 3 = 0) as errors,
 count(*) filter (where i % 4 = 0) as pruned, coalesce(sum(size) filter (where i % 4 = 1 and i % 3 <> 0), 0)::bigint as bytes_copied from a""")
def _(files):
    a = files.groupBy(F.col("filename").alias("rel")).agg(F.max("size_bytes").alias("size"), F.min("file_id").alias("i")).where("rel is not null")
    actions = a.select("rel", "size", F.when(F.col("i") % 4 == 0, "prune").when(F.col("i") % 4 == 1, "copy").otherwise("keep").alias("action"))
    outcomes = a.where("i % 4 = 1").select("rel", F.when(F.col("i") % 3 == 0, "error").otherwise("done").alias("status"), (F.col("i") % 3 == 1).alias("verified"))
    return execution.clone_summary(actions, outcomes)
