"""Further queries: scalar functions, dimension joins, selections and remaining counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import dates, metadata, naming, paths
from shelfmark.functions.classify import PHOTO_TYPES
from shelfmark.functions.hashes import hex_to_long, long_to_hex, valid_hex
from shelfmark.operators import events, overlap, survivor
from shelfmark.plans import incremental, organise
from shelfmark.queries.pipeline import CLUSTERS, FOLDERS, HASHED, MEMBERS, RANKED, REDUNDANT, hashed, ranking
from shelfmark.queries.reports import LADDER_SQL, NAME, PARENT, STEM, exif_sql, sanitize_sql, today
from shelfmark.runtime import table
from shelfmark.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        names = fn.__code__.co_varnames[: fn.__code__.co_argcount]
        QUERIES[name] = lambda spark, sf_dir: fn(*(table(spark, sf_dir, n) for n in names))
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("f24_export_folders", f"with recursive {HASHED}, {RANKED}, {REDUNDANT} select file_id, root from derivative where root is not null")
def _(files, known_cameras):
    return files.select("file_id", naming.derivative_root(F.col("path")).alias("root")).where("root is not null")


@query("j11_export_copies", f"with recursive {HASHED}, {RANKED}, {REDUNDANT} select file_id, keeper from folder_rule")
def _(files, known_cameras):
    ranked = ranking(hashed(files), known_cameras)
    candidates = ranked.where(F.col("file_type").isin("CAMERA_JPEG", "DEV_JPEG", "HEIC") & (F.col("width") > 0) & (F.col("height") > 0))
    return survivor.derivative_copies(ranked, candidates)


@query("j09_same_shot_components", f"with recursive {HASHED}, {RANKED}, {REDUNDANT} select file_id, component from shot")
def _(files, known_cameras):
    from shelfmark.functions.naming import is_camera_name
    from shelfmark.operators.graph import connected_components
    from shelfmark.operators.pairs import junk_keys

    ranked = ranking(hashed(files), known_cameras)
    base = ranked.where(F.col("file_type").isin("CAMERA_JPEG", "DEV_JPEG", "HEIC") & (F.col("width") > 0) & (F.col("height") > 0) & F.col("datetime_original").isNotNull())
    copies = base.select("file_id", paths.norm_stem(F.col("filename")).alias("stem"), "datetime_original", "phash", "keep_rank", (F.col("width") / F.col("height")).alias("aspect"), is_camera_name(F.col("filename")).alias("camera_name"))
    links = survivor._shot_edges(copies).unionByName(survivor._content_edges(copies, junk_keys(ranked, "phash")))
    return connected_components(links, "a", "b", "file_id", "component")


@query("f29_event_ranges", rf"""with d as (select distinct {NAME.format(PARENT.format('target_path'))} as name from operations where target_path is not null),
p as (select name, try_cast(nullif(regexp_extract(name, '^(\d{{4}}-\d{{2}}-\d{{2}})(?:\((\d+)d\)|_(\d+)d)?', 1), '') as date) as lo,
 coalesce(try_cast(regexp_extract(name, '^(\d{{4}}-\d{{2}}-\d{{2}})(?:\((\d+)d\)|_(\d+)d)?', 2) as int), try_cast(regexp_extract(name, '^(\d{{4}}-\d{{2}}-\d{{2}})(?:\((\d+)d\)|_(\d+)d)?', 3) as int), 1) as n from d)
select name, lo, lo + (greatest(n, 1) - 1)::int as hi from p where lo is not null""")
def _(operations):
    names = operations.where("target_path is not null").select(paths.base_name(paths.parent(F.col("target_path"))).alias("name")).distinct()
    r = dates.folder_date_range(F.col("name"))
    return names.select("name", r["lo"].alias("lo"), r["hi"].alias("hi")).where("lo is not null")


@query("f33_duration_texts", """with s as (select distinct run_id, greatest(0, round(duration_seconds)::bigint) as s from command_runs where duration_seconds is not null)
select run_id, case when s >= 3600 then format('{}h {:02d}m {:02d}s', s // 3600, s % 3600 // 60, s % 60) when s >= 60 then format('{}m {:02d}s', s // 60, s % 60) else format('{}s', s) end as took from s""")
def _(command_runs):
    rows = command_runs.where("duration_seconds is not null").select("run_id", F.greatest(F.lit(0), F.round("duration_seconds").cast("long")).alias("s")).distinct()
    return rows.select("run_id", metadata.duration_text(F.col("s")).alias("took"))


@query("f35_degenerate", "select file_id from files where coalesce(width, 0) < 200 or coalesce(height, 0) < 200 or coalesce(size_bytes, 0) = 0")
def _(files):
    return files.where(survivor.is_degenerate(F.col("width"), F.col("height"), F.col("size_bytes"))).select("file_id")


@query("f40_hash_round_trip", "select distinct lower(trim(phash)) as phash, ('0x' || lower(trim(phash)))::ubigint >= 9223372036854775808 as negative from files where regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}')")
def _(files):
    keys = files.select(valid_hex(F.col("phash"), 16).alias("t")).where("t is not null").distinct().select(hex_to_long(F.col("t")).alias("k"))
    return keys.select(long_to_hex(F.col("k")).alias("phash"), (F.col("k") < 0).alias("negative"))


@query("f38_merged_overrides", "select source_folder, case when per_day_split <> 0 then nullif(trim(note), '') else event_name end as event_name from folder_overrides")
def _(folder_overrides):
    return folder_overrides.select("source_folder", sinks.merge_override(F.col("event_name"), F.col("note"), F.col("per_day_split") != 0).alias("event_name"))


@query("f34_date_candidates", f"""with {LADDER_SQL}, c as (select file_id, concat_ws(' ', 'EXIF=' || strftime(x, '%Y-%m-%d'), 'filename=' || strftime(n, '%Y-%m-%d'), 'digitized=' || strftime(d, '%Y-%m-%d'), 'mtime=' || strftime(m, '%Y-%m-%d')) as c from ladder
  where confidence = 'LOW' and status <> 'error' and file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC', 'VIDEO'))
select file_id, case when c = '' then 'no candidates' else c end as candidates from c""")
def _(files):
    return organise.audit_dates(files, today()).where("date_confidence = 'LOW'").select("file_id", "candidates")


@query("j16_effective_dates", f"""with {LADDER_SQL},
days as (select {PARENT.format('path')} as folder, x::date as day, count(*) as n from ladder where file_type <> 'VIDEO' and status <> 'error' and confidence in ('HIGH', 'MEDIUM') and x is not null group by 1, 2),
hints as (select folder, day as hint from (select *, row_number() over (partition by folder order by n desc, day) as r from days) where r = 1)
select l.file_id, coalesce({sanitize_sql('o.event_name')}, '') as ov_event, case when coalesce(l.confidence, 'LOW') = 'LOW' and try_cast(o.date_override as date) is not null then try_cast(o.date_override as timestamp)
  when coalesce(l.confidence, 'LOW') = 'LOW' and l.file_type = 'VIDEO' and hint is not null then hint::timestamp else dt end as eff
from ladder l left join folder_overrides o on o.source_folder = {PARENT.format('l.path')} left join hints h on h.folder = {PARENT.format('l.path')}""")
def _(files, folder_overrides):
    ladder = organise.date_ladder(files.drop("date_source", "date_confidence"), today())
    return organise.effective_dates(ladder, folder_overrides, events.sibling_hints(ladder)).select("file_id", "ov_event", "eff")


@query("a19_new_event_spans", f"""with {FOLDERS}, g as (select r.event_folder, min(r.event_name) as event_name, min({exif_sql('f.datetime_original')}::date) as start, max({exif_sql('f.datetime_original')}::date) as last
  from files f join resolved r on r.folder = {PARENT.format('f.path')} where r.event_folder is not null and f.status not in ('done', 'error') and f.file_id not in (select file_id from operations where status = 'done')
  and f.file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC') and {exif_sql('f.datetime_original')} is not null group by 1)
select event_folder, case when date_diff('day', start, last) + 1 > 30 then 'subject' else 'event' end as kind, start, last, date_diff('day', start, last) + 1 as span, {sanitize_sql('event_name')} as label from g where start <> last""")
def _(files, operations, scan_roots):
    new = incremental.new_files(files, operations).where(F.col("file_type").isin(*PHOTO_TYPES))
    dated = new.select(paths.parent(F.col("path")).alias("folder"), dates.metadata_datetime(F.col("datetime_original")).cast("date").alias("day"))
    return events.span_groups(dated.join(events.resolve_folders(files, scan_roots), "folder"))


@query("a25_ubiquitous_items", f"with {HASHED}, {MEMBERS} select sha256, count(*) as folders from members group by 1 having count(*) > 30")
def _(files, scan_roots):
    members = overlap.subtree_members(hashed(files).where("status <> 'error'"), scan_roots)
    return members.groupBy("sha256").agg(F.count("*").alias("folders")).where("folders > 30")


@query("a37_groups_by_mother", f"""with f as (select {PARENT.format('path')} as folder, count(*) filter (where date_confidence is null or date_confidence = 'LOW') as low from files where status <> 'error' group by 1)
select coalesce({PARENT.format('folder')}, '') as mother, count(*) as folders, count(*) filter (where low > 0) as pending from f group by 1""")
def _(files):
    low = F.count_if(F.col("date_confidence").isNull() | (F.col("date_confidence") == "LOW"))
    by = files.where("status <> 'error'").groupBy(paths.parent(F.col("path")).alias("folder")).agg(low.alias("low"))
    return by.groupBy(F.coalesce(paths.parent(F.col("folder")), F.lit("")).alias("mother")).agg(F.count("*").alias("folders"), F.count_if(F.col("low") > 0).alias("pending"))


@query("a39_remaining_operations", "select op_type, count(distinct op_id) filter (where status in ('planned', 'confirmed')) as remaining, count(distinct op_id) filter (where status = 'done') as done, count(distinct op_id) filter (where status in ('error', 'skipped')) as failed from operations group by 1")
def _(operations):
    ops = operations.select("op_id", "op_type", "status").distinct()
    has = lambda *s: F.count_if(F.col("status").isin(*s))
    return ops.groupBy("op_type").agg(has("planned", "confirmed").alias("remaining"), has("done").alias("done"), has("error", "skipped").alias("failed"))


@query("k01_new_paths", "select source_path as path, min(op_id) as op_id from operations where source_path not in (select path from files) group by 1")
def _(operations, files):
    new = operations.select(F.col("source_path").alias("path"), "op_id")
    return sinks.insert_new(files.select("path"), new, "path").where("path is not null")


@query("x28_default_selection", f"""with recursive {HASHED}, {RANKED}, {REDUNDANT}, {CLUSTERS},
m as (select cl.cluster_id, r.*, lower(trim({STEM.format('r.filename')})) as stem from cl join ranked r using (file_id)),
s as (select *, coalesce(size_bytes < 0.55 * max(size_bytes) over (partition by cluster_id), false) as soft from m),
w as (select *, min(stem) over (partition by cluster_id) = max(stem) over (partition by cluster_id) as one, bool_and(soft) over (partition by cluster_id) as all_soft,
  row_number() over (partition by cluster_id order by area desc, size0 desc, own desc, event desc, len, file_id) = 1 as best from s)
select file_id, cluster_id, case when one then best else not soft or all_soft end as keep from w""")
def _(files, duplicates, known_cameras):
    # the size stands in for a sharpness score, which the tables do not hold
    ranked = ranking(hashed(files), known_cameras)
    clusters = survivor.near_clusters(ranked, duplicates, ranked, survivor.redundant_copies(ranked, ranked))
    return survivor.default_selection(clusters, ranked, files.select("file_id", F.col("size_bytes").cast("double").alias("sharpness")))
