"""Queries of scans, filters, profile aggregates and scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import dates, metadata, naming, paths
from shelfmark.functions.classify import ALL_TYPES, classify, is_supported
from shelfmark.operators import ledger, reports
from shelfmark.sources import readers, sinks
from shelfmark.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Parts of SQL that several queries share.
PARENT = r"nullif(regexp_extract({0}, '^(.*)[\\/][^\\/]*$', 1, 's'), '')"
NAME = r"regexp_extract({0}, '([^\\/]*)$', 1)"
STEM = r"regexp_replace({0}, '([^.])\.[^.]*$', '\1')"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the tables it names as parameters."""

    def add(fn: Callable) -> Callable:
        names = fn.__code__.co_varnames[: fn.__code__.co_argcount]
        QUERIES[name] = lambda spark, sf_dir: fn(*(table(spark, sf_dir, n) for n in names))
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("a01_status_type_counts", "select status, file_type, count(*) as n from files group by 1, 2")
def _(files):
    return files.groupBy("status", "file_type").agg(F.count("*").alias("n"))


@query("a02_camera_counts", "select coalesce(m, 'Unknown') as camera, n from (select camera_model as m, count(*) as n from files group by 1)")
def _(files):
    return reports.camera_counts(files)


@query("a03_date_bounds", "select min(datetime_original) as first_date, max(datetime_original) as last_date, count(*) filter (where datetime_original is null) as no_date, count(*) filter (where rating is not null or keywords is not null) as with_metadata from files")
def _(files):
    return reports.date_bounds(files)


@query("a05_ratings", "select rating, count(*) as n from files group by 1")
def _(files):
    return reports.counts(files, "rating")


@query("a06_top_keywords", """select keyword, count(*) as n from (
  select unnest(from_json(keywords, '["varchar"]')) as keyword from files where keywords is not null and json_valid(keywords)
) where keyword is not null group by 1 order by n desc, keyword limit 20""")
def _(files):
    return reports.top_keywords(files)


@query("a07_resolution_buckets", "select count(*) filter (where width > 4000) as high, count(*) filter (where width between 1000 and 4000) as medium, count(*) filter (where width > 0 and width < 1000) as low from files where file_type <> 'RAW'")
def _(files):
    return reports.resolution_buckets(files)


@query("a08_command_timings", """with once as (select distinct on (run_id) * from command_runs order by run_id, finished_at desc nulls last)
select command, count(*) as runs, avg(duration_seconds) as avg_s, min(duration_seconds) as min_s, max(duration_seconds) as max_s,
  arg_max(duration_seconds, (finished_at, run_id)) as last_s, arg_max(status, (finished_at, run_id)) as last_status, max(finished_at) as last_at
from once group by 1""")
def _(command_runs):
    return reports.command_timings(command_runs)


@query("a09_video_totals", "select count(*) as videos, coalesce(sum(duration_seconds), 0) as seconds from files where file_type = 'VIDEO'")
def _(files):
    return reports.video_totals(files)


@query("a09_top_software", "select coalesce(software, 'unknown') as value, count(*) as n from files group by 1 order by n desc, value limit 10")
def _(files):
    return reports.top_k(files, "software")


_TYPES = ", ".join(f"('{t}')" for t in ALL_TYPES)


@query("a10_type_breakdown", f"""with every(file_type) as (values {_TYPES}), n as (select file_type, count(*) as files from files group by 1), total as (select count(*) as n from files)
select e.file_type, coalesce(n.files, 0) as files, coalesce(n.files, 0) / total.n::double as share from every e left join n using (file_type), total
union all select 'TOTAL', n, 1.0 from total""")
def _(files):
    return reports.type_breakdown(files)


@query("a11_unknown_cameras", f"""with r as (
  select coalesce(file_type, '?') as type, coalesce(substr(datetime_original, 1, 4), 'no date') as year, coalesce(camera_make, 'no make') as make,
    coalesce(software, 'no software') as software, coalesce({PARENT.format('path')}, '') as folder
  from files where coalesce(camera_model, '') = ''
), flat as (
  select 'type' as dimension, type as value, count(*) as n from r group by 2 union all
  select 'year', year, count(*) from r group by 2 union all select 'make', make, count(*) from r group by 2 union all
  select 'software', software, count(*) from r group by 2 union all select 'folder', folder, count(*) from r group by 2
), ranked as (
  select *, row_number() over (partition by dimension order by n desc, value) as rank, count(*) over (partition by dimension) as k from flat
)
select dimension, value, n, rank, greatest(0, k - 20) as others from ranked where rank <= 20""")
def _(files):
    return reports.unknown_camera_profile(files)


@query("a33_operation_summary", "select op_type, o.status, count(*) as n, coalesce(sum(f.size_bytes), 0)::bigint as bytes from (select distinct op_id, file_id, op_type, status from operations) o join files f using (file_id) group by 1, 2")
def _(operations, files):
    ops = operations.select("op_id", "file_id", "op_type", "status").distinct()
    return ops.join(files.select("file_id", "size_bytes"), "file_id").groupBy("op_type", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query("p04_filtered_files", "select file_id, path from files where substr(datetime_original, 1, 4) = '2019' and lower(camera_model) like '%corvia%' and file_type = 'CAMERA_JPEG' and status <> 'error'")
def _(files):
    rows = readers.select_files(files, ("CAMERA_JPEG",)).where("status <> 'error'")
    return rows.where((F.substring("datetime_original", 1, 4) == "2019") & F.lower("camera_model").contains("corvia")).select("file_id", "path")


@query("p05_junk_hashes", "select phash, count(*) as n from files where phash is not null group by 1 having count(*) >= 8")
def _(files):
    from shelfmark.operators.pairs import junk_keys

    return junk_keys(files, "phash")


@query("s02_supported_extensions", r"""select extension, count(*) as n, count(*) filter (where lower(regexp_extract(path, '[^.\\/]\.([^.\\/]*)$', 1)) in
 ('arw','srf','sr2','cr3','cr2','crw','nef','nrw','raf','rw2','rwl','orf','pef','dng','srw','x3f','iiq','3fr','fff','jpg','jpeg','mp4','mov','m4v','avi','mkv','wmv','flv','webm','mts','m2ts','3gp','3g2','mpg','mpeg','tif','tiff','heic','heif','png','webp')) as supported
from files group by 1""")
def _(files):
    return files.groupBy("extension").agg(F.count("*").alias("n"), F.count_if(is_supported(F.col("path"))).alias("supported"))


@query("s06_unseen_sources", "select distinct source_path as path from operations where source_path not in (select path from files where status <> 'error')")
def _(operations, files):
    return readers.unseen(operations.select(F.col("source_path").alias("path")).distinct(), files)


@query("s09_sample_per_root")
def _(files, scan_roots):
    from shelfmark.functions.timestamps import with_root_zone

    rooted = with_root_zone(files.select("file_id", "path", "file_type"), scan_roots, out="root_zone")
    return reports.sampled(rooted, F.col("root_zone"), 50)


@query("s12_preflight_profile", f"""select {NAME.format(PARENT.format('path'))} as folder, count(*) as files, count(distinct file_type) as types, min(datetime_original) as first_date, max(datetime_original) as last_date, count(*) filter (where status = 'error') as errors from files group by 1""")
def _(files):
    folder = paths.base_name(paths.parent(F.col("path")))
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.count_distinct("file_type").alias("types"), F.min("datetime_original").alias("first_date"), F.max("datetime_original").alias("last_date"), F.count_if(F.col("status") == "error").alias("errors"))


@query("s13_own_cameras", "select distinct lower(model) as own_model from known_cameras where owner = 'self' and model is not null")
def _(known_cameras):
    from shelfmark.operators.survivor import own_cameras

    return own_cameras(known_cameras)


@query("k02_latest_operations", "select distinct on (op_id) op_id, file_id, op_type, status, planned_at, executed_at from operations order by op_id, executed_at desc nulls last, planned_at desc, status desc")
def _(operations):
    rows = operations.select("op_id", "file_id", "op_type", "status", "planned_at", "executed_at")
    return ledger.latest(rows, "op_id", "executed_at", "planned_at", "status")


@query("k03_patched_files", """select f.file_id, case when o.file_id is not null then 'done' else f.status end as status from files f
left join (select distinct file_id from operations where status = 'done' and op_type = 'MOVE') o using (file_id)""")
def _(files, operations):
    moved = operations.where("status = 'done' and op_type = 'MOVE'").select("file_id").distinct().withColumn("status", F.lit("done"))
    return sinks.patch(files.select("file_id", "status"), moved, "file_id")


@query("k06_upsert_overrides", "select source_folder, event_name from folder_overrides where per_day_split = 0 union all select source_folder, 'split' from folder_overrides where per_day_split <> 0")
def _(folder_overrides):
    change = folder_overrides.where("per_day_split <> 0").select("source_folder", F.lit("split").alias("event_name"))
    return sinks.upsert(folder_overrides.select("source_folder", "event_name"), change, "source_folder")


@query("k17_new_cameras", """select make, model, 'other' as owner from (select distinct camera_make as make, camera_model as model from files where camera_make is not null and camera_model is not null) c
where not exists (select 1 from known_cameras k where k.make = c.make and k.model = c.model)""")
def _(files, known_cameras):
    seen = files.where("camera_make is not null and camera_model is not null").select(F.col("camera_make").alias("make"), F.col("camera_model").alias("model"), F.lit("other").alias("owner")).distinct()
    return sinks.insert_new(known_cameras, seen, "make", "model")


_CLASS_SQL = r"""
lower(regexp_extract(path, '[^.\\/]\.([^.\\/]*)$', 1)) as ext, lower(coalesce(software, '')) as sw, string_split_regex(lower(path), '[\\/]') as parts
"""
_DEV = " or ".join(f"sw like '%{w}%'" for w in ("lightroom", "camera raw", "capture one", "captureone", "darktable", "aperture", "photoshop", "dxo", "photolab", "luminar", "on1", "rawtherapee", "affinity", "silkypix", "capture nx", "nx studio", "raw power", "exposure x", "acdsee", "gimp", "pixelmator"))
_CLASS = f"""case when ext in ('arw','srf','sr2','cr3','cr2','crw','nef','nrw','raf','rw2','rwl','orf','pef','dng','srw','x3f','iiq','3fr','fff') then 'RAW'
 when ext in ('mp4','mov','m4v','avi','mkv','wmv','flv','webm','mts','m2ts','3gp','3g2','mpg','mpeg') then 'VIDEO' when ext in ('heic','heif') then 'HEIC'
 when ext not in ('jpg','jpeg') then 'UNKNOWN'
 when list_has_any(parts[:len(parts)-1], ['resize','resized','thumb','thumbs','thumbnail','thumbnails']) then 'RESIZED_JPEG'
 when {_DEV} then 'DEV_JPEG' else 'CAMERA_JPEG' end"""


@query("f01_classify", f"select file_id, {_CLASS} as new_type from (select file_id, {_CLASS_SQL} from files)")
def _(files):
    return files.select("file_id", classify(F.col("path"), F.col("software")).alias("new_type"))


_EXP = " or ".join(f"sw like '%{w}%'" for w in ("lightroom", "aperture", "capture one", "darktable", "photos", "google photos", "flickr", "squarespace", "wordpress", "whatsapp", "line", "telegram"))
_SHARE = ", ".join(f"'{w}'" for w in ("export", "exports", "share", "shared", "sharing", "web", "websize", "web_size", "small", "preview", "previews", "instagram", "ig", "blog", "send", "sent", "proof", "proofs"))


@query("a34_reclassified", rf"""with r as (select file_type, width, path, {_CLASS_SQL} from files where file_type in ('CAMERA_JPEG', 'DEV_JPEG')),
s as (select file_type, {_CLASS} as base,
  case when list_has_any(parts, [{_SHARE}]) then 2 else 0 end
  + case when regexp_matches({STEM.format(NAME.format('lower(path)'))}, '(_sm|_small|_web|_w|_thumb|_tn|_\d{{3,4}}px|-resized|_export|_share|_ig|_blog)$') then 2 else 0 end
  + case when width > 0 and width < 2500 then 1 else 0 end + case when {_EXP} then 1 else 0 end as score from r),
t as (select file_type as old_type, case when base in ('DEV_JPEG', 'CAMERA_JPEG') then case when score >= 2 then 'RESIZED_JPEG' when score = 1 then 'UNKNOWN' else base end else base end as new_type from s)
select old_type, new_type, count(*) as n from t where old_type <> new_type group by 1, 2""")
def _(files):
    return reports.reclassified(files)


@query("f02_metadata_fields", """select file_id, case when datetime_original not in ('', '0000:00:00 00:00:00') then datetime_original end as captured, iso,
 case when rating is not null then least(5, greatest(0, rating)) end as rating, nullif(trim(software), '') as description,
 case when gps_lat is not null and gps_lon is not null then gps_lat end as lat, coalesce(nullif(width, 0), 0) as width from files""")
def _(files):
    tag = lambda n, c: (F.lit(n), F.col(c).cast("string"))
    tags = F.create_map(*tag("DateTimeOriginal", "datetime_original"), *tag("ISO", "iso"), *tag("Rating", "rating"), *tag("Description", "software"), *tag("GPSLatitude", "gps_lat"), *tag("GPSLongitude", "gps_lon"), *tag("ImageWidth", "width"))
    t = F.col("tags")
    return files.select("file_id", tags.alias("tags")).select("file_id", metadata.capture_date(t).alias("captured"), metadata.iso(t).alias("iso"), metadata.rating(t).alias("rating"), metadata.description(t).alias("description"), metadata.gps(t)["lat"].alias("lat"), metadata.dimensions(t)["width"].alias("width"))


def _stamp(*groups: str) -> str:
    """SQL that makes a timestamp of six texts or null."""
    y, mo, d, h, mi, s = groups
    return f"try_strptime(format('{{:04d}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', try_cast({y} as int), try_cast({mo} as int), try_cast({d} as int), coalesce(try_cast({h} as int), 0), coalesce(try_cast({mi} as int), 0), coalesce(try_cast({s} as int), 0)), '%Y-%m-%d %H:%M:%S')"


def exif_sql(col: str) -> str:
    raw = rf"trim(regexp_replace(trim({col}), '(?:Z|[+-]\d{{2}}:?\d{{2}})$', ''))"
    out = []
    for p in (r"^(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{1,2}):(\d{1,2})$"):
        g = [f"regexp_extract({raw}, '{p}', {i})" for i in range(1, 7)]
        out.append(f"case when regexp_matches({raw}, '{p}') then {_stamp(*g)} end")
    return f"coalesce({', '.join(out)})"


def filename_sql(col: str) -> str:
    s = STEM.format(col)
    out = []
    for i, p in enumerate(dates.FILENAME_PATTERNS):
        p = p.replace(r"(?!\d)", r"(?:\D|$)").replace(r"(?![-_T]\d{6})", r"(?:$|[^-_T]|[-_T]\d{0,5}(?:\D|$))")
        six = i in dates.TIMED
        g = [f"regexp_extract({s}, '{p}', {k})" for k in range(1, 7 if six else 4)] + ([] if six else ["'0'"] * 3)
        out.append(f"case when regexp_matches({s}, '{p}') then {_stamp(*g)} end")
    return f"coalesce({', '.join(out)})"


MTIME_SQL = r"""case when regexp_matches(mtime, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$') then
 case when regexp_matches(mtime, '[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$') then (replace(mtime, 'Z', '+00:00')::timestamptz at time zone 'UTC') else try_cast(mtime as timestamp) end end"""

_SANE = "coalesce(year({0}) >= 1990 and {0}::date <= date '2026-01-01' and {0}::date not in (date '1980-01-01', date '2000-01-01'), false)"
LADDER_SQL = f"""
parsed as (
  select file_id, path, filename, file_type, status, camera_model, {exif_sql('datetime_original')} as x, {filename_sql('filename')} as n, {exif_sql('datetime_digitized')} as d, {MTIME_SQL} as m from files
),
sane as (select *, {_SANE.format('x')} as xs, {_SANE.format('n')} as ns, {_SANE.format('d')} as ds, abs(date_diff('day', x::date, n::date)) as gap from parsed),
rated as (
  select *, case when xs and coalesce(camera_model, '') <> '' then 1 when xs and ns and gap <= 1 then 2 when xs and ns and gap > 2 then 3 when not xs and ns then 4 when xs then 5 when ds then 6 when m is not null then 7 else 8 end as k from sane
),
ladder as (
  select *, case when k in (1, 2, 5) then x when k in (3, 4) then n when k = 6 then d when k = 7 then m end as dt,
    case when k in (1, 2, 5) then 'exif_original' when k in (3, 4) then 'filename' when k = 6 then 'exif_digitized' when k = 7 then 'mtime' else 'none' end as source,
    case when k in (1, 2) then 'HIGH' when k in (5, 6) or k = 4 and file_type = 'VIDEO' then 'MEDIUM' when k in (3, 4, 7) then 'LOW' end as confidence
  from rated
)
"""
def today():
    return F.to_date(F.lit("2026-01-01"))



@query("f14_date_ladder", f"with {LADDER_SQL} select file_id, dt::timestamp as dt, source as date_source, confidence as date_confidence from ladder where status <> 'error' and file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC', 'VIDEO')")
def _(files):
    from shelfmark.plans.organise import audit_dates

    return audit_dates(files, today()).drop("candidates")


@query("a31_date_confidence", f"with {LADDER_SQL} select source as date_source, confidence as date_confidence, count(*) as n from ladder where status <> 'error' and file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC', 'VIDEO') group by 1, 2")
def _(files):
    from shelfmark.plans.organise import audit_dates

    return reports.confidence_counts(audit_dates(files, today()))


@query("f12_filename_dates", f"select file_id, {filename_sql('filename')} as named from files")
def _(files):
    return files.select("file_id", dates.filename_datetime(F.col("filename")).alias("named"))


def sanitize_sql(x: str) -> str:
    """The label of a folder name; RE2 has no lookahead, so what follows a date is captured and put back."""
    s = rf"regexp_replace(regexp_replace({x}, '^\d{{8}}[~&]\d{{1,2}}(\D.*|)$', '\1', 's'), '^\d{{4}}-\d{{2}}-\d{{2}}[~&]\d{{1,2}}(\D.*|)$', '\1', 's')"
    s = rf"trim(regexp_replace({s}, '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_')"
    for _ in range(4):
        s = rf"trim(regexp_replace({s}, '^(?:\d{{8}}(?:_\d{{6}})?|\d{{4}}_\d{{4}}|\d{{4}}(?:_\d{{2}}){{1,2}}|\d{{4}})(?:_?\d{{1,2}}d)?(_.*|[^\x00-\x7f].*|)$', '\1', 's'), '_')"
    return rf"case when {x} is null or regexp_matches({x}, '^[A-Za-z]:[\\/]?$') then '' else left({s}, 40) end"


def unorganised_sql(x: str) -> str:
    n = f"trim(coalesce({x}, ''))"
    tests = (r"^[A-Za-z]:[\\/]?$", r"^\d{4}([-_.]?\d{1,2}){0,2}$", r"^\d{8}([-_]?\d{6})?$", r"^\d+$", r"(?i)^\d{3}[-_]?[a-z0-9]{2,6}(?:[._](?:done|old|bak|copy))?$", r"(?i)^dcim$", r"(?i)^(img|dsc|dscf|p|pic|photo|mvi|gopr)[-_]?\d{3,}$")
    return f"({n} = '' or " + " or ".join(f"regexp_matches({n}, '{t}')" for t in tests) + ")"


def container_sql(x: str) -> str:
    n = rf"lower(trim(regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_'))"
    names = ", ".join(f"'{c}'" for c in naming.CONTAINERS)
    return rf"({n} = '' or {n} in ({names}) or {n} like '%手機%' or {n} like '%ipad%' or {n} like '%iphone%' or regexp_matches({n}, '^dcim|^temp(\d+|_\d+)?$|已燒錄|^\d{{6}}$|^v\d+_|(?:_|^)[tf]x\d'))"


@query("f17_folder_labels", f"""with names as (select distinct {NAME.format(PARENT.format('path'))} as name from files)
select name, {sanitize_sql('name')} as label, {unorganised_sql('name')} as unorganised, {container_sql('name')} as container from names""")
def _(files):
    names = files.select(paths.base_name(paths.parent(F.col("path"))).alias("name")).distinct()
    n = F.col("name")
    return names.select("name", naming.sanitize_event(n).alias("label"), naming.is_unorganised(n).alias("unorganised"), naming.is_container(n).alias("container"))


@query("f22_camera_names", rf"""select file_id, lower(trim({STEM.format('filename')})) as stem, regexp_matches(trim({STEM.format('filename')}), '(?i)^(?:img|_mg|dsc|dscf|dscn|pict?|photo|mvi|gopr|pano|cimg|hpim|sdc|dji)[-_]?\d{{3,}}$') as camera_name from files""")
def _(files):
    return files.select("file_id", paths.norm_stem(F.col("filename")).alias("stem"), naming.is_camera_name(F.col("filename")).alias("camera_name"))


_MARKS = " + ".join(f"(contains(low, '{m}'))::int" for m in naming.NONCANONICAL)


@query("f26_backup_marks", f"with f as (select distinct {PARENT.format('path')} as folder from files), l as (select folder, lower(folder) as low from f) select folder, {_MARKS} as marks from l where folder is not null")
def _(files):
    folders = files.select(paths.parent(F.col("path")).alias("folder")).where("folder is not null").distinct()
    return folders.select("folder", naming.noncanonical_score(F.col("folder")).alias("marks"))


_EVENT_PART = r"'^\d{4}-\d{2}-\d{2}(?:\(\d{1,2}d\))?\s+(.+)$'"


@query("f30_target_labels", rf"""with p as (select op_id, target_path, string_split_regex(target_path, '[\\/]+') as parts from (select distinct op_id, target_path from operations where target_path is not null)),
l as (select op_id, parts, list_filter(parts, lambda x: regexp_matches(x, {_EVENT_PART}))[1] as part, list_filter(range(1, len(parts) - 1), lambda i: lower(parts[i]) in ('masters', 'others'))[1] as spot from p)
select op_id, nullif(regexp_extract(part, {_EVENT_PART}, 1), '') as label, lower(parts[spot]) as base, parts[spot + 2] as event from l""")
def _(operations):
    base, event = naming.base_and_event(F.col("target_path"))
    return operations.where("target_path is not null").select("op_id", "target_path").distinct().select("op_id", naming.event_label(F.col("target_path")).alias("label"), base.alias("base"), event.alias("event"))


@query("f31_scope_rebase", r"""select file_id, path as old_path, 'E:\Moved' || substr(path, length('D:\Raw') + 1) as new_path from files where status = 'done' and (path = 'D:\Raw' or starts_with(path, 'D:\Raw\') or starts_with(path, 'D:\Raw/'))""")
def _(files):
    return ledger.move_folder(files, "D:\\Raw", "E:\\Moved")


@query("a32_no_event_folders", f"with f as (select {PARENT.format('path')} as folder from files where status <> 'error') select folder, count(*) as files from f where {unorganised_sql(NAME.format('folder'))} group by 1")
def _(files):
    from shelfmark.plans.organise import no_event_folders

    return no_event_folders(files)


@query("k11_folder_report", f"""with f as (select {PARENT.format('path')} as folder, count(*) as files from files where status <> 'error' group by 1)
select coalesce({PARENT.format('folder')}, '') as mother, sum(files)::bigint as total, count(*) as folders, max(files) as largest from f group by 1""")
def _(files):
    counts = files.where("status <> 'error'").groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("files"))
    return reports.folder_report(counts).select("mother", "total", F.size("children").cast("long").alias("folders"), F.col("children")[0]["files"].alias("largest"))


@query("s16_common_root")
def _(files):
    return ledger.common_root(files.where("status = 'done'"))
