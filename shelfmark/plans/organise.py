"""The full plan: every file moves, is staged, or stays, as one DataFrame.

Staging reasons are separate frames that are united; the last reason in the
order of PRIORITY holds. A safety net keeps one byte-identical copy of each
content. Nothing runs until the result is read, but for the iterative groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import dates, naming
from shelfmark.functions.classify import DATED_TYPES
from shelfmark.functions.paths import base_name, parent
from shelfmark.operators import events, overlap, survivor
from shelfmark.runtime import number_rows, spread, write_scratch

#: Later reasons replace earlier ones.
PRIORITY = ("resized_jpeg", "exact_dupe", "near_dupe", "redundant_copy", "folder_merge_loser")
#: Reasons whose content survives in a different, better file.
CONTENT_SAFE = ("resized_jpeg", "redundant_copy")
# Folders of the staging area.
STAGE_FOLDERS = {"resized_jpeg": "resized_jpeg", "exact_dupe": "exact_dupe", "near_dupe": "near_dupe", "redundant_copy": "redundant_copy", "folder_merge_loser": "folder_merge"}


def date_ladder(files: DataFrame, today: Column, zone: str = "UTC") -> DataFrame:
    """``files`` with dt (wall clock), date_source and date_confidence chosen anew, and ``candidates``."""
    exif, name = dates.metadata_datetime(F.col("datetime_original")), dates.filename_datetime(F.col("filename"))
    digitized, modified = dates.metadata_datetime(F.col("datetime_digitized")), dates.modified_datetime(F.col("mtime"), zone)
    # the parsed signals are referred to many times: a generator between keeps them from being computed for each use
    parsed = files.select("*", F.inline(F.array(F.struct(exif.alias("_exif"), name.alias("_name"), digitized.alias("_digit"), modified.alias("_mod")))))
    choice = dates.resolve_date(F.col("_exif"), F.col("_name"), F.col("_digit"), F.col("_mod"), F.col("camera_model"), F.col("file_type"), today)
    rated = parsed.withColumn("_c", choice).withColumns({"dt": F.col("_c.dt"), "date_source": F.col("_c.source"), "date_confidence": F.col("_c.confidence"), "candidates": dates.candidates_text(F.col("_exif"), F.col("_name"), F.col("_digit"), F.col("_mod"))})
    return rated.drop("_exif", "_name", "_digit", "_mod", "_c")


def audit_dates(files: DataFrame, today: Column, zone: str = "UTC") -> DataFrame:
    """(file_id, dt, date_source, date_confidence, candidates) of the dated types that are not in error."""
    rows = files.where(F.col("file_type").isin(*DATED_TYPES) & (F.col("status") != "error"))
    return date_ladder(spread(rows), today, zone).select("file_id", "dt", "date_source", "date_confidence", "candidates")


def staging_reasons(files: DataFrame, duplicates: DataFrame, ranked: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """(file_id, reason, dupe_of, priority): all reasons, before any is chosen."""
    found = {
        "resized_jpeg": files.where("file_type = 'RESIZED_JPEG'").select("file_id", F.lit(None).cast("long").alias("keeper")),
        "exact_dupe": survivor.exact_losers(duplicates, ranked),
        "near_dupe": survivor.near_losers(duplicates),
        "redundant_copy": survivor.redundant_copies(files, ranked),
    }
    if overlaps is not None:
        found["folder_merge_loser"] = overlap.merge_losers(files, overlaps)[0]
    frames = [df.select("file_id", F.lit(r).alias("reason"), F.col("keeper").alias("dupe_of"), F.lit(PRIORITY.index(r)).alias("priority")) for r, df in found.items()]
    return reduce(DataFrame.unionByName, frames)


def stage(files: DataFrame, reasons: DataFrame, ranked: DataFrame) -> DataFrame:
    """(file_id, stage_reason, dupe_of_file_id) after the safety net: if all
    files of one sha256 whose bytes matter are staged, the best of them is not."""
    chosen = reasons.groupBy("file_id").agg(F.max_by(F.struct("reason", "dupe_of"), "priority").alias("x"), F.bool_or(F.col("reason").isin(*CONTENT_SAFE)).alias("safe"))
    chosen = chosen.select("file_id", F.col("x.reason").alias("stage_reason"), F.col("x.dupe_of").alias("dupe_of_file_id"), "safe")
    rows = ranked.where("sha256 is not null").select("file_id", "sha256", "keep_rank").join(chosen.select("file_id", "safe", F.lit(True).alias("staged")), "file_id", "left")
    relevant = rows.where(~F.coalesce("safe", F.lit(False)))
    rescue = relevant.groupBy("sha256").agg(F.bool_and(F.coalesce("staged", F.lit(False))).alias("all"), F.max("keep_rank").alias("r")).where(F.col("all")).select((-F.col("r.first")).alias("file_id"))
    return chosen.drop("safe").join(rescue, "file_id", "left_anti")


def effective_dates(rated: DataFrame, overrides: DataFrame, hints: DataFrame) -> DataFrame:
    """Add ``folder``, ``eff`` (the date used for filing), ``ov_event`` and
    ``used_mtime``. Only LOW or missing confidence is replaced: by the override
    of the folder, else for videos by the sibling day."""
    ov = overrides.select(F.col("source_folder").alias("folder"), dates.override_date(F.col("date_override")).alias("_od"), naming.sanitize_event(F.col("event_name")).alias("ov_event"))
    rows = rated.withColumn("folder", parent(F.col("path"))).join(ov, "folder", "left").join(hints, "folder", "left")
    weak = F.col("date_confidence").isNull() | (F.col("date_confidence") == "LOW")
    eff = F.when(weak & F.col("_od").isNotNull(), F.col("_od")).when(weak & (F.col("file_type") == "VIDEO") & F.col("hint").isNotNull(), F.col("hint").cast("timestamp_ntz")).otherwise(F.col("dt"))
    used = (F.col("date_source") == "mtime") & ~(weak & (F.col("_od").isNotNull() | ((F.col("file_type") == "VIDEO") & F.col("hint").isNotNull())))
    return rows.withColumns({"eff": eff, "used_mtime": used, "ov_event": F.coalesce("ov_event", F.lit(""))}).drop("_od", "hint")


def target_folder(base: Column, eff: Column, event: Column, kind: Column, start: Column, span: Column, label: Column, ov_event: Column, per_day: Column) -> Column:
    """The folder of a dated file below the target root, "/"-separated."""
    day = F.date_format(eff, "yyyy-MM-dd")
    spaced = lambda stamp: F.when(event != "", F.concat_ws(" ", stamp, event)).otherwise(stamp)
    subject = F.concat_ws("/", base, F.coalesce(F.nullif(ov_event, F.lit("")), F.nullif(label, F.lit("")), event), F.date_format(eff, "yyyy"))
    multi = F.concat_ws("/", base, F.date_format(start, "yyyy"), spaced(F.format_string("%s(%dd)", F.date_format(start, "yyyy-MM-dd"), span)))
    multi = F.when(per_day, F.concat_ws("/", multi, F.date_format(eff, "MMdd"))).otherwise(multi)
    return F.when(kind == "subject", subject).when(kind == "event", multi).otherwise(F.concat_ws("/", base, F.date_format(eff, "yyyy"), spaced(day)))


def build_targets(rows: DataFrame, folders: DataFrame, groups: DataFrame, bases: DataFrame, overrides: DataFrame, own: DataFrame, target: str) -> DataFrame:
    """(file_id, target_path) of rows that move (with folder, eff, ov_event).

    Photos keep their names; videos go into the Videos folder of their event and
    are numbered from 0 in the order of file_id within folder and day.
    """
    split = overrides.where("per_day_split <> 0").select(F.col("source_folder").alias("event_folder")).distinct().withColumn("per_day", F.lit(True))
    known = own.where("own_model <> ''").withColumn("_own", F.lit(True))
    joined = (
        rows.join(folders, "folder", "left").join(groups, "event_folder", "left").join(bases, "event_folder", "left").join(split, "event_folder", "left")
        .withColumn("own_model", F.lower("camera_model")).join(known, "own_model", "left")
    )
    video = F.col("file_type") == "VIDEO"
    camera_base = F.when(F.col("_own"), "Masters").otherwise("Others")
    base = F.when(video & F.col("event_folder").isNotNull(), F.coalesce("base", F.lit("Others"))).otherwise(camera_base)
    event = F.coalesce(F.nullif("ov_event", F.lit("")), F.when(F.col("kind") == "event", F.col("label")).otherwise(F.coalesce("event_label", F.lit(""))))
    sub = target_folder(base, F.col("eff"), event, F.col("kind"), F.col("start"), F.col("span"), F.col("label"), F.col("ov_event"), F.coalesce("per_day", F.lit(False)))
    sub = F.when(F.col("eff").isNull(), F.when(video, "Videos/NoDate").otherwise("NoDate")).when(video, F.concat_ws("/", sub, F.lit("Videos"))).otherwise(sub)
    placed = joined.select("file_id", "filename", "extension", video.alias("video"), sub.alias("sub"), F.when(F.col("eff").isNull(), "video").otherwise(F.date_format("eff", "yyyy-MM-dd")).alias("day"))
    # undated videos share one folder, so the numbers are counted over ranges
    videos = number_rows(placed.where("video").withColumn("place", F.concat_ws("\0", "sub", "day")), "n", "file_id", group="place")
    videos = videos.withColumn("name", F.format_string("%s_%04d.%s", "day", F.col("n") - 1, F.upper(F.coalesce(F.nullif("extension", F.lit("")), F.lit("jpg")))))
    named = videos.select("file_id", "sub", "name").unionByName(placed.where("not video").select("file_id", "sub", F.col("filename").alias("name")))
    return named.select("file_id", F.concat_ws("/", F.lit(target), "sub", "name").alias("target_path"))


def plan(files: DataFrame, duplicates: DataFrame, overrides: DataFrame, cameras: DataFrame, roots: DataFrame | None, today: Column, target: str = "Library", overlaps: DataFrame | None = None, include_done: bool = False, zone: str = "UTC") -> DataFrame:
    """(file_id, op_type, source_path, target_path, stage_reason, dupe_of_file_id).

    One row for each file that is staged or moves; files in error, unknown files
    that are not staged and, unless ``include_done``, files that are done have
    none. Empty tables give an empty plan.
    """
    # frames that several stages read are written once, which also keeps the plan small
    unread = ("error_msg", "keywords", "updated_at", "scanned_at", "rating", "software", "gps_lat", "gps_lon", "iso", "duration_seconds", "date_source", "date_confidence")
    files = files.select(*[c for c in files.columns if c not in unread])  # what no step reads is not written either
    ranked, _ = write_scratch(survivor.with_rank(spread(files), cameras), "ranked")
    staged, _ = write_scratch(stage(ranked, staging_reasons(ranked, duplicates, ranked, overlaps), ranked), "staged")
    live = files.where("status <> 'error'" if include_done else "status not in ('error', 'done')")
    ladder, _ = write_scratch(date_ladder(spread(files.drop("sha256", "phash", "key", "size_bytes", "width", "height")), today, zone), "ladder")
    rated, _ = write_scratch(effective_dates(ladder, overrides, events.sibling_hints(ladder)), "rated")
    folders, _ = write_scratch(events.resolve_folders(files, roots, target), "folders")
    own = survivor.own_cameras(cameras)
    grouped = rated.where(F.col("file_type").isin(*DATED_TYPES) & (F.col("status") != "error")).join(staged.select("file_id"), "file_id", "left_anti").join(folders, "folder")
    groups = events.span_groups(grouped.select("event_folder", "event_name", F.col("eff").cast("date").alias("day")))
    bases = events.event_bases(files, folders, own)
    moving = rated.join(staged.select("file_id"), "file_id", "left_anti").join(live.select("file_id"), "file_id", "left_semi").where("file_type <> 'UNKNOWN'")
    moves = build_targets(moving, folders, groups, bases, overrides, own, target).join(files.select("file_id", F.col("path").alias("source_path")), "file_id")
    moves = moves.select("file_id", F.lit("MOVE").alias("op_type"), "source_path", "target_path", F.lit(None).cast("string").alias("stage_reason"), F.lit(None).cast("long").alias("dupe_of_file_id"))
    place = F.create_map(*[F.lit(x) for pair in STAGE_FOLDERS.items() for x in pair])
    into = F.concat_ws("/", F.lit(target), F.lit("_staging/to_delete"), place[F.col("stage_reason")], F.concat_ws("_", F.col("file_id").cast("string"), "filename"))
    stages = staged.join(live.select("file_id", "path", "filename"), "file_id").select("file_id", F.lit("STAGE_DELETE").alias("op_type"), F.col("path").alias("source_path"), into.alias("target_path"), "stage_reason", "dupe_of_file_id")
    return moves.unionByName(stages)


def plan_summary(plan_rows: DataFrame, files: DataFrame) -> DataFrame:
    """(moves, staged, resized, staged_bytes) of a plan."""
    rows = plan_rows.join(files.select("file_id", "size_bytes"), "file_id")
    st = F.col("op_type") == "STAGE_DELETE"
    return rows.agg(F.count_if(F.col("op_type") == "MOVE").alias("moves"), F.count_if(st).alias("staged"), F.count_if(st & (F.col("stage_reason") == "resized_jpeg")).alias("resized"), F.coalesce(F.sum(F.when(st, F.col("size_bytes"))), F.lit(0)).alias("staged_bytes"))


def no_event_folders(files: DataFrame) -> DataFrame:
    """(folder, files): source folders whose own name carries no event."""
    rows = files.where("status <> 'error'").withColumn("folder", parent(F.col("path")))
    return rows.where(naming.is_unorganised(base_name(F.col("folder")))).groupBy("folder").agg(F.count("*").alias("files"))


_SUFFIX = r"(?<=[^./\\])(\.[^./\\]*)?$"


def number_conflicts(plan_rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Target paths made unique: the first file of a path keeps it if it is not
    among ``taken`` (target_path); the others, in the order of file_id, get the
    smallest _conflict_N before the suffix that is free. A name is free if it is
    neither taken nor wanted as it is by a row of the plan.

    The k-th free number of a path is k plus the used numbers that come before
    it: with the used number u of rank i at u - i, it is the place of k in the
    order of both, so nothing is listed or tried one by one.
    """
    used = taken.select("target_path").where("target_path is not null").distinct()
    rows = number_rows(plan_rows, "_k", "file_id", group="target_path").join(used.withColumn("_taken", F.lit(1)), "target_path", "left")
    rows, _ = write_scratch(rows.withColumn("_k", F.col("_k") - 1 + F.coalesce("_taken", F.lit(0))).drop("_taken"), "wanted-targets")
    late = rows.where("_k > 0")
    name, tail = F.regexp_replace("target_path", _SUFFIX, ""), F.regexp_extract("target_path", _SUFFIX, 1)
    number = F.regexp_extract(name, r"_conflict_([1-9][0-9]{0,17})$", 1).try_cast("long")
    held = used.unionByName(plan_rows.select("target_path")).distinct().select(F.concat(F.regexp_replace(name, r"_conflict_[0-9]+$", ""), tail).alias("target_path"), number.alias("_u")).where("_u is not null").distinct()
    held = number_rows(held.join(late.select("target_path").distinct(), "target_path", "left_semi"), "_i", "_u", group="target_path")
    both = late.select("target_path", F.col("_k").alias("_at"), F.lit(0).alias("_kind"), "file_id").unionByName(held.select("target_path", (F.col("_u") - F.col("_i")).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(plan_rows.schema["file_id"].dataType).alias("file_id")))
    placed = number_rows(both, "_n", "_at", "_kind", "file_id", group="target_path").where("_kind = 0").select("target_path", "file_id", "_at", "_n")
    numbered = F.concat(name, F.lit("_conflict_"), F.col("_n").cast("string"), tail)
    out = late.join(placed.withColumnRenamed("_at", "_k"), ["target_path", "file_id", "_k"]).withColumn("target_path", numbered)
    return rows.where("_k = 0").select(*plan_rows.columns).unionByName(out.select(*plan_rows.columns))
