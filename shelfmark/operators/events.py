"""Events from folders and dates: resolved labels, spans, gaps, bases, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.classify import DATED_TYPES, PHOTO_TYPES
from shelfmark.functions.dates import folder_date_range, metadata_datetime
from shelfmark.functions.naming import is_container, is_unorganised, sanitize_event
from shelfmark.functions.paths import base_name, parent, root_key

MAX_SPAN, MAX_GAP, DOMINANCE = 30, 3, 0.90


def resolve_folders(paths: DataFrame, roots: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """(folder, event_folder, event_name, event_label): for each distinct parent folder of
    ``paths`` (column path) the nearest folder, itself included, whose name is a
    label. The climb ends at a scan root (which may be the label itself) and at
    the target tree (which may not). Null where there is none.

    Folders are far fewer than files, and so are their distinct ancestors, on
    which the names are judged once.
    """
    folders = paths.select(parent(F.col("path")).alias("folder")).where("folder is not null").distinct()
    chain = folders.select("folder", F.posexplode(F.reverse(_self_and_up(F.col("folder"))))).toDF("folder", "steps", "up")
    nodes = chain.select("up").distinct().withColumn("name", base_name(F.col("up")))
    nodes = nodes.withColumn("clean", sanitize_event(F.col("name"))).withColumn("good", ~is_unorganised(F.col("name")) & ~is_container(F.col("name")) & (F.col("clean") != ""))
    nodes = nodes.withColumn("key", root_key(F.col("up")))
    if roots is not None:
        tops = roots.select(root_key(F.col("path_prefix")).alias("key")).distinct().withColumn("is_root", F.lit(True))
        nodes = nodes.join(tops, "key", "left")
    else:
        nodes = nodes.withColumn("is_root", F.lit(None).cast("boolean"))
    wall = F.lit(False)
    if target:
        walls = [target.replace("/", "\\").rstrip("\\").lower() + s for s in ("", "\\masters", "\\others", "\\nodate")]
        wall = F.col("key").isin(*walls)
    judged = chain.join(nodes.select("up", "name", "clean", "good", F.coalesce("is_root", F.lit(False)).alias("top"), wall.alias("wall")), "up")
    climb = Window.partitionBy("folder")  # as many rows as the folder is deep
    limits = judged.withColumn("wall_at", F.min(F.when(F.col("wall"), F.col("steps"))).over(climb)).withColumn("top_at", F.min(F.when(F.col("top"), F.col("steps"))).over(climb))
    fit = limits.where(F.col("good") & (F.col("wall_at").isNull() | (F.col("steps") < F.col("wall_at"))) & (F.col("top_at").isNull() | (F.col("steps") <= F.col("top_at"))))
    found = fit.groupBy("folder").agg(F.min_by(F.struct("up", "name", "clean"), "steps").alias("e"))
    return folders.join(found, "folder", "left").select("folder", F.col("e.up").alias("event_folder"), F.col("e.name").alias("event_name"), F.col("e.clean").alias("event_label"))


def _self_and_up(folder: Column) -> Column:
    """The folder and all above it below the drive, shortest first."""
    sep = F.when(folder.contains("\\"), F.lit("\\")).otherwise(F.lit("/"))
    p = F.split(folder, r"[\\/]")
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(2), F.size(p)), lambda i: F.call_function("array_join", F.slice(p, 1, i), sep))).otherwise(F.array().cast("array<string>"))


def confident_days(files: DataFrame) -> DataFrame:
    """(file_id, folder, day): photos that are not in error with a HIGH or MEDIUM date that can be read."""
    rows = files.where(F.col("file_type").isin(*PHOTO_TYPES) & (F.col("status") != "error") & F.col("date_confidence").isin("HIGH", "MEDIUM"))
    return rows.select("file_id", parent(F.col("path")).alias("folder"), metadata_datetime(F.col("datetime_original")).cast("date").alias("day")).where("day is not null and folder is not null")


def sibling_hints(files: DataFrame) -> DataFrame:
    """(folder, hint): the most common confident day of a folder's files that are no videos, the earliest if equal."""
    rows = files.where("file_type <> 'VIDEO' and status <> 'error' and date_confidence in ('HIGH', 'MEDIUM')")
    days = rows.select(parent(F.col("path")).alias("folder"), metadata_datetime(F.col("datetime_original")).cast("date").alias("day")).where("day is not null and folder is not null")
    counts = days.groupBy("folder", "day").agg(F.count("*").alias("n"))
    return counts.groupBy("folder").agg(F.min_by("day", F.struct((-F.col("n")).alias("n"), "day")).alias("hint"))


def span_groups(dated: DataFrame, key: str = "event_folder", name: str = "event_name", day: str = "day") -> DataFrame:
    """(key, kind, start, last, span, label): groups of dated rows by folder; over
    MAX_SPAN days a "subject", over one day an "event"; single days are left out."""
    g = dated.where(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(key).agg(F.min(name).alias("_n"), F.min(day).alias("start"), F.max(day).alias("last"))
    span = F.datediff("last", "start") + 1
    kind = F.when(span > MAX_SPAN, "subject").otherwise("event")
    return g.where(span > 1).select(key, kind.alias("kind"), "start", "last", span.alias("span"), sanitize_event(F.col("_n"), F.col("last")).alias("label"))


def dominant_days(files: DataFrame) -> DataFrame:
    """(folder, day, n, total): folders of which one day holds at least DOMINANCE of the confident photos."""
    counts = confident_days(files).groupBy("folder", "day").agg(F.count("*").alias("n"))
    best = counts.groupBy("folder").agg(F.min_by(F.struct("day", "n"), F.struct((-F.col("n")).alias("n"), "day")).alias("b"), F.sum("n").alias("total"))
    return best.where(F.col("b.n") / F.col("total") >= DOMINANCE).select("folder", F.col("b.day").alias("day"), F.col("b.n").alias("n"), "total")


def _gaps(days: DataFrame, key: str) -> DataFrame:
    """(key, days, start, last, max_gap) of distinct days."""
    order = Window.partitionBy(key).orderBy("day")
    gap = days.withColumn("gap", F.datediff("day", F.lag("day").over(order)))
    return gap.groupBy(key).agg(F.count("*").alias("days"), F.min("day").alias("start"), F.max("day").alias("last"), F.max("gap").alias("max_gap"))


def _touches(year: str | None, days: DataFrame, key: str) -> DataFrame | None:
    return days.where(F.date_format("day", "yyyy") == year).select(key).distinct() if year else None


def _not_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows
    tops = roots.select(root_key(F.col("path_prefix")).alias("_k")).distinct()
    return rows.withColumn("_k", root_key(F.col("event_folder"))).join(tops, "_k", "left_anti").drop("_k")


def per_day_events(files: DataFrame, folders: DataFrame, roots: DataFrame | None = None, year: str | None = None) -> DataFrame:
    """(event_folder, days, span, subfolders): events whose subfolders each hold
    one day, on two or more days with gaps of at most MAX_GAP within MAX_SPAN days."""
    sub = dominant_days(files).join(folders, "folder").where("event_folder is not null and event_folder <> folder")
    sub = _not_roots(sub, roots)
    count = sub.groupBy("event_folder").agg(F.count("*").alias("subfolders"))
    days = sub.select("event_folder", "day").distinct()
    g = _gaps(days, "event_folder").withColumn("span", F.datediff("last", "start") + 1)
    fit = g.where((F.col("days") >= 2) & (F.col("span") <= MAX_SPAN) & (F.col("max_gap") <= MAX_GAP)).join(count, "event_folder").where("subfolders >= 2")
    if year:
        fit = fit.join(_touches(year, days, "event_folder"), "event_folder", "left_semi")
    return fit.select("event_folder", "days", "span", "subfolders")


def _event_days(files: DataFrame, folders: DataFrame, roots: DataFrame | None) -> DataFrame:
    rows = confident_days(files).join(folders.where("event_folder is not null"), "folder")
    return _not_roots(rows, roots).select("event_folder", "event_name", "day").distinct()


def scattered_events(files: DataFrame, folders: DataFrame, roots: DataFrame | None = None, exclude: DataFrame | None = None, year: str | None = None) -> DataFrame:
    """(event_folder, days, span): two or more days within MAX_SPAN with some gap
    above MAX_GAP, without those in ``exclude`` (column event_folder)."""
    days = _event_days(files, folders, roots)
    if exclude is not None:
        days = days.join(exclude.select("event_folder"), "event_folder", "left_anti")
    g = _gaps(days.select("event_folder", "day"), "event_folder").withColumn("span", F.datediff("last", "start") + 1)
    fit = g.where((F.col("days") >= 2) & (F.col("span") <= MAX_SPAN) & (F.col("max_gap") > MAX_GAP))
    if year:
        fit = fit.join(_touches(year, days, "event_folder"), "event_folder", "left_semi")
    return fit.select("event_folder", "days", "span")


def unconfirmed_subjects(files: DataFrame, folders: DataFrame, overrides: DataFrame, roots: DataFrame | None = None, year: str | None = None) -> DataFrame:
    """(event_folder, label, span, days, date_lo, date_hi): labelled events over
    MAX_SPAN days that no override confirms as a subject."""
    known = overrides.where("confirmed_subject <> 0").select(F.col("source_folder").alias("event_folder"))
    days = _event_days(files, folders, roots).join(known, "event_folder", "left_anti")
    names = days.groupBy("event_folder").agg(F.min("event_name").alias("n"))
    g = _gaps(days.select("event_folder", "day"), "event_folder").join(names, "event_folder").withColumn("span", F.datediff("last", "start") + 1)
    g = g.withColumn("label", sanitize_event(F.col("n"), F.col("last"))).where((F.col("span") > MAX_SPAN) & (F.col("label") != ""))
    if year:
        g = g.join(_touches(year, days, "event_folder"), "event_folder", "left_semi")
    return g.select("event_folder", "label", "span", "days", F.date_format("start", "yyyy-MM-dd").alias("date_lo"), F.date_format("last", "yyyy-MM-dd").alias("date_hi"))


def event_bases(files: DataFrame, folders: DataFrame, own: DataFrame) -> DataFrame:
    """(event_folder, base): Masters if any photo of the event has an own camera, else Others."""
    rows = files.where(F.col("file_type").isin(*PHOTO_TYPES) & (F.col("status") != "error")).select(parent(F.col("path")).alias("folder"), F.lower("camera_model").alias("own_model"))
    flagged = rows.join(own.withColumn("_own", F.lit(True)), "own_model", "left").join(folders.where("event_folder is not null"), "folder")
    known = F.bool_or(F.coalesce("_own", F.lit(False)) & (F.col("own_model") != ""))
    return flagged.groupBy("event_folder").agg(F.when(known, "Masters").otherwise("Others").alias("base"))


def existing_events(operations: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, base, date_lo, date_hi, lineage): event folders of the library from
    done moves, with the source folders they were filled from."""
    moved = operations.where("op_type = 'MOVE' and status = 'done'").join(files.select("file_id", "path"), "file_id")
    names = F.split(F.col("path"), r"[\\/]")
    folders_of = F.slice(names, 1, F.size(names) - 1)
    base = F.when(F.array_contains(folders_of, "Masters"), "Masters").when(F.array_contains(folders_of, "Others"), "Others")
    rows = moved.select(parent(F.col("path")).alias("dir"), base.alias("base"), parent(F.col("source_path")).alias("source")).where("base is not null and dir is not null").distinct()
    rng = folder_date_range(base_name(F.col("dir")))
    return rows.groupBy("dir", "base").agg(F.sort_array(F.collect_set("source")).alias("lineage")).select("dir", "base", rng["lo"].alias("date_lo"), rng["hi"].alias("date_hi"), "lineage")


def match_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """(file_id, dir): the existing event of each new row (file_id, source, base, day).

    One event of the same source folder wins at once; of several, the first that
    holds the day; without any, the first of the same base that holds the day.
    First means the earliest date_lo, then the smaller dir. Rows without a match
    are left out. Ranges may be of any length: the distinct days of the rows,
    which are few, are matched with the ranges of their year, and the rows are
    joined to the answer of their day.
    """
    lineage = events.select("dir", "date_lo", "date_hi", F.explode("lineage").alias("source"))
    linked = rows.join(lineage, "source")
    n = linked.groupBy("file_id").agg(F.count("*").alias("n"), F.min(F.struct("date_lo", "dir")).alias("one"), F.min(F.when(F.col("day").between(F.col("date_lo"), F.col("date_hi")), F.struct("date_lo", "dir"))).alias("held"))
    by_source = n.select("file_id", F.when(F.col("n") == 1, F.col("one.dir")).otherwise(F.col("held.dir")).alias("dir"))
    ranges = events.where("date_lo <= date_hi").select("base", "dir", "date_lo", "date_hi", F.explode(F.sequence(F.year("date_lo"), F.year("date_hi"))).alias("year"))
    rest = rows.join(n.select("file_id"), "file_id", "left_anti").where("day is not null")
    days = rest.select("base", "day").distinct().withColumn("year", F.year("day"))
    held = days.join(ranges, ["base", "year"]).where(F.col("day").between(F.col("date_lo"), F.col("date_hi"))).groupBy("base", "day").agg(F.min(F.struct("date_lo", "dir")).alias("e"))
    by_day = rest.join(held, ["base", "day"]).groupBy("file_id").agg(F.min("e").alias("e")).select("file_id", F.col("e.dir").alias("dir"))
    return by_source.where("dir is not null").unionByName(by_day)


def organize_candidates(files: DataFrame, samples: int = 8) -> DataFrame:
    """(folder, files, low_dates, first_day, last_day, samples) of every source
    folder; ``samples`` are the first paths in order, at most that many a folder."""
    rows = files.where(F.col("file_type").isin(*DATED_TYPES) & (F.col("status") != "error")).withColumn("folder", parent(F.col("path"))).where("folder is not null")
    low = (F.col("file_type") != "VIDEO") & (F.col("date_confidence").isNull() | (F.col("date_confidence") == "LOW"))
    sure = F.when(F.col("date_confidence").isin("HIGH", "MEDIUM"), metadata_datetime(F.col("datetime_original")).cast("date"))
    totals = rows.groupBy("folder").agg(F.count("*").alias("files"), F.count_if(low).alias("low_dates"), F.min(sure).alias("first_day"), F.max(sure).alias("last_day"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).where(F.col("r") <= samples)
    return totals.join(first.groupBy("folder").agg(F.sort_array(F.collect_list("path")).alias("samples")), "folder", "left")
