"""Adding new files to a library that is frozen: placement of one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import dates
from shelfmark.functions.classify import DATED_TYPES, PHOTO_TYPES
from shelfmark.functions.hashes import hex_to_long, valid_hex
from shelfmark.functions.paths import parent
from shelfmark.operators import events, pairs, survivor
from shelfmark.plans import organise
from shelfmark.runtime import write_scratch


def new_files(files: DataFrame, operations: DataFrame) -> DataFrame:
    """Files that are neither done nor in error and have no done operation."""
    rows = files.where("status not in ('done', 'error')")
    return rows.join(operations.where("status = 'done'").select("file_id"), "file_id", "left_anti")


def exact_matches(new: DataFrame, library: DataFrame) -> DataFrame:
    """(file_id, keeper): new files whose hash the library holds; the keeper is its smallest id."""
    held = library.where("sha256 is not null").groupBy("sha256").agg(F.min("file_id").alias("keeper"))
    return new.where("sha256 is not null").select("file_id", "sha256").join(held, "sha256").select("file_id", "keeper")


def within_batch(new: DataFrame, ranked: DataFrame) -> DataFrame:
    """(file_id, keeper): new files of one hash but the best of them."""
    rows = ranked.where("sha256 is not null").join(new.select("file_id"), "file_id", "left_semi")
    best = survivor.best_of(rows, "sha256").where("members > 1")
    return rows.select("file_id", "sha256").join(best, "sha256").where("file_id <> keeper").select("file_id", "keeper")


def near_library_links(new: DataFrame, library: DataFrame, radius: int = 8) -> DataFrame:
    """(new_id, library_id, hamming_distance, kind): new files against library
    files by fingerprint, of all keys, however many files hold them. "near" links
    the smallest new id of a key with the smallest library id of each key within
    ``radius``, the same key included. The other files of these keys are not
    paired with each other: "new" (its own smallest new id as library_id) and
    "library" (the smallest library id as new_id) link each with its key's."""
    key = lambda df: df.select("file_id", F.when(valid_hex(F.col("phash"), 16).isNotNull(), hex_to_long(valid_hex(F.col("phash"), 16))).alias("key")).where("key is not null")
    a, b = key(new), key(library)
    keys = pairs.hamming_pairs(a, b, "key", radius)
    first = lambda df, k, i: df.groupBy(F.col("key").alias(k)).agg(F.min("file_id").alias(i))
    near = keys.join(first(a, "key_a", "new_id"), "key_a").join(first(b, "key_b", "library_id"), "key_b").select("new_id", "library_id", F.col("hamming").alias("hamming_distance"), F.lit("near").alias("kind"))
    of_new = pairs.star_edges(a.join(keys.select(F.col("key_a").alias("key")).distinct(), "key"), "key", "file_id")
    of_library = pairs.star_edges(b.join(keys.select(F.col("key_b").alias("key")).distinct(), "key"), "key", "file_id")
    same = of_new.select(F.col("b").alias("new_id"), F.col("a").alias("library_id"), F.lit(0).alias("hamming_distance"), F.lit("new").alias("kind"))
    held = of_library.select(F.col("a").alias("new_id"), F.col("b").alias("library_id"), F.lit(0).alias("hamming_distance"), F.lit("library").alias("kind"))
    return near.unionByName(same).unionByName(held)


def plan_additions(files: DataFrame, operations: DataFrame, overrides: DataFrame, cameras: DataFrame, roots: DataFrame | None, today: Column, target: str = "Library", zone: str = "UTC") -> DataFrame:
    """(file_id, op_type, target_path, stage_reason, dupe_of_file_id) of the new files.

    Copies of library files and of better new files are staged; a photo that
    belongs to an existing event moves into its folder, whatever its name; the
    rest is filed by the spans of the new files alone, so nothing that is filed
    already changes its place. The same inputs give the same rows.
    """
    ranked, _ = write_scratch(survivor.with_rank(files, cameras), "ranked")
    new, library = new_files(files, operations), files.where("status = 'done'")
    exact = exact_matches(new, library)
    own_dupes = within_batch(new, ranked).join(exact.select("file_id"), "file_id", "left_anti")
    losers, _ = write_scratch(exact.unionByName(own_dupes), "losers")
    staged = new.join(losers, "file_id").select("file_id", F.lit("STAGE_DELETE").alias("op_type"), F.concat_ws("/", F.lit(target), F.lit("_staging/to_delete/exact_dupe"), F.concat_ws("_", F.col("file_id").cast("string"), "filename")).alias("target_path"), F.lit("exact_dupe").alias("stage_reason"), F.col("keeper").alias("dupe_of_file_id"))
    rest = new.where("file_type <> 'UNKNOWN'").join(losers.select("file_id"), "file_id", "left_anti")
    rated, _ = write_scratch(organise.date_ladder(rest.drop("date_source", "date_confidence"), today, zone), "ladder")
    own = survivor.own_cameras(cameras)
    base = rated.withColumn("own_model", F.lower("camera_model")).join(own.withColumn("_own", F.lit(True)), "own_model", "left").withColumn("base", F.when(F.col("_own") & (F.col("own_model") != ""), "Masters").otherwise("Others"))
    photos = base.where(F.col("file_type").isin(*PHOTO_TYPES)).select("file_id", parent(F.col("path")).alias("source"), "base", F.col("dt").cast("date").alias("day"))
    matched, _ = write_scratch(events.match_events(photos, events.existing_events(operations, files)), "matched")
    joined = matched.join(rest.select("file_id", "filename"), "file_id").select("file_id", F.concat_ws("/", "dir", "filename").alias("target_path"))
    folders, _ = write_scratch(events.resolve_folders(rest, roots), "folders")
    dated = rated.where(F.col("file_type").isin(*PHOTO_TYPES)).select(parent(F.col("path")).alias("folder"), dates.metadata_datetime(F.col("datetime_original")).cast("date").alias("day")).join(folders, "folder")
    groups, bases = events.span_groups(dated), events.event_bases(rest, folders, own)
    open_ = organise.effective_dates(rated, overrides, events.sibling_hints(rated)).join(matched.select("file_id"), "file_id", "left_anti").where(F.col("file_type").isin(*DATED_TYPES, "RESIZED_JPEG"))
    placed = organise.build_targets(open_, folders, groups, bases, overrides, own, target)
    moves = joined.unionByName(placed).select("file_id", F.lit("MOVE").alias("op_type"), "target_path", F.lit(None).cast("string").alias("stage_reason"), F.lit(None).cast("long").alias("dupe_of_file_id"))
    return staged.unionByName(moves)
