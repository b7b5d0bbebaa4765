"""Profile and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.classify import ALL_TYPES, classify
from shelfmark.functions.paths import parent
from shelfmark.operators.ledger import latest


def counts(rows: DataFrame, column: str, out: str = "n") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias(out))


def type_breakdown(files: DataFrame) -> DataFrame:
    """(file_type, files, share) with a row for every type and a TOTAL."""
    every = files.sparkSession.createDataFrame([(t,) for t in (*ALL_TYPES, "TOTAL")], "file_type string")
    tally = files.groupBy("file_type").agg(F.count("*").alias("n"))
    total = tally.agg(F.sum("n").alias("n")).select(F.lit("TOTAL").alias("file_type"), F.coalesce("n", F.lit(0)).alias("n"))
    joined = every.join(tally.unionByName(total), "file_type", "left").select("file_type", F.coalesce("n", F.lit(0)).alias("files"))
    whole = F.max(F.when(F.col("file_type") == "TOTAL", F.col("files"))).over(Window.partitionBy())  # eight rows
    return joined.select("file_type", "files", F.when(whole > 0, F.col("files") / whole).otherwise(0.0).alias("share"))


def camera_counts(files: DataFrame) -> DataFrame:
    """(camera, n): grouped by the raw model, so null and a literal 'Unknown' stay two rows."""
    return files.groupBy("camera_model").agg(F.count("*").alias("n")).select(F.coalesce("camera_model", F.lit("Unknown")).alias("camera"), "n")


def date_bounds(files: DataFrame) -> DataFrame:
    """Least and greatest date text, files without a date, and files with any extra metadata."""
    extra = F.col("rating").isNotNull() | F.col("keywords").isNotNull()
    return files.agg(F.min("datetime_original").alias("first_date"), F.max("datetime_original").alias("last_date"), F.count_if(F.col("datetime_original").isNull()).alias("no_date"), F.count_if(extra).alias("with_metadata"))


def top_keywords(files: DataFrame, k: int = 20) -> DataFrame:
    """(keyword, n), the k most frequent, equal counts by keyword; unreadable JSON counts as none."""
    words = files.select(F.explode(F.from_json("keywords", "array<string>")).alias("keyword")).where("keyword is not null")
    return words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


def resolution_buckets(files: DataFrame) -> DataFrame:
    """(high, medium, low) by width of files that are not raw; null and 0 are in none."""
    w, soft = F.col("width"), F.col("file_type") != "RAW"
    return files.agg(F.count_if(soft & (w > 4000)).alias("high"), F.count_if(soft & w.between(1000, 4000)).alias("medium"), F.count_if(soft & (w > 0) & (w < 1000)).alias("low"))


def command_timings(runs: DataFrame) -> DataFrame:
    """(command, runs, avg_s, min_s, max_s, last_s, last_status, last_at); rows
    delivered twice count once, the last run is that of the latest finish, then the greatest run_id."""
    last = F.max_by(F.struct("duration_seconds", "status", "finished_at"), F.struct("finished_at", "run_id"))
    s = F.col("duration_seconds")
    g = latest(runs, "run_id").groupBy("command").agg(F.count("*").alias("runs"), F.avg(s).alias("avg_s"), F.min(s).alias("min_s"), F.max(s).alias("max_s"), last.alias("l"))
    return g.select("command", "runs", "avg_s", "min_s", "max_s", F.col("l.duration_seconds").alias("last_s"), F.col("l.status").alias("last_status"), F.col("l.finished_at").alias("last_at"))


def video_totals(files: DataFrame) -> DataFrame:
    v = files.where("file_type = 'VIDEO'")
    return v.agg(F.count("*").alias("videos"), F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("seconds"))


def top_k(rows: DataFrame, column: str, k: int = 10, missing: str = "unknown") -> DataFrame:
    """(value, n): grouped after nulls became ``missing``, so both merge."""
    return rows.groupBy(F.coalesce(column, F.lit(missing)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def unknown_camera_profile(files: DataFrame, k: int = 20) -> DataFrame:
    """(dimension, value, n, rank, others): five counters over files without a
    camera in one pass of grouping sets; the k most frequent of each, and the
    number of values beyond them."""
    rows = files.where(F.coalesce("camera_model", F.lit("")) == "").select(
        F.coalesce("file_type", F.lit("?")).alias("type"),
        F.coalesce(F.substring("datetime_original", 1, 4), F.lit("no date")).alias("year"),
        F.coalesce("camera_make", F.lit("no make")).alias("make"),
        F.coalesce("software", F.lit("no software")).alias("software"),
        F.coalesce(parent(F.col("path")), F.lit("")).alias("folder"),
    )
    dims = ["type", "year", "make", "software", "folder"]
    sets = rows.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    value, dim = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.col(d)) for d in dims]), F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims])
    flat = sets.select(dim.alias("dimension"), value.alias("value"), "n")
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    # the top k of each dimension by a bounded window limit; the size of a dimension by a partial count
    total = flat.groupBy("dimension").agg(F.count("*").alias("values"))
    top = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(total, "dimension").select("dimension", "value", "n", "rank", F.greatest(F.lit(0), F.col("values") - k).alias("others"))


def reclassified(files: DataFrame, secondary: bool = True) -> DataFrame:
    """(old_type, new_type, n): changes of the JPEG classes by the stored software and width."""
    rows = files.where("file_type in ('CAMERA_JPEG', 'DEV_JPEG')").select(F.col("file_type").alias("old_type"), classify(F.col("path"), F.col("software"), F.col("width"), secondary).alias("new_type"))
    return rows.where("old_type <> new_type").groupBy("old_type", "new_type").agg(F.count("*").alias("n"))


def confidence_counts(rated: DataFrame) -> DataFrame:
    return rated.groupBy("date_source", "date_confidence").agg(F.count("*").alias("n"))


def grouped_review(overlaps: DataFrame) -> DataFrame:
    """(parent_a, parent_b, pairs, shared, pending): twin folders by the pair of folders above."""
    keyed = overlaps.select(parent(F.col("folder_a")).alias("parent_a"), parent(F.col("folder_b")).alias("parent_b"), "shared_count", F.col("status") if "status" in overlaps.columns else F.lit("pending").alias("status"))
    return keyed.groupBy("parent_a", "parent_b").agg(F.count("*").alias("pairs"), F.sum("shared_count").alias("shared"), F.count_if(F.col("status") == "pending").alias("pending"))


def folder_report(counts_: DataFrame, folder: str = "folder", n: str = "files") -> DataFrame:
    """(mother, total, children): folders by the folder above; children are
    (files, folder), most files first. One row a mother folder."""
    rows = counts_.select(F.coalesce(parent(F.col(folder)), F.lit("")).alias("mother"), F.col(folder).alias("folder"), F.col(n).alias("files"))
    kids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("k"), "folder"))), lambda x: F.struct((-x["k"]).alias("files"), x["folder"].alias("folder")))
    return rows.groupBy("mother").agg(F.sum("files").alias("total"), kids.alias("children"))


def sampled(rows: DataFrame, group: Column, k: int, seed: int = 42) -> DataFrame:
    """k rows of each group, chosen by a hash of the row, so that a task that runs again chooses the same."""
    order = Window.partitionBy("_g").orderBy(F.xxhash64(*rows.columns, F.lit(seed)), *rows.columns)
    return rows.withColumn("_g", group).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_g", "_r")
