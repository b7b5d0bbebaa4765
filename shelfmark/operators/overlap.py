"""Folders that hold the same content: subtree sets, twin pairs, merge losers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.naming import noncanonical_score
from shelfmark.functions.paths import ancestors, parent, parts, root_key, separator
from shelfmark.runtime import write_scratch

COVERAGE, MIN_SHARED, UBIQUITOUS = 0.95, 5, 30


def subtree_members(files: DataFrame, roots: DataFrame | None = None, path: str = "path", item: str = "sha256", root: str = "path_prefix") -> DataFrame:
    """(folder, item): distinct items below each folder, up to its scan root.

    The chain of folders above a path is exploded, once for each distinct parent
    folder, so membership is an equality and not a prefix comparison; without
    roots the chain ends below the drive.
    """
    rows = files.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), parent(F.col(path)).alias("home")).where("home is not null").distinct()
    rows, _ = write_scratch(rows, "items")
    long = folder_chains(rows.select("home").distinct())
    if roots is not None:
        # roots are a dimension; a folder counts if it is a root or lies below one
        tops = roots.select(root_key(F.col(root)).alias("top")).distinct()
        folders = long.select("folder").distinct().withColumn("k", root_key(F.col("folder")))
        chain = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts(F.col("k")))), lambda i: F.array_join(F.slice(parts(F.col("k")), 1, i), "\\"))).alias("top"))
        inside = chain.join(tops, "top").select("folder").distinct()
        long = long.join(inside, "folder")
    return rows.join(long, "home").select("folder", F.col("item").alias(item)).distinct()


def folder_chains(homes: DataFrame) -> DataFrame:
    """(home, folder): each folder with itself and all folders above it below the drive."""
    return homes.select("home", F.explode(ancestors(F.concat("home", separator(F.col("home")), F.lit("x")))).alias("folder"))


def twin_folders(members: DataFrame, item: str = "sha256", coverage: float = COVERAGE, min_shared: int = MIN_SHARED, ubiquitous: int = UBIQUITOUS) -> DataFrame:
    """(folder_a, folder_b, shared_count, a_only_count, b_only_count, coverage_a,
    coverage_b, keeper), folder_a < folder_b: pairs of folders whose item sets
    cover each other. Items in more than ``ubiquitous`` folders link nothing
    (which also bounds the pairs of one item); a folder and its own subfolder
    are no pair. The keeper has fewer backup marks, then the shorter path, then
    the smaller text."""
    sizes = members.groupBy("folder").agg(F.count("*").alias("n"))
    spread_ = members.groupBy(item).agg(F.count("*").alias("k")).where(F.col("k").between(2, ubiquitous)).select(item)
    useful = members.join(spread_, item)
    a = useful.select(item, F.col("folder").alias("folder_a"))
    b = useful.select(item, F.col("folder").alias("folder_b"))
    below = lambda x, y: F.col(x).startswith(F.concat(F.col(y), separator(F.col(y))))
    pairs = a.join(b, item).where((F.col("folder_a") < F.col("folder_b")) & ~below("folder_a", "folder_b") & ~below("folder_b", "folder_a"))
    shared = pairs.groupBy("folder_a", "folder_b").agg(F.count("*").alias("shared_count")).where(F.col("shared_count") >= min_shared)
    sized = shared.join(sizes.select(F.col("folder").alias("folder_a"), F.col("n").alias("na")), "folder_a").join(sizes.select(F.col("folder").alias("folder_b"), F.col("n").alias("nb")), "folder_b")
    out = sized.select("folder_a", "folder_b", "shared_count", (F.col("na") - F.col("shared_count")).alias("a_only_count"), (F.col("nb") - F.col("shared_count")).alias("b_only_count"), (F.col("shared_count") / F.col("na")).alias("coverage_a"), (F.col("shared_count") / F.col("nb")).alias("coverage_b"))
    rank = lambda c: F.struct(noncanonical_score(F.col(c)).alias("s"), F.length(c).alias("l"), F.col(c).alias("t"))
    return out.where(F.least("coverage_a", "coverage_b") >= coverage).withColumn("keeper", F.when(rank("folder_a") <= rank("folder_b"), "a").otherwise("b"))


def roll_up(twins: DataFrame) -> DataFrame:
    """Without pairs that follow from a pair above: climbing both folders in
    step, some pair of ancestors is a twin too. The climb ends where the two
    parents are the same or one is a root."""
    pa, pb = parts(F.col("folder_a")), parts(F.col("folder_b"))
    sa, sb = separator(F.col("folder_a")), separator(F.col("folder_b"))
    up = F.transform(F.sequence(F.lit(1), F.least(F.size(pa), F.size(pb)) - 2), lambda k: F.struct(F.call_function("array_join", F.slice(pa, 1, F.size(pa) - k), sa).alias("x"), F.call_function("array_join", F.slice(pb, 1, F.size(pb) - k), sb).alias("y"), k.alias("k")))
    steps = twins.where(F.least(F.size(pa), F.size(pb)) > 2).select("folder_a", "folder_b", F.explode(up).alias("u"))
    same = steps.where(F.col("u.x") == F.col("u.y")).groupBy("folder_a", "folder_b").agg(F.min("u.k").alias("stop"))
    live = steps.join(same, ["folder_a", "folder_b"], "left").where(F.col("stop").isNull() | (F.col("u.k") < F.col("stop")))
    keys = twins.select(F.col("folder_a").alias("x"), F.col("folder_b").alias("y"))
    covered = live.select("folder_a", "folder_b", F.least("u.x", "u.y").alias("x"), F.greatest("u.x", "u.y").alias("y")).join(keys, ["x", "y"]).select("folder_a", "folder_b").distinct()
    return twins.join(covered, ["folder_a", "folder_b"], "left_anti")


def folder_overlaps(files: DataFrame, roots: DataFrame | None = None, **limits) -> DataFrame:
    """Rolled-up twin folders of files that are not in error."""
    members, _ = write_scratch(subtree_members(files.where("status <> 'error'"), roots), "subtrees")
    twins, _ = write_scratch(twin_folders(members, **limits), "twins")
    return roll_up(twins)


def merge_losers(files: DataFrame, overlaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Losers (file_id, keeper) of reviewed twin folders, and the counts of
    unique files (folder_a, folder_b, unique_count).

    A file below the losing folder is a loser if its hash also lies below the
    keeping one; the keeper is the smallest id there. Files in error are left
    out, and files that are done cannot lose. Null hashes are unique."""
    decided = overlaps.where("status = 'reviewed' and keeper in ('a', 'b')")
    win = F.when(F.col("keeper") == "a", F.col("folder_a")).otherwise(F.col("folder_b"))
    lose = F.when(F.col("keeper") == "a", F.col("folder_b")).otherwise(F.col("folder_a"))
    pairs, _ = write_scratch(decided.select("folder_a", "folder_b", win.alias("win"), lose.alias("lose")).distinct(), "decided")
    rows, _ = write_scratch(files.where("status <> 'error'").select("file_id", "sha256", "status", parent(F.col("path")).alias("home")).where("home is not null"), "homes")
    # decided folders meet distinct parent folders first; a file is read once for each decision above it
    named = pairs.select(F.explode(F.array("win", "lose")).alias("folder")).distinct()
    chains, _ = write_scratch(folder_chains(rows.select("home").distinct()).join(named, "folder"), "chains")
    kept = rows.where("sha256 is not null").join(chains.join(pairs.select(F.col("win").alias("folder")).distinct(), "folder"), "home").groupBy("folder", "sha256").agg(F.min("file_id").alias("keeper"))
    losing = rows.where("status <> 'done'").join(chains.join(pairs.withColumnRenamed("lose", "folder"), "folder"), "home")
    met = losing.select("folder_a", "folder_b", "win", "file_id", "sha256").join(kept.withColumnRenamed("folder", "win"), ["win", "sha256"], "left")
    met, _ = write_scratch(met, "merged")
    losers = met.where("keeper is not null").groupBy("file_id").agg(F.min("keeper").alias("keeper"))
    unique = met.groupBy("folder_a", "folder_b").agg(F.count_if(F.col("keeper").isNull()).alias("unique_count"))
    return losers, unique
