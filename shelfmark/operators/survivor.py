"""Choosing which copy survives: rank, redundant copies, near clusters, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.classify import COPY_TYPES
from shelfmark.functions.naming import derivative_root, has_event_parent, is_camera_name
from shelfmark.functions.paths import base_name, norm_stem, parent
from shelfmark.operators.graph import connected_components
from shelfmark.operators.pairs import junk_keys, star_edges
from shelfmark.runtime import write_scratch

#: Aspect ratios of copies of one frame differ by at most this.
ASPECT = 0.02
#: Links of near clusters differ in at most this many bits.
CLUSTER_BITS = 2
#: Images below this many pixels on a side are degenerate; below this share of the sharpest, soft.
MIN_SIDE, SOFT = 200, 0.55


def own_cameras(cameras: DataFrame, owner: str = "self") -> DataFrame:
    """Distinct lower-case models of one owner; makes are ignored."""
    return cameras.where(F.col("owner") == owner).select(F.lower("model").alias("own_model")).where(F.col("own_model").isNotNull()).distinct()


def with_rank(files: DataFrame, cameras: DataFrame) -> DataFrame:
    """Add ``keep_rank``: greater is better. Area, size, own camera, event-named
    parent, shorter path, smaller id; nulls count as 0. Folder names are judged
    once each, as they are far fewer than files."""
    name = F.coalesce(base_name(parent(F.col("path"))), F.lit(""))
    names = files.select(name.alias("_folder")).distinct().withColumn("_event", has_event_parent(F.col("_folder")).cast("int"))
    joined = files.withColumn("_folder", name).join(names, "_folder", "left").join(own_cameras(cameras), F.lower("camera_model") == F.col("own_model"), "left")
    area = F.coalesce(F.col("width").cast("long"), F.lit(0)) * F.coalesce("height", F.lit(0))
    rank = F.struct(
        area.alias("area"),
        F.coalesce("size_bytes", F.lit(0)).alias("size"),
        F.coalesce(F.col("own_model") != "", F.lit(False)).cast("int").alias("own"),
        F.coalesce("_event", F.lit(0)).alias("event"),
        (-F.length("path")).alias("short"),
        (-F.col("file_id")).alias("first"),
    )
    return joined.select(*files.columns, rank.alias("keep_rank"))


def best_of(ranked: DataFrame, group: str, keeper: str = "keeper") -> DataFrame:
    """(group, keeper, members): partial aggregates carry groups of any size."""
    return ranked.groupBy(group).agg(F.max("keep_rank").alias("_r"), F.count("*").alias("members")).select(group, (-F.col("_r.first")).alias(keeper), "members")


def exact_groups(duplicates: DataFrame) -> DataFrame:
    """(file_id, group_id) of the components of EXACT links. The links are the
    contract: equal hashes without a link are no group."""
    return connected_components(duplicates.where("dup_type = 'EXACT'"), "file_id_a", "file_id_b", "file_id", "group_id")


def exact_losers(duplicates: DataFrame, ranked: DataFrame) -> DataFrame:
    """(file_id, keeper): members of EXACT groups but the best; members missing
    from the files can neither win nor lose."""
    members = exact_groups(duplicates).join(ranked.select("file_id", "keep_rank"), "file_id")
    keep = best_of(members, "group_id")
    return members.join(keep, "group_id").where(F.col("file_id") != F.col("keeper")).select("file_id", "keeper")


def near_losers(duplicates: DataFrame) -> DataFrame:
    """(file_id, keeper): the other side of reviewed NEAR links with a keeper; of
    several links of one loser the one with the greatest dup_id."""
    rows = duplicates.where("dup_type = 'NEAR' and status = 'reviewed' and keep_file_id is not null")
    loser = F.when(F.col("keep_file_id") == F.col("file_id_b"), F.col("file_id_a")).otherwise(F.col("file_id_b"))
    return rows.groupBy(loser.alias("file_id")).agg(F.max_by("keep_file_id", "dup_id").alias("keeper"))


def _shot_edges(copies: DataFrame) -> DataFrame:
    """Links between files of the same stem and moment whose aspect ratios are
    close. Sorted by ratio, a file is linked with its neighbours within the
    tolerance: the components are those of all close pairs, with one link a file."""
    shot = Window.partitionBy("stem", "datetime_original").orderBy("aspect", "file_id")
    step = copies.select("file_id", "aspect", F.lag("file_id").over(shot).alias("b"), F.lag("aspect").over(shot).alias("before"))
    return step.where(F.col("aspect") - F.col("before") <= ASPECT).select(F.col("file_id").alias("a"), "b")


def _content_edges(copies: DataFrame, junk: DataFrame) -> DataFrame:
    """Links between files of the same moment and fingerprint: exports with the
    best camera original, or with each other where there is none. Two camera
    originals are different frames."""
    rows = copies.where("phash is not null and phash <> ''").join(junk.select("phash"), "phash", "left_anti")
    keys = ["datetime_original", "phash"]
    anchors = rows.groupBy(*keys).agg(F.max(F.when(F.col("camera_name"), F.col("keep_rank"))).alias("r"), F.min("file_id").alias("least"))
    anchor = F.coalesce(-F.col("r.first"), F.col("least"))
    linked = rows.where(~F.col("camera_name")).join(anchors, keys).select(F.col("file_id").alias("a"), anchor.alias("b"))
    return linked.where(F.col("a") != F.col("b"))


def redundant_copies(files: DataFrame, ranked: DataFrame) -> DataFrame:
    """(file_id, keeper): copies of a shot of which a better version survives.

    Copies are JPEG and HEIC files with a date and positive dimensions that are
    linked by name and moment with a close aspect ratio, or by moment and
    fingerprint. In addition a file in an export folder is redundant if a file
    of the same stem lies under the folder above, outside any export folder; a
    link found before keeps its keeper, else the master of the smallest id wins.
    Raw files and videos are never redundant.
    """
    base = ranked.where(F.col("file_type").isin(*COPY_TYPES) & (F.col("width") > 0) & (F.col("height") > 0)).withColumn("stem", norm_stem(F.col("filename")))
    copies = base.where("datetime_original is not null").select("file_id", "stem", "datetime_original", "phash", "keep_rank", (F.col("width") / F.col("height")).alias("aspect"), is_camera_name(F.col("filename")).alias("camera_name"))
    copies, _ = write_scratch(copies, "copies")
    links = _shot_edges(copies).unionByName(_content_edges(copies, junk_keys(files, "phash")))
    groups = connected_components(links, "a", "b", "file_id", "component").join(copies.select("file_id", "keep_rank"), "file_id")
    by_shot = groups.join(best_of(groups, "component"), "component").where(F.col("file_id") != F.col("keeper")).select("file_id", "keeper")
    by_folder = derivative_copies(files, base)
    return by_shot.withColumn("p", F.lit(0)).unionByName(by_folder.withColumn("p", F.lit(1))).groupBy("file_id").agg(F.min_by("keeper", F.struct("p", "keeper")).alias("keeper"))


def derivative_copies(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(file_id, keeper) of files in export folders with a master of the same
    stem below the folder above. The stem is the equi-join key; the prefix is checked after."""
    masters = files.where(derivative_root(F.col("path")).isNull()).select(norm_stem(F.col("filename")).alias("stem"), F.lower(parent(F.col("path"))).alias("folder"), F.col("file_id").alias("master"))
    exports = candidates.select("file_id", norm_stem(F.col("filename")).alias("stem"), derivative_root(F.col("path")).alias("root")).where("root is not null")
    return exports.join(masters, "stem").where(F.col("folder").startswith(F.col("root"))).groupBy("file_id").agg(F.min("master").alias("keeper"))


def is_degenerate(width: Column, height: Column, size: Column) -> Column:
    side = F.least(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)))
    return (side < MIN_SIDE) | (F.coalesce(size, F.lit(0)) == 0)


def near_clusters(files: DataFrame, duplicates: DataFrame, ranked: DataFrame, redundant: DataFrame | None = None, bits: int = CLUSTER_BITS) -> DataFrame:
    """(file_id, cluster_id, min_hamming): components of pending NEAR links of at
    most ``bits`` (null counts as 0), without members that lose an exact group by
    hash, files whose fingerprint is junk, and redundant copies."""
    by_sha = ranked.where("sha256 is not null").select("sha256", "file_id", "keep_rank")
    losers = by_sha.join(best_of(by_sha, "sha256").where("members > 1"), "sha256").where(F.col("file_id") != F.col("keeper")).select("file_id")
    junk = files.join(junk_keys(files, "phash").select("phash"), "phash", "left_semi").select("file_id")
    out = losers.unionByName(junk)
    if redundant is not None:
        out = out.unionByName(redundant.select("file_id"))
    out, _ = write_scratch(out.distinct(), "excluded")
    links = duplicates.where("dup_type = 'NEAR' and status = 'pending' and file_id_a <> file_id_b").select("file_id_a", "file_id_b", F.coalesce("hamming_distance", F.lit(0)).alias("h")).where(F.col("h") <= bits)
    links = links.join(out.select(F.col("file_id").alias("file_id_a")), "file_id_a", "left_anti").join(out.select(F.col("file_id").alias("file_id_b")), "file_id_b", "left_anti")
    links, _ = write_scratch(links, "near-links")
    nodes = connected_components(links, "file_id_a", "file_id_b", "file_id", "cluster_id")
    least = links.join(nodes.select(F.col("file_id").alias("file_id_a"), "cluster_id"), "file_id_a").groupBy("cluster_id").agg(F.min("h").alias("min_hamming"))
    return nodes.join(least, "cluster_id").select("file_id", "cluster_id", "min_hamming")


def resolve_clusters(clusters: DataFrame, ranked: DataFrame) -> DataFrame:
    """(cluster_id, stem, members, keeper, degenerate, several_stems): inside a
    cluster files of one stem are one decision; with a degenerate member, or
    alone, no keeper is chosen (null)."""
    rows = clusters.select("file_id", "cluster_id").join(ranked.select("file_id", norm_stem(F.col("filename")).alias("stem"), "keep_rank", is_degenerate(F.col("width"), F.col("height"), F.col("size_bytes")).alias("bad")), "file_id")
    by = rows.groupBy("cluster_id", "stem").agg(F.count("*").alias("members"), F.max("keep_rank").alias("r"), F.bool_or("bad").alias("degenerate"))
    stems = by.groupBy("cluster_id").agg((F.count("*") > 1).alias("several_stems"))
    keeper = F.when(~F.col("degenerate") & (F.col("members") > 1), -F.col("r.first"))
    return by.join(stems, "cluster_id").select("cluster_id", "stem", "members", keeper.alias("keeper"), "degenerate", "several_stems")


def soft_frames(scores: DataFrame, cluster: str = "cluster_id", score: str = "sharpness") -> DataFrame:
    """Add ``soft``: below SOFT of the sharpest of the cluster; null scores are not soft."""
    best = scores.groupBy(cluster).agg(F.max(score).alias("_m"))
    return scores.join(best, cluster, "left").withColumn("soft", F.coalesce(F.col(score) < SOFT * F.col("_m"), F.lit(False))).drop("_m")


def default_selection(clusters: DataFrame, ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """(file_id, cluster_id, keep): the frames that are kept at first. A cluster
    of one stem keeps its best; another keeps every frame that is not soft, and
    all of them if none would be left. ``scores`` is (file_id, sharpness)."""
    rows = clusters.select("file_id", "cluster_id").join(ranked.select("file_id", norm_stem(F.col("filename")).alias("stem"), "keep_rank"), "file_id").join(scores, "file_id", "left")
    rows = soft_frames(rows)
    whole = rows.groupBy("cluster_id").agg((F.min("stem") == F.max("stem")).alias("one"), F.max("keep_rank").alias("best"), F.bool_and("soft").alias("all_soft"))
    keep = F.when(F.col("one"), F.col("keep_rank") == F.col("best")).otherwise(~F.col("soft") | F.col("all_soft"))
    return rows.join(whole, "cluster_id").select("file_id", "cluster_id", keep.alias("keep"))


def apply_decisions(duplicates: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """New version of the link table: pending NEAR links with both sides in one
    decided cluster become reviewed with its keeper (null keeps all).

    ``decisions`` is (file_id, cluster_id, keeper), one row a member."""
    side = lambda c: decisions.select(F.col("file_id").alias(c), F.col("cluster_id").alias(f"_{c}"), F.col("keeper").alias(f"_k_{c}"))
    joined = duplicates.join(side("file_id_a"), "file_id_a", "left").join(side("file_id_b").drop("_k_file_id_b"), "file_id_b", "left")
    hit = (F.col("dup_type") == "NEAR") & (F.col("status") == "pending") & (F.col("_file_id_a") == F.col("_file_id_b"))
    hit = F.coalesce(hit, F.lit(False))
    return joined.select(*[F.when(hit, v).otherwise(F.col(c)).alias(c) if (v := {"keep_file_id": F.col("_k_file_id_a"), "status": F.lit("reviewed"), "resolved_at": now}.get(c)) is not None else F.col(c) for c in duplicates.columns])


def exact_star_edges(files: DataFrame) -> DataFrame:
    """EXACT links of the detector, one a file: every file of a hash with the first."""
    return star_edges(files.where("status <> 'error'"), "sha256", "file_id").select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))
