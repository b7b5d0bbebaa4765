"""Review decisions as new versions of the link and overlap tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending_overlaps(overlaps: DataFrame, pending_only: bool = True) -> DataFrame:
    """Stored folder overlaps, the most shared files first, equal ones by folders."""
    rows = overlaps.where("status = 'pending'") if pending_only else overlaps
    return rows.orderBy(F.desc("shared_count"), "folder_a", "folder_b")


def _known(table: DataFrame, change: DataFrame, key: str) -> None:
    lost = [r[0] for r in change.select(key).join(table.select(key), key, "left_anti").limit(1).collect()]
    if lost:
        raise KeyError(lost[0])


def decide_overlaps(overlaps: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """``overlaps`` (overlap_id, ..., keeper, status, reviewed_at) with decisions
    (overlap_id, keeper) taken over as reviewed; KeyError for an unknown id. Of
    several decisions of one overlap the greatest keeper holds."""
    _known(overlaps, decisions, "overlap_id")
    d = decisions.groupBy("overlap_id").agg(F.max("keeper").alias("_k"), F.lit(True).alias("_hit"))
    put = {"keeper": F.when(F.col("_hit"), F.col("_k")).otherwise(F.col("keeper")), "status": F.when(F.col("_hit"), "reviewed").otherwise(F.col("status")), "reviewed_at": F.when(F.col("_hit"), now).otherwise(F.col("reviewed_at"))}
    return overlaps.join(d, "overlap_id", "left").select(*[put[c].alias(c) if c in put else F.col(c) for c in overlaps.columns])


def reopen_overlaps(overlaps: DataFrame, ids: DataFrame) -> DataFrame:
    """The overlaps of ``ids`` (overlap_id) are pending again and keep their keeper; KeyError for an unknown id."""
    _known(overlaps, ids, "overlap_id")
    hit = ids.select("overlap_id").distinct().withColumn("_hit", F.lit(True))
    put = {"status": F.when(F.col("_hit"), "pending").otherwise(F.col("status")), "reviewed_at": F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("reviewed_at"))}
    return overlaps.join(hit, "overlap_id", "left").select(*[put[c].alias(c) if c in put else F.col(c) for c in overlaps.columns])


def _inside(duplicates: DataFrame, selection: DataFrame, *columns: str) -> DataFrame:
    """Links with both sides in one cluster of ``selection`` (file_id, cluster_id, ...)."""
    side = lambda x: selection.select(F.col("file_id").alias(f"file_id_{x}"), F.col("cluster_id").alias(f"_c{x}"), *[F.col(c).alias(f"_{c}_{x}") for c in columns])
    return duplicates.join(side("a"), "file_id_a", "left").join(side("b"), "file_id_b", "left").withColumn("_near", F.coalesce((F.col("dup_type") == "NEAR") & (F.col("_ca") == F.col("_cb")), F.lit(False)))


def record_selection(duplicates: DataFrame, selection: DataFrame, ranked: DataFrame, now: Column) -> DataFrame:
    """New version of the links after a review of clusters.

    ``selection`` is (file_id, cluster_id, kept), one row a member; ``ranked``
    has keep_rank. If a cluster drops nothing, its pending NEAR links are
    reviewed without a keeper. With one kept file they are reviewed with it.
    With several, each dropped file is reviewed against the best kept one, and
    all other pending links of the cluster without a keeper. A link of the
    keeper with a dropped file is reviewed whatever its state, and is added,
    with a null dup_id, if there is none; an EXACT link of the two is left
    alone. Clusters that drop everything are not decided.
    """
    s = selection.select("file_id", "cluster_id", F.coalesce("kept", F.lit(True)).alias("kept"))
    best = s.join(ranked.select("file_id", "keep_rank"), "file_id", "left").groupBy("cluster_id").agg(F.max(F.when(F.col("kept"), F.struct("keep_rank", (-F.col("file_id")).alias("i")))).alias("_b"), F.count_if("kept").alias("_kept"), F.count_if(~F.col("kept")).alias("_dropped"))
    s = s.join(best.where("_kept > 0").select("cluster_id", (-F.col("_b.i")).alias("keeper"), "_kept", "_dropped"), "cluster_id")
    j = _inside(duplicates, s, "kept", "keeper", "_kept", "_dropped")
    keeper = F.col("_keeper_a")
    of_keeper = (F.col("_dropped_of") > 0) & (((F.col("file_id_a") == keeper) & ~F.col("_kept_b")) | ((F.col("file_id_b") == keeper) & ~F.col("_kept_a")))
    j = j.withColumn("_dropped_of", F.col("__dropped_a"))
    whole = (F.col("_dropped_of") > 0) & (F.col("__kept_a") == 1)
    direct = F.col("_near") & F.coalesce(of_keeper, F.lit(False))
    pending = F.col("_near") & (F.col("status") == "pending")
    put = {
        "keep_file_id": F.when(direct, keeper).when(pending & whole, keeper).when(pending, F.lit(None)).otherwise(F.col("keep_file_id")),
        "status": F.when(direct | pending, "reviewed").otherwise(F.col("status")),
        "resolved_at": F.when(direct | pending, now).otherwise(F.col("resolved_at")),
    }
    out = j.select(*[put[c].alias(c) if c in put else F.col(c) for c in duplicates.columns])
    have = duplicates.select(F.least("file_id_a", "file_id_b").alias("file_id_a"), F.greatest("file_id_a", "file_id_b").alias("file_id_b")).distinct()
    lost = s.where("not kept").select(F.least("file_id", "keeper").alias("file_id_a"), F.greatest("file_id", "keeper").alias("file_id_b"), F.col("keeper").alias("keep_file_id")).join(have, ["file_id_a", "file_id_b"], "left_anti")
    given = {"dup_type": F.lit("NEAR"), "status": F.lit("reviewed"), "resolved_at": now}
    types = dict(duplicates.dtypes)
    new = lost.select(*[F.col(c) if c in lost.columns else given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in duplicates.columns])
    return out.unionByName(new)


def clear_decisions(duplicates: DataFrame, clusters: DataFrame) -> DataFrame:
    """All NEAR links inside a cluster of ``clusters`` (file_id, cluster_id) are
    pending again, without a keeper; repeating it changes nothing."""
    j = _inside(duplicates, clusters)
    return j.select(*[F.when(F.col("_near"), F.lit("pending") if c == "status" else F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("status", "keep_file_id", "resolved_at") else F.col(c) for c in duplicates.columns])


def review_order(clusters: DataFrame) -> DataFrame:
    """(cluster_id, min_hamming, members) of near clusters, the closest and then the largest first."""
    return clusters.groupBy("cluster_id").agg(F.min("min_hamming").alias("min_hamming"), F.count("*").alias("members")).orderBy("min_hamming", F.desc("members"), "cluster_id")
