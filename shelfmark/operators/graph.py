"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import drop_scratch, hot_join, hot_keys, write_scratch


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star operation on edges (u, v) with u > v: each vertex links its
    larger (or smaller) neighbours to its smallest neighbour."""
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # the root of a large group is a hub: its row is sent to its edges
    linked = hot_join(sides, least, "u", hot=hot_keys(sides, "u", (1 + large) * total))
    if large:
        linked = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return linked.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, node: str = "node", component: str = "component") -> DataFrame:
    """(node, component): every endpoint with the smallest endpoint it is
    connected with. Null endpoints and loops are left out; repeated and turned
    edges count once. Each round halves the depth of the trees, and the edges
    of a round are written to the shared folder, so no lineage grows.
    """
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, path = write_scratch(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "star-edges")
    spark, before = edges.sparkSession, None
    while True:
        tally = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == tuple(tally):
            break
        before = tuple(tally)
        following, at = write_scratch(_stars(_stars(now, True, before[0]), False, before[0]), "star-edges")
        drop_scratch(spark, path)
        now, path = following, at
    roots = now.select(F.col("v").alias(node)).distinct().withColumn(component, F.col(node))
    return now.select(F.col("u").alias(node), F.col("v").alias(component)).unionByName(roots)
