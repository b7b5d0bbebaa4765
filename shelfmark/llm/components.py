"""Groups of records from pairwise matches: components by low-diameter decomposition.

Each level grows clusters from exponentially shifted start times, contracts
every cluster to one super-vertex, keeps only the edges between clusters and
recurses on them; at the end the assignments of all levels are composed. The
number of edges falls geometrically with the levels, and a cluster grows for
O(log n / RATE) steps, so the jobs follow the square of the logarithm even on
long chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import drop_scratch, exists, hot_join, hot_keys, write_scratch

#: Rate of the exponential start shifts. An edge is cut with a probability of at most 1 - exp(-RATE), so a level leaves
#: at most 26 % of the edges on average, and no cluster grows for more steps than the largest shift, about ln(n) / RATE.
RATE = 0.3
#: First steps of growth, in which all labels travel, that are done in one go; most groups are settled then.
STRIDE = 3
_SEED = 0x5EED


def _uniform(vertex: Column, level: int) -> Column:
    """A value in (0, 1) that depends only on vertex and level, so that a task
    that is run again after a lost executor draws the same shifts."""
    return (F.shiftrightunsigned(F.xxhash64(vertex, F.lit(_SEED + level)), 11).cast("double") + 0.5) / F.lit(float(2**53))


def _decompose(edges: DataFrame, level: int, hot: DataFrame | None) -> tuple[DataFrame, str]:
    """(v, c): the cluster of each vertex of symmetric ``edges`` (u, v), loops
    included: an edge without length from each vertex to itself, which keeps
    its own label.

    Vertex u starts at minus its exponential shift, and its label crosses one
    edge in one unit of time; every vertex keeps the label that arrives first,
    and growth goes on until no label changes. A label is (arrival, tie,
    centre), smaller is better. After the first steps only labels that changed
    in the last step travel on. The labels of hot vertices are sent to the
    edges, not the edges to them.
    """
    spark = edges.sparkSession
    start = F.struct((F.log(_uniform(F.col("u"), level)) / RATE).alias("at"), F.xxhash64("u", F.lit(level)).alias("tie"), F.col("u").alias("c"))
    labels = edges.where("u = v").select("u", start.alias("best"))
    moved = lambda: F.struct((F.col("best.at") + (F.col("u") != F.col("v")).cast("int")).alias("at"), F.col("best.tie").alias("tie"), F.col("best.c").alias("c")).alias("best")
    for _ in range(STRIDE):
        sent = hot_join(edges, labels, "u", hot=hot).select("v", moved(), F.when(F.col("u") == F.col("v"), F.col("best")).alias("had"))
        labels = sent.groupBy("v").agg(F.min("best").alias("best"), F.max("had").alias("had")).select(F.col("v").alias("u"), "best", (F.col("best") != F.col("had")).alias("fresh"))
    path = None
    while True:
        # the changed labels lie in files of their own, so a few of them are broadcast by their known size and the edges stay where they are
        labels, following = write_scratch(labels, f"ldd-labels-{level}", ["fresh"])
        drop_scratch(spark, path)
        path, held = following, labels.select("u", "best", F.col("best").alias("had"))
        if not exists(spark, f"{path}/fresh=true"):
            return labels.select(F.col("u").alias("v"), F.col("best.c").alias("c")), path
        fresh = spark.read.schema("u long, best " + held.schema["best"].dataType.simpleString()).parquet(f"{path}/fresh=true")
        sent = hot_join(edges, fresh, "u", hot=hot).where("u <> v").select("v", moved()).select(F.col("v").alias("u"), "best", F.lit(None).cast(held.schema["had"].dataType).alias("had"))
        labels = held.unionByName(sent).groupBy("u").agg(F.min("best").alias("best"), F.max("had").alias("had")).select("u", "best", (F.col("best") != F.col("had")).alias("fresh"))


def connected_groups(pairs: DataFrame, a: str = "file_id_a", b: str = "file_id_b", out: str = "file_id", group: str = "group_id") -> DataFrame:
    """(out, group): every record that occurs in a pair with its group, the
    smallest record identifier reachable from it.

    Pairs with a null side and pairs of a record with itself link nothing and
    give no row; repeated and turned pairs count once. No pairs give an empty
    result. All other columns are ignored. Identifiers are 64-bit integers.
    """
    spark = pairs.sparkSession
    links = pairs.select(F.least(F.col(a), F.col(b)).cast("long").alias("u"), F.greatest(F.col(a), F.col(b)).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    way = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    symmetric = links.select(F.explode(F.array(way("u", "v"), way("v", "u"), way("u", "u"), way("v", "v"))).alias("e"))
    edges, edges_at = write_scratch(symmetric.select("e.u", "e.v").distinct(), "ldd-edges-0")
    size = edges.count()
    assignments: list[tuple[DataFrame, str, int]] = []
    level = 0
    while level == 0 or size:
        hot = hot_keys(edges, "u", size)
        clusters, path = _decompose(edges, level, hot)
        assignments.append((clusters, path, size))
        left = clusters.select(F.col("v").alias("u"), F.col("c").alias("cu"))
        # the edges are symmetric, so those that leave a hot vertex are found by the same broadcast from both ends
        between = hot_join(hot_join(edges, left, "u", hot=hot), clusters, "v", hot=hot).where(F.col("cu") != F.col("c"))
        crossing = between.select(F.explode(F.array(way("cu", "c"), way("cu", "cu"))).alias("e")).select("e.u", "e.v").distinct()
        following, following_at = write_scratch(crossing, f"ldd-edges-{level + 1}")
        drop_scratch(spark, edges_at)
        edges, edges_at, level = following, following_at, level + 1
        size = edges.count()
    drop_scratch(spark, edges_at)
    # compose from the last level down: a super-vertex that no edge left is its own root
    root, stale, _ = assignments[-1]
    for clusters, path, n in reversed(assignments[:-1]):
        upper = root.select(F.col("v").alias("c"), F.col("c").alias("r"))
        composed, composed_at = write_scratch(hot_join(clusters, upper, "c", "left", hot_keys(clusters, "c", n)).select("v", F.coalesce("r", "c").alias("c")), "ldd-root")
        drop_scratch(spark, stale, path)
        root, stale = composed, composed_at
    smallest = root.groupBy("c").agg(F.min("v").alias(group))
    return hot_join(root, smallest, "c", hot=hot_keys(root, "c", assignments[0][2])).select(F.col("v").alias(out), group)


def counted_links(duplicates: DataFrame, max_distance: int = 2) -> DataFrame:
    """Rows of ``duplicates`` that link two different files: dup_type EXACT, or
    a hamming_distance (null counts as 0) of at most ``max_distance``."""
    return duplicates.where((F.col("file_id_a") != F.col("file_id_b")) & ((F.col("dup_type") == "EXACT") | (F.coalesce("hamming_distance", F.lit(0)) <= max_distance)))
