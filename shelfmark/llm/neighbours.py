"""Most similar vectors for every vector, through balanced posting lists.

Centroids are a bounded sample of the vectors, linked in an in-memory graph.
Every vector is stored in the lists of its nearest centroids as far as the ratio
of distances allows, so vectors near a border lie in several lists, and it
searches somewhat more lists than it is stored in. A list that grows beyond the
balance gets centroids of its own and is divided like the whole, level by level,
so lists keep their size as the collection grows. Distances inside a list are
exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.hashes import hex_to_long, long_to_hex, valid_hex
from shelfmark.runtime import drop_scratch, slots, write_scratch

#: Vectors a centroid stands for, and the most centroids: the index is fitted on at most this many sampled vectors.
PER_LIST, MAX_CENTROIDS = 96, 16_384
#: Lists that hold a copy of a vector, and lists that a vector searches, at most.
COPIES, SEARCHED = 8, 16
#: A list is used if its centroid is at most this many times as far as the nearest one (and never pruned within FLOOR bits).
RATIO, FLOOR = 1.35, 20
#: Links of a centroid in the graph, centroids kept while searching it, rounds of expansion.
LINKS, BEAM, ROUNDS = 24, 24, 3
#: Stored vectors of a list above which it is divided by centroids of its own; what cannot be divided is compared in parts of this size.
PART = 4096
#: Levels of division at most; list numbers of all levels fit 63 bits.
LEVELS = 4
#: Centroids of one divided list, the lists inside it that hold a copy and that a vector searches, at most.
INNER, INNER_COPIES, INNER_SEARCHED = 256, 4, 8


def hamming_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


class CentroidGraph:
    """Centroids with links to their nearest others; entry points are a small
    sample of them. Memory: MAX_CENTROIDS * (8 + 4 * LINKS) bytes, under 2 MB."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        self.entries = np.arange(0, n, max(1, n // max(32, int(2 * n**0.5))))
        k = min(LINKS, n - 1)
        links = np.empty((n, k), np.int32)
        for at in range(0, n, 256):
            d = hamming_matrix(centroids[at : at + 256], centroids)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = 255
            links[at : at + 256] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
        self.links = links

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids found for each vector: (index, distance), nearest first, -1 where there are fewer."""
        n = len(self.c)
        k = min(k, n)
        beam = min(max(BEAM, k), n)
        best = self._nearest(q, np.broadcast_to(self.entries, (len(q), len(self.entries))), beam)
        for r in range(ROUNDS if self.links.shape[1] else 0):
            width = beam if r else min(beam, 8)
            near = best[0][:, :width]
            more = self.links[near].reshape(len(q), -1)
            best = self._nearest(q, np.concatenate([best[0], more], axis=1), beam)
        return best[0][:, :k], best[1][:, :k]

    def _nearest(self, q: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``keep`` nearest of each row's distinct candidates; ties by index."""
        d = np.bitwise_count(self.c[ids] ^ q[:, None]).astype(np.int64)
        key = (d << 32) | ids
        key.sort(axis=1)
        again = np.zeros(key.shape, bool)
        again[:, 1:] = key[:, 1:] == key[:, :-1]
        if again.any():
            key[again] = np.int64(1) << 62
            part = min(keep, key.shape[1])
            key = np.partition(key, part - 1, axis=1)[:, :part]
            key.sort(axis=1)
        key = key[:, :keep]
        # a row with fewer distinct candidates repeats its nearest
        short = key >> 62 > 0
        key = np.where(short, key[:, :1], key)
        return (key & 0xFFFFFFFF).astype(np.int64), key >> 32


def _assign(keys: DataFrame, graph: CentroidGraph) -> DataFrame:
    """(list, key, stored): lists of each vector; stored if the list keeps a copy."""
    shared = keys.sparkSession.sparkContext.broadcast((graph.c, graph.entries, graph.links))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = CentroidGraph.__new__(CentroidGraph)
        mine.c, mine.entries, mine.links = shared.value
        for batch in batches:
            q_all = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(q_all), 512):
                q = q_all[at : at + 512]
                ids, d = mine.search(q, SEARCHED)
                use = d <= np.maximum(d[:, :1] * RATIO, FLOOR)
                use[:, 1:] &= ids[:, 1:] != ids[:, :1]
                use[:, 0] = True
                row, col = np.nonzero(use)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int64)), pa.array(q[row].view(np.int64)), pa.array(col < COPIES)], names=["list", "key", "stored"])

    return keys.mapInArrow(run, "list long, key long, stored boolean")


def _divide(lists: DataFrame, long: list) -> DataFrame:
    """``lists`` (list, key, stored) with the ``long`` ones (rows of list,
    stored) divided by centroids of their own, a sample of at most about INNER
    of the vectors that each stores. A vector goes on to the inner lists near
    it, so one near a border again lies in several."""
    spark = lists.sparkSession
    sizes = spark.createDataFrame([(r.list, r.stored, min(INNER, -(-r.stored // PER_LIST))) for r in long], "list long, n long, m long")
    marked = lists.join(F.broadcast(sizes), "list", "left")
    chosen = marked.where(F.col("stored") & (F.pmod(F.xxhash64("key", "list"), F.col("n")) < F.col("m"))).groupBy("list").agg(F.collect_set("key").alias("c")).collect()  # a bounded sample: INNER a list, MAX_CENTROIDS * INNER on the first level
    shared = spark.sparkContext.broadcast({r.list: np.array(sorted(r.c), np.int64).view(np.uint64) for r in chosen})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, key, stored = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(name, kind="stable")
            name, key, stored = name[order], key[order].view(np.uint64), stored[order]
            cuts = np.flatnonzero(name[1:] != name[:-1]) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(name)]) if len(name) else ():
                c = shared.value.get(int(name[lo]))
                for at in range(lo, hi, 2048):
                    q, kept = key[at : min(at + 2048, hi)], stored[at : min(at + 2048, hi)]
                    if c is None:
                        out.append((name[at : at + len(q)], q, kept))
                        continue
                    d = hamming_matrix(q, c).astype(np.int64)
                    near = np.sort(d << 32 | np.arange(len(c)), axis=1)[:, :INNER_SEARCHED]
                    ids, d = near & 0xFFFFFFFF, near >> 32
                    row, col = np.nonzero(d <= np.maximum(d[:, :1] * RATIO, FLOOR))
                    out.append((name[lo] * (2 * INNER + 1) + 1 + ids[row, col], q[row], kept[row] & (col < INNER_COPIES)))
            if out:
                a, b, e = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.view(np.int64)), pa.array(e)], names=["list", "key", "stored"])

    whole = marked.where("n is null").select((F.col("list") * (2 * INNER + 1)).alias("list"), "key", "stored")
    return whole.unionByName(marked.where("n is not null").select("list", "key", "stored").mapInArrow(run, "list long, key long, stored boolean"))


def _compare(q: np.ndarray, m: np.ndarray, radius: int, k: int) -> pd.DataFrame:
    """Both directions of every pair within ``radius``, the k best of each vector
    by (distance, unsigned key)."""
    found = []
    step = max(1, (1 << 19) // max(1, len(m)))
    for at in range(0, len(q), step):
        d = hamming_matrix(q[at : at + step], m)
        i, j = np.nonzero(d <= radius)
        a, b, dist = q[at + i], m[j], d[i, j]
        other = a != b
        a, b, dist = a[other], b[other], dist[other]
        found.append((np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([dist, dist])))
    a, b, d = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64),) * 3
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, d = a[fresh], b[fresh], d[fresh]
    first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.empty(0, bool)
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else np.empty(0, int)
    keep = rank < k
    return a[keep], b[keep], d[keep]


def nearest_keys(keys: DataFrame, k: int = 3, radius: int = 6) -> DataFrame:
    """(key, other, distance): for each distinct 64-bit key up to k others within
    ``radius`` bits, nearest first, equal distances by unsigned key.

    Approximate: a neighbour is missed if no list of one vector is shared with
    the other. Null keys are left out; repeated keys count once; fewer than two
    keys give an empty result.
    """
    spark = keys.sparkSession
    keys, _ = write_scratch(keys.where(F.col("key").isNotNull()).select("key").distinct(), "vectors")
    n = keys.count()
    empty = spark.createDataFrame([], "key long, other long, distance int")
    if n < 2:
        return empty
    wanted = int(min(MAX_CENTROIDS, max(1, n // PER_LIST)))
    sample = keys.select("key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(wanted).collect()  # at most MAX_CENTROIDS rows
    graph = CentroidGraph(np.array([r.key for r in sample], np.int64).view(np.uint64))
    parts = max(slots(spark) * 2, int(n // 100_000))
    lists, lists_at = write_scratch(_assign(keys.repartition(parts), graph), "posting-lists")
    size_of = lambda rows: rows.groupBy("list").agg(F.count_if("stored").alias("stored"), F.count("*").alias("all")).where(F.col("all") > PART).collect()  # noqa: E731 - long lists only
    sizes, longest = size_of(lists), None
    for _ in range(LEVELS):
        deep = [r for r in sizes if r.stored > PART]
        top = max((r.stored for r in deep), default=0)
        if not deep or longest is not None and top > 0.8 * longest:
            break  # balanced, or its vectors cannot be told apart
        longest = top
        divided, divided_at = write_scratch(_divide(lists, deep), "posting-lists")
        drop_scratch(spark, lists_at)
        lists, lists_at, sizes = divided, divided_at, size_of(divided)
    if sizes:
        # a long list becomes a grid of parts: stored copies by columns, searches by rows; a copy goes once to each row, a search once to each column
        divided = spark.createDataFrame([(r.list, max(1, -(-r.stored // PART)), max(1, -(-r["all"] // PART))) for r in sizes], "list long, cols int, rows int")
        lists = lists.join(F.broadcast(divided), "list", "left").select("list", "key", "stored", F.coalesce("cols", F.lit(1)).alias("cols"), F.coalesce("rows", F.lit(1)).alias("rows"))
        col, row = F.pmod(F.xxhash64("key", F.lit(1)), F.col("cols")).cast("int"), F.pmod(F.xxhash64("key", F.lit(2)), F.col("rows")).cast("int")
        seek = lists.select("list", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), "key", F.lit(False).alias("stored"))
        kept = lists.where("stored").select("list", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), col.alias("col"), "key", "stored")
        lists = seek.unionByName(kept)
        both = False
    else:
        lists = lists.select("list", F.lit(0).alias("row"), F.lit(0).alias("col"), "key", "stored")
        both = True  # a stored copy is its own search too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            keys_, stored = (np.concatenate(x) for x in zip(*held))
            m = keys_[stored]
            a, b, d = _compare(keys_ if both else keys_[~stored], m, radius, k)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d.astype(np.int32))], names=["key", "other", "distance"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            key, stored = batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy(zero_copy_only=False)
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                now = tuple(place[:, lo])
                if held and now != last:
                    yield close()
                    held.clear()
                last = now
                held.append((key[lo:hi], stored[lo:hi]))
        if held:
            yield close()

    grouped = lists.repartition(parts, "list", "row", "col").sortWithinPartitions("list", "row", "col")
    found = grouped.mapInArrow(run, "key long, other long, distance int").distinct()
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", long_to_hex(F.col("other")).alias("text"), "other"))), 1, k)  # at most k rows a list, so SEARCHED * parts * k in all
    return found.groupBy("key").agg(best.alias("b")).select("key", F.explode("b").alias("b")).select("key", F.col("b.other").alias("other"), F.col("b.distance").alias("distance"))


def similar_hashes(files: DataFrame, column: str = "phash", k: int = 3, radius: int = 6) -> DataFrame:
    """(phash_a, phash_b), a < b: unordered pairs of distinct valid hashes of
    which one is among the k nearest of the other and within ``radius`` bits."""
    text = valid_hex(F.col(column), 16)
    keys = files.select(text.alias("t")).where(F.col("t").isNotNull()).select(hex_to_long(F.col("t")).alias("key"))
    near = nearest_keys(keys, k, radius).select(long_to_hex(F.col("key")).alias("x"), long_to_hex(F.col("other")).alias("y"))
    return near.select(F.least("x", "y").alias("phash_a"), F.greatest("x", "y").alias("phash_b")).distinct()
