"""Pair search: equal keys, Hamming range joins, edge normalisation."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.hashes import hamming
from shelfmark.runtime import BROADCAST_ROWS, hot_join, hot_keys, number_rows, write_scratch

#: A fingerprint held by so many files says nothing.
JUNK = 8
#: Distinct keys of one band code above which they are divided by the other bands.
HOT_CODE = 4096


def normalise_edges(edges: DataFrame, a: str = "file_id_a", b: str = "file_id_b") -> DataFrame:
    """(a, b, dup_type, hamming_distance) with a < b, one row a pair; EXACT
    comes before NEAR, then the smaller distance (null last). Loops and rows with a null side go."""
    rank = F.struct((F.col("dup_type") != "EXACT").alias("r"), F.col("hamming_distance").isNull().alias("n"), "hamming_distance", "dup_type")
    clean = edges.where(F.col(a) != F.col(b))
    return clean.groupBy(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).agg(F.min(rank).alias("x")).select(a, b, F.col("x.dup_type").alias("dup_type"), F.col("x.hamming_distance").alias("hamming_distance"))


def insert_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` edges whose pair is not yet among ``existing``, normalised."""
    keys = existing.select(F.least("file_id_a", "file_id_b").alias("file_id_a"), F.greatest("file_id_a", "file_id_b").alias("file_id_b")).distinct()
    return normalise_edges(new).join(keys, ["file_id_a", "file_id_b"], "left_anti")


def equal_key_groups(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """(key, first_id, members): keys held by more than one row, without listing the rows."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_).alias("first_id"), F.count("*").alias("members")).where("members > 1")


def star_edges(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """(a, b): every row of a key linked with the key's smallest id: the same
    components as all pairs, with one edge a row."""
    first = equal_key_groups(rows, key, id_).select(key, F.col("first_id").alias("a"))
    return rows.where(F.col(key).isNotNull()).join(first, key).where(F.col(id_) != F.col("a")).select("a", F.col(id_).alias("b"))


def new_exact_links(duplicates: DataFrame, rows: DataFrame, key: str = "sha256", id_: str = "file_id") -> DataFrame:
    """EXACT links to be merged into ``duplicates``: each file of a key with the
    key's smallest id, however many files hold the key. A pair recorded as NEAR
    only is linked too, as the components follow EXACT links."""
    stars = star_edges(rows, key, id_).select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"), F.lit("EXACT").alias("dup_type"), F.lit(0).alias("hamming_distance"))
    return insert_edges(duplicates.where("dup_type = 'EXACT'"), stars)


def _bands(radius: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Bands (offset, width) of a 64-bit key and the bits to search around each,
    so that any two keys within ``radius`` meet in one band."""
    n = max(1, min(4, radius + 1))
    width, more = divmod(64, n)
    bands, at = [], 0
    for i in range(n):
        w = width + (i < more)
        bands.append((at, w))
        at += w
    each, extra = divmod(radius + 1, n)
    return bands, [each + (i < extra) - 1 for i in range(n)]


def _band(key: Column, at: int, width: int) -> Column:
    cut = F.shiftrightunsigned(key, at) if at else key
    return cut.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else cut


def hamming_pairs(left: DataFrame, right: DataFrame | None, key: str, radius: int) -> DataFrame:
    """(key_a, key_b, hamming): distinct 64-bit keys within ``radius`` bits.

    Without ``right`` each unordered pair of ``left`` comes once (key_a < key_b,
    signed); with it, pairs of a left and a right key, equal keys included. The
    join is an equi-join on bands, so it scales out; codes that many keys share
    are divided further; a pair is reported from the first band it meets in. Null keys match nothing.
    Radius 0 gives no pairs without ``right``. Bounded to radius 23.
    """
    right_side = right
    bands, reach = _bands(radius)
    a = left.where(F.col(key).isNotNull()).select(F.col(key).alias("key_a")).distinct()
    b = (left if right is None else right).where(F.col(key).isNotNull()).select(F.col(key).alias("key_b")).distinct()
    homes = b.select("key_b", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), _band(F.col("key_b"), *bands[i]).alias("code")) for i, r in enumerate(reach) if r >= 0])).alias("c")).select("key_b", "c.*")
    probes = []
    for i, r in enumerate(reach):
        if r < 0:
            continue
        masks = F.array(*[F.lit(sum(1 << x for x in chosen)).cast("long") for k in range(r + 1) for chosen in combinations(range(bands[i][1]), k)])
        code = _band(F.col("key_a"), *bands[i])
        probes.append(a.select("key_a", F.lit(i).alias("band"), F.explode(F.transform(masks, lambda m: code.bitwiseXOR(m))).alias("code")))
    apart = lambda i: F.bit_count(_band(F.col("key_a").bitwiseXOR(F.col("key_b")), *bands[i]))
    first = reduce(lambda rest, i: F.when(apart(i) <= reach[i], F.lit(i)).otherwise(rest), [i for i in reversed(range(len(bands))) if reach[i] >= 0], F.lit(-1))
    probes, on = reduce(DataFrame.unionByName, probes), ["band", "code"]
    hot, _ = write_scratch(homes.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > HOT_CODE).select(*on), "hot-codes")
    few = hot.limit(BROADCAST_ROWS + 1).count() if len(bands) > 1 else 0
    if few:
        # the keys of a hot code are divided by the other bands, over which a pair still differs in at most ``radius`` bits
        side = F.broadcast(hot) if few <= BROADCAST_ROWS else hot
        met = probes.join(side, on, "left_anti").join(homes.join(side, on, "left_anti"), on)
        each, extra = divmod(radius + 1, len(bands) - 1)
        hot_probes, hot_homes = probes.join(side, on, "left_semi"), homes.join(side, on, "left_semi")
        for band in [i for i, r in enumerate(reach) if r >= 0]:
            rest = [i for i in range(len(bands)) if i != band]
            inner = [each + (i < extra) - 1 for i in range(len(rest))]
            for at, (j, r) in enumerate(zip(rest, inner)):
                if r < 0:
                    continue
                masks = F.array(*[F.lit(sum(1 << x for x in chosen)).cast("long") for k in range(r + 1) for chosen in combinations(range(bands[j][1]), k)])
                left = hot_probes.where(F.col("band") == band).select(*on, "key_a", F.explode(F.transform(masks, lambda m: _band(F.col("key_a"), *bands[j]).bitwiseXOR(m))).alias("sub"))
                right = hot_homes.where(F.col("band") == band).select(*on, "key_b", _band(F.col("key_b"), *bands[j]).alias("sub"))
                inside = left.join(right, [*on, "sub"])
                for i, s in list(zip(rest, inner))[:at]:  # reported from the first of the inner bands only
                    if s >= 0:
                        inside = inside.where(apart(i) > s)
                met = met.unionByName(inside.select(*met.columns))
    else:
        met = probes.join(homes, on)
    distance = hamming(F.col("key_a"), F.col("key_b"))
    found = met.where((distance <= radius) & (F.col("band") == first))
    if right_side is None:
        found = found.where(F.col("key_a") < F.col("key_b"))
    return found.select("key_a", "key_b", distance.alias("hamming"))


def near_classes(files: DataFrame, key: str, id_: str, radius: int) -> DataFrame:
    """(file_id, class_id, members, links): one row a file with a key. Its class
    are the files of the same key, named by the smallest id; ``members`` is
    their number and ``links`` the number of other files within ``radius``, those
    of the class included. Classes near one another are in :func:`near_links`."""
    sizes, _ = write_scratch(files.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(id_).alias("class_id"), F.count("*").alias("members")), "classes")
    near = hamming_pairs(sizes, None, "k", radius).select("key_a", "key_b")
    both = near.unionByName(near.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    more = both.join(sizes.select(F.col("k").alias("key_b"), "members"), "key_b").groupBy(F.col("key_a").alias("k")).agg(F.sum("members").alias("_m"))
    known, _ = write_scratch(sizes.join(more, "k", "left").select("k", "class_id", "members", (F.col("members") - 1 + F.coalesce("_m", F.lit(0))).alias("links")), "class-links")
    rows = files.where(F.col(key).isNotNull()).select(F.col(id_).alias("file_id"), F.col(key).alias("k"))
    return hot_join(rows, known, "k", hot=hot_keys(rows, "k")).select("file_id", "class_id", "members", "links")


def near_links(files: DataFrame, key: str, id_: str, radius: int) -> DataFrame:
    """(file_id_a, file_id_b, hamming_distance), a < b, of all keys, however many
    files hold them: each file is linked at distance 0 with its key's smallest
    id, and the smallest ids of two keys within ``radius`` are linked. Any two
    files are as far apart as the smallest ids of their keys, so this holds all
    near pairs in at most one link a file and one a pair of keys."""
    first = files.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(id_).alias("i"))
    same = star_edges(files, key, id_).select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"), F.lit(0).alias("hamming_distance"))
    if radius == 0:
        return same
    near = hamming_pairs(first, None, "k", radius).join(first.select(F.col("k").alias("key_a"), F.col("i").alias("x")), "key_a").join(first.select(F.col("k").alias("key_b"), F.col("i").alias("y")), "key_b")
    return same.unionByName(near.select(F.least("x", "y").alias("file_id_a"), F.greatest("x", "y").alias("file_id_b"), F.col("hamming").alias("hamming_distance")))


def junk_keys(rows: DataFrame, key: str, limit: int = JUNK) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= limit)


def rank_zip(left: DataFrame, right: DataFrame, group: str, name: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): rows of both sides in the same ``group`` matched one
    to one: first those with an equal ``name``, in the order of their ids, then
    the rest in the order of ids. Numbers are counted over ranges, so a hot
    group is spread. Rows without a partner, and null groups, are left out."""
    l0 = left.where(F.col(group).isNotNull()).select(group, F.coalesce(name, F.lit("")).alias("_n"), left_id)
    r0 = right.where(F.col(group).isNotNull()).select(group, F.coalesce(name, F.lit("")).alias("_n"), right_id)
    both = F.struct(group, "_n").alias("_g")
    named = number_rows(l0.select("*", both), "_r", left_id, group="_g").join(number_rows(r0.select(both, right_id), "_r", right_id, group="_g"), ["_g", "_r"])
    same, _ = write_scratch(named.select(left_id, right_id), "same-name")
    l1 = l0.join(same.select(left_id), left_id, "left_anti").select(group, left_id)
    r1 = r0.join(same.select(right_id), right_id, "left_anti").select(group, right_id)
    rest = number_rows(l1, "_r", left_id, group=group).join(number_rows(r1, "_r", right_id, group=group), [group, "_r"]).select(left_id, right_id)
    return same.unionByName(rest)
