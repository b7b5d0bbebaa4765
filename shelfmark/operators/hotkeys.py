"""Per-key results where a few keys hold most rows.

Counts, sums and extremes are merged in two stages, so a hot key costs one
partial row per task. Quantiles are exact and never gather a key's values:
histograms of value prefixes are merged, the bin that holds the wanted rank is
opened, and the next histogram looks only inside it, until one value is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.runtime import BROADCAST_ROWS, HOT_KEYS, HOT_ROWS, drop_scratch, write_scratch

#: Bits opened in each refinement; 2**BITS bins a key at most are merged at once.
BITS = 8
#: Bits of the first histogram over key hashes, by which rare keys are left out.
HASH_BITS = 16


def long_form(df: DataFrame, keys: dict[str, Column], value: Column, stamp: Column) -> DataFrame:
    """(field_name, key_value, value, stamp) for each non-null key of each row.

    The key columns are unpivoted in one pass over the input.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("f"), col.alias("k")) for name, col in keys.items()])
    rows = df.select(F.explode(F.filter(pairs, lambda p: p["k"].isNotNull())).alias("p"), value.cast("long").alias("value"), stamp.alias("stamp"))
    return rows.select(F.col("p.f").alias("field_name"), F.col("p.k").alias("key_value"), "value", "stamp")


def key_totals(rows: DataFrame) -> DataFrame:
    """Row count, non-null count, total, extremes and first and last stamp of
    each key; all are mergeable, so map-side partials carry the hot keys."""
    return rows.groupBy("field_name", "key_value").agg(
        F.count("*").alias("row_count"),
        F.count("value").alias("value_count"),
        F.sum("value").alias("total_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min("stamp").alias("first_stamp"),
        F.max("stamp").alias("last_stamp"),
    )


def exact_quantiles(rows: DataFrame, totals: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Exact lower quantiles of ``value`` for each key of ``totals``.

    The quantile q of n values is the value of rank ceil(q * n), at least 1
    (rank 1 is the smallest). Null values do not count; a key without values
    gets nulls. The values of one key must lie within 2**63 of each other.

    ``totals`` may hold any number of keys. Values of hot keys never move: their
    state, fewer than HOT_KEYS rows for each quantile (or all of it, up to
    BROADCAST_ROWS keys), is broadcast to where the counted values lie. All
    other keys are joined by shuffle; each holds one in HOT_KEYS of the rows, or
    HOT_ROWS of them, at most.
    """
    spark = rows.sparkSession
    on = ["field_name", "key_value"]
    q = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(x)).alias("q")) for n, x in quantiles.items()]))
    small = totals.select(*on).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sums = totals.agg(F.sum("value_count").alias("n"), F.max(F.col("max_value") - F.col("min_value")).alias("span")).first()
    wide = F.lit(True) if small else F.col("value_count") > max(HOT_ROWS, (sums.n or 0) // HOT_KEYS)
    open_ = totals.where("max_value > min_value").withColumn("wide", wide)
    rank = F.greatest(F.lit(1), F.ceil(F.col("_q.q") * F.col("value_count"))).cast("long")
    state = open_.select(*on, "wide", "min_value", "value_count", q.alias("_q")).select(*on, "wide", F.col("_q.name").alias("name"), rank.alias("rank"), F.col("min_value").alias("base"), F.lit(0).cast("long").alias("prefix"))
    # equal values of a key are one counted row before anything is moved
    counted = rows.where(F.col("value").isNotNull()).groupBy(*on, "value").agg(F.count("*").alias("n"))
    keys = open_.select(*on, "wide")
    marked = counted.join(F.broadcast(keys.where("wide")), on, "inner" if small else "left")
    if small:
        few, few_at = write_scratch(marked.drop("wide"), "value-counts")
        rest = rest_at = None
    else:
        both, few_at = write_scratch(marked.withColumn("wide", F.coalesce("wide", F.lit(False))), "value-counts", ["wide"])
        few, rest_at = both.where("wide").drop("wide"), None
        rest, rest_at = write_scratch(both.where("not wide").drop("wide").join(keys.where("not wide").select(*on), on, "left_semi"), "value-counts")
    levels = -(-int(sums.span or 0).bit_length() // BITS)
    old = None
    for level in range(levels):
        shift = BITS * (levels - 1 - level)
        inside = few.join(F.broadcast(state.where("wide")), on)
        if rest is not None:
            inside = inside.unionByName(rest.join(state.where("not wide"), on))
        if level:
            inside = inside.where(F.shiftright(F.col("value") - F.col("base"), shift + BITS) == F.col("prefix"))
        bins = inside.groupBy(*on, "name", F.shiftright(F.col("value") - F.col("base"), shift).alias("bin")).agg(F.sum("n").alias("n"), F.first("rank").alias("rank"), F.first("base").alias("base"), F.first("wide").alias("wide"))
        run = Window.partitionBy(*on, "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # 2**BITS rows a key at most
        hit = bins.withColumn("upto", F.sum("n").over(run)).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        state, path = write_scratch(hit.select(*on, "wide", "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "base", F.col("bin").alias("prefix")), "quantile-state")
        drop_scratch(spark, old)
        old = path
    drop_scratch(spark, few_at, rest_at)
    found = state.select(*on, "name", (F.col("base") + F.col("prefix")).alias("x"))
    one = totals.where("max_value = min_value").select(*on, q.alias("_q"), "min_value").select(*on, F.col("_q.name").alias("name"), F.col("min_value").alias("x"))
    return found.unionByName(one).groupBy(*on).pivot("name", sorted(quantiles)).agg(F.first("x"))


def frequent_keys(rows: DataFrame, least: float) -> DataFrame:
    """The part of ``rows`` whose keys may be held by ``least`` rows or more, with
    all rows of each such key.

    Keys are counted by a hash prefix first: 2**HASH_BITS mergeable counters a
    field, whatever the number of keys. Only keys in a bin that reaches
    ``least`` can, so all others are left out before any key is moved.
    """
    bin_ = F.shiftrightunsigned(F.xxhash64("key_value"), 64 - HASH_BITS).alias("bin")
    heavy = rows.groupBy("field_name", bin_).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("field_name", "bin")
    heavy, _ = write_scratch(heavy, "heavy-bins")
    return rows.withColumn("bin", bin_).join(F.broadcast(heavy), ["field_name", "bin"], "left_semi").drop("bin")


def key_profiles(df: DataFrame, keys: dict[str, Column], value: Column, stamp: Column, min_share: float = 0.0, quantiles: dict[str, float] | None = None) -> DataFrame:
    """One row for each key that holds at least ``min_share`` of all rows.

    Columns: field_name, key_value, row_count, value_count, total_value,
    min_value, max_value, first_stamp, last_stamp and one column for each
    quantile. Null keys give no row, null values count only in row_count and an
    empty input gives an empty result. The share is of all rows of ``df``, those
    with null keys included.
    """
    quantiles = quantiles or {"p50_value": 0.5, "p90_value": 0.9}
    rows = long_form(df, keys, value, stamp)
    if min_share > 0:
        least = F.lit(min_share) * F.lit(df.count())
        if len(keys) / min_share <= BROADCAST_ROWS:  # that many bins can be heavy
            rows = frequent_keys(rows, least)
        totals = key_totals(rows).where(F.col("row_count") >= least)
    else:
        totals = key_totals(rows)
    totals, _ = write_scratch(totals, "key-totals")
    return totals.join(exact_quantiles(rows, totals, quantiles), ["field_name", "key_value"], "left")
