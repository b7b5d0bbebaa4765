"""Timestamps of mixed formats, precisions and zones as one UTC instant.

An ordered cascade of anchored patterns rewrites each text into one canonical
field list; the fields are then checked strictly. Everything is a built-in
column expression, so it runs inside the JVM.
"""

from __future__ import annotations

from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import hot_join, hot_keys, spread

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: Zone abbreviations and their offsets in minutes.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "ut": 0, "gmt": 0, "wet": 0,
    "west": 60, "bst": 60, "ist": 60, "cet": 60, "met": 60, "mez": 60,
    "cest": 120, "mest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "hdt": -540,
}

_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +)?"
_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_SEC = r"(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(?: ?(z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5}))?"

#: (name, anchored pattern over the lower-case text, canonical rewrite
#: "year|month|day|hour|minute|second|fraction|am-pm|zone"); the first that fits wins.
CASCADE = (
    ("exif_or_iso", rf"^(\d{{4}})([:/-])(\d{{1,2}})\2(\d{{1,2}})(?:t| +)(\d{{1,2}}):(\d{{2}}){_SEC}{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8||$9"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:t| )(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("dotted_day_first", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +(\d{{1,2}}):(\d{{2}}){_SEC}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("slashed_12h", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +(\d{{1,2}}):(\d{{2}}){_SEC} ?([ap])\.?m\.?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("slashed_24h", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +(\d{{1,2}}):(\d{{2}}){_SEC}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7||$8"),
    ("mail", rf"^{_DAY}(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}),? +(\d{{1,2}}):(\d{{2}}){_SEC}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("ctime", rf"^{_DAY}{_MON} +(\d{{1,2}}) +(\d{{1,2}}):(\d{{2}}){_SEC}{_ZONE} +(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
)

#: A bare number below these magnitudes counts seconds, milliseconds, microseconds.
EPOCH_LIMITS = ((10**11, 10**6), (10**14, 10**3), (10**17, 1))


def _clean(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"^[\s\u0000 ﻿]+|[\s\u0000 ﻿]+$", ""))


def _epoch(text: Column) -> Column:
    whole = F.regexp_extract(text, r"^-?(\d{1,17})(?:\.\d+)?$", 1).cast("long")
    part = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)$", 1), 1, 6), 6, "0").cast("long")
    size = reduce(lambda rest, step: F.when(whole < step[0], F.lit(step[1])).otherwise(rest), reversed(EPOCH_LIMITS), F.lit(None).cast("int"))
    # finer digits are cut off after scaling the fraction to the unit of the number
    micros = whole * size + F.floor(part * size / F.lit(1_000_000)).cast("long")
    return F.when(text.startswith("-"), -micros).otherwise(micros)


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC, null if the zone text has no meaning."""
    named = F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])
    hours = F.substring(zone, 2, 2).try_cast("int")
    minutes = F.when(F.length(zone) > 3, F.substring(zone, -2, 2).try_cast("int")).otherwise(0)
    signed = F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(zone.startswith("-"), -1).otherwise(1))
    return F.when(zone.rlike("^[+-]"), signed).otherwise(named[zone])


def utc_micros(col: Column, zone: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp text, else null.

    ``zone`` is the IANA zone that holds where the text names none. A local
    time that a clock change repeats is the earlier instant, one that a change
    skips is read with the offset before it. Finer digits than microseconds are
    cut off. Dates without a time of day, placeholders, impossible dates, null
    and empty texts give null, and so does a text without zone information when
    ``zone`` is null.
    """
    text = _clean(col)
    canon = reduce(lambda rest, p: F.when(text.rlike(p[1]), F.regexp_replace(text, p[1], p[2])).otherwise(rest), reversed(CASCADE), F.lit(None).cast("string"))
    return _from_fields(text, F.split(canon, r"\|", 9), zone)


def _from_fields(text: Column, parts: Column, zone: Column) -> Column:
    number = lambda i: parts[i].try_cast("int")
    month = F.coalesce(number(1), F.when(F.length(parts[1]) == 3, F.array_position(F.array(*[F.lit(m) for m in MONTHS]), parts[1]).cast("int")))
    raw_hour, minute, second = number(3), number(4), F.coalesce(number(5), F.lit(0))
    half = F.when((raw_hour >= 1) & (raw_hour <= 12), raw_hour % 12 + F.when(parts[7] == "p", 12).otherwise(0))
    hour = F.when(parts[7] != "", half).otherwise(raw_hour)
    fraction = F.coalesce(F.rpad(F.substring(parts[6], 1, 6), 6, "0").try_cast("int"), F.lit(0))
    sound = (number(0) >= 1) & (hour <= 23) & (minute <= 59) & (second <= 59)
    at = lambda tz: F.unix_micros(F.try_make_timestamp(number(0), month, number(2), hour, minute, second.cast("decimal(16,6)"), tz))
    stated = at(F.lit("UTC")) - _offset_minutes(parts[8]).cast("long") * 60_000_000
    local = F.when(parts[8] != "", stated).when(zone.isNotNull(), at(zone))
    return F.when(parts.isNotNull(), F.when(sound, local + fraction)).when(text.rlike(r"^-?\d{1,17}(\.\d+)?$"), _epoch(text))


def root_zone(path: Column, roots: list[tuple[str, str]]) -> Column:
    """The zone of the longest prefix in ``roots`` that begins ``path``."""
    ordered = sorted(roots, key=lambda r: (-len(r[0]), r))
    return F.coalesce(*[F.when(path.startswith(p), F.lit(z)) for p, z in ordered], F.lit(None).cast("string"))


def with_root_zone(files: DataFrame, roots: DataFrame, path: str = "path", prefix: str = "path_prefix", zone: str = "time_zone", out: str = "_zone", check: bool = False) -> DataFrame:
    """Add the zone of the longest fitting root. Up to 1,000 roots become one
    expression; more are matched by an equi-join on the prefix texts. Null
    prefixes and zones are ignored, and with ``check`` names that are no IANA
    zone; a path without a root gets null."""
    named = roots.where(F.col(prefix).isNotNull() & F.col(zone).isNotNull())
    if check:
        named = named.where(F.col(zone).isin(sorted(available_timezones())))
    rows = named.groupBy(F.col(prefix).alias("p")).agg(F.min(zone).alias("z"))
    few = [(r.p, r.z) for r in rows.limit(1001).collect()]
    if len(few) <= 1000:
        return files.withColumn(out, root_zone(F.col(path), few))
    sizes = [r.n for r in rows.select(F.length("p").alias("n")).distinct().collect()]  # lengths of paths
    keyed = files.withColumn("_p", F.explode_outer(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sizes])))
    side = rows.withColumnRenamed("p", "_p")
    keyed = keyed.where("_p is not null").select(path, "_p")
    best = hot_join(keyed, side, "_p", hot=hot_keys(keyed.join(side, "_p", "left_semi"), "_p")).groupBy(path).agg(F.max_by("z", F.length("_p")).alias(out))
    return files.join(best, path, "left")


def normalise_timestamps(files: DataFrame, roots: DataFrame, columns: list[str], key: str = "file_id", path: str = "path") -> DataFrame:
    """(key, field_name, utc_us): one row for each readable value of ``columns``.

    Other columns are ignored, whatever their names. Repeated rows stay
    repeated; rows without any readable value give nothing.
    """
    zoned = with_root_zone(spread(files.select(F.col(key).alias("_key"), F.col(path).alias("_path"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])), roots, "_path", check=True)
    values = F.array(*[F.struct(F.lit(c).alias("n"), F.col(f"_v{i}").alias("v")) for i, c in enumerate(columns)])
    long = zoned.select("_key", "_zone", F.explode(values).alias("_f")).where(F.col("_f.v").isNotNull())
    text = _clean(F.col("_f.v"))
    canon = reduce(lambda rest, p: F.when(F.col("_t").rlike(p[1]), F.regexp_replace("_t", p[1], p[2])).otherwise(rest), reversed(CASCADE), F.lit(None).cast("string"))
    parts = long.select("_key", F.col("_f.n").alias("_n"), "_zone", text.alias("_t")).withColumn("_c", F.split(canon, r"\|", 9))
    # the split column is referred to many times: a generator between keeps it from being recomputed for each use
    parts = parts.select("_key", "_n", "_zone", "_t", F.inline(F.array(F.struct(F.col("_c").alias("_p")))))
    return parts.select(F.col("_key").alias(key), F.col("_n").alias("field_name"), _from_fields(F.col("_t"), F.col("_p"), F.col("_zone")).alias("utc_us")).where(F.col("utc_us").isNotNull())
