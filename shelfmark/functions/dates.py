"""Date forensics: wall-clock dates from metadata, file names and modification
times, and the rated choice between them. Calendar values are TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import stem

# Thresholds and dates that clocks and file systems invent.
FIRST_YEAR = 1990
INVENTED = ("1980-01-01", "2000-01-01")
AGREE_DAYS, CONTRADICT_DAYS = 1, 2

# Dates in file names, in the order they are tried; the groups are
# year, month, day and, if there are six, hour, minute and second.
FILENAME_PATTERNS = (
    r"(?i)^PXL_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})\d*",
    r"(?i)^(?:IMG|VID|MVIMG|MVI)[_-](\d{4})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})",
    r"(?i)^Screenshot[_-](\d{4})-?(\d{2})-?(\d{2})[-_](\d{2})-?(\d{2})-?(\d{2})",
    r"(?i)^(?:IMG|VID)-(\d{4})(\d{2})(\d{2})-WA\d+",
    r"(?i)^Signal[-_](\d{4})-(\d{2})-(\d{2})[-_T](\d{2})(\d{2})(\d{2})",
    r"(?i)^Signal[-_](\d{4})-(\d{2})-(\d{2})(?![-_T]\d{6})",
    r"(?i)^(?:IMG|VID|MVIMG|MVI)[_-](\d{4})(\d{2})(\d{2})(?!\d)",
    r"(?i)^Screenshot[_-](\d{4})-?(\d{2})-?(\d{2})(?!\d)",
    r"(?i)^(\d{4})(\d{2})(\d{2})[_-]\d{3,}",
)
#: Patterns above with a time of day.
TIMED = (0, 1, 2, 4)


def _ntz(text: Column, pattern: str, timed: bool) -> Column:
    """A wall-clock timestamp from the groups of ``pattern``, null unless they are
    a real one. One rewrite and one cast keep the generated code small."""
    shape = "$1-$2-$3 $4:$5:$6" if timed else "$1-$2-$3 00:00:00"
    return F.when(text.rlike(pattern), F.regexp_replace(text, rf"(?s){pattern}.*$", shape).try_cast("timestamp_ntz"))


def metadata_datetime(text: Column) -> Column:
    """Wall-clock time of "Y:m:d H:M:S", "Y-m-dTH:M:S" or "Y-m-d H:M:S"; a zone
    or offset at the end is dropped, anything else gives null."""
    raw = F.trim(F.regexp_replace(F.trim(text), r"(?:Z|[+-]\d{2}:?\d{2})$", ""))
    time = r"(\d{1,2}):(\d{1,2}):(\d{1,2})$"
    return F.coalesce(_ntz(raw, rf"^(\d{{4}}):(\d{{1,2}}):(\d{{1,2}}) {time}", True), _ntz(raw, rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]{time}", True))


def modified_datetime(text: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` of an ISO text; one without an offset is taken as it stands."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    aware = text.rlike(r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    instant = F.try_to_timestamp(text)
    # counted from the epoch, so that the session's zone plays no part
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    here = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    return F.when(iso, F.when(aware, here).otherwise(text.try_cast("timestamp_ntz")))


def filename_datetime(name: Column) -> Column:
    """The time a capturing program wrote into a file name; midnight if it wrote only a date."""
    s = stem(name)
    return F.coalesce(*[_ntz(s, p, i in TIMED) for i, p in enumerate(FILENAME_PATTERNS)])


def is_sane(dt: Column, today: Column) -> Column:
    day = dt.cast("date")
    return F.coalesce((F.year(day) >= FIRST_YEAR) & (day <= today) & ~day.isin(*[F.to_date(F.lit(d)) for d in INVENTED]), F.lit(False))


def resolve_date(exif: Column, name: Column, digitized: Column, modified: Column, camera: Column, file_type: Column, today: Column) -> Column:
    """struct(dt, source, confidence) from the four parsed signals.

    A sane metadata date of a known camera, or one that agrees with the file
    name within a day, is HIGH. A file name that contradicts it by more than two
    days wins with LOW. A file name alone is MEDIUM for videos and LOW for
    others. A lone metadata or digitised date is MEDIUM, the modification time
    LOW, and nothing at all gives source "none" without a confidence.
    """
    exif_ok, name_ok = is_sane(exif, today), is_sane(name, today)
    gap = F.abs(F.datediff(exif.cast("date"), name.cast("date")))
    both = exif_ok & name_ok
    pick = lambda dt, source, conf: F.struct(dt.alias("dt"), F.lit(source).alias("source"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("confidence"))
    return (
        F.when(exif_ok & (F.coalesce(camera, F.lit("")) != ""), pick(exif, "exif_original", "HIGH"))
        .when(both & (gap <= AGREE_DAYS), pick(exif, "exif_original", "HIGH"))
        .when(both & (gap > CONTRADICT_DAYS), pick(name, "filename", "LOW"))
        .when(~exif_ok & name_ok, pick(name, "filename", F.when(file_type == "VIDEO", "MEDIUM").otherwise("LOW")))
        .when(exif_ok, pick(exif, "exif_original", "MEDIUM"))
        .when(is_sane(digitized, today), pick(digitized, "exif_digitized", "MEDIUM"))
        .when(modified.isNotNull(), pick(modified, "mtime", "LOW"))
        .otherwise(pick(F.lit(None).cast("timestamp_ntz"), "none", F.lit(None).cast("string")))
    )


def candidates_text(exif: Column, name: Column, digitized: Column, modified: Column) -> Column:
    """The dates that compete, as one line."""
    shown = [F.concat(F.lit(f"{n}="), F.date_format(c.cast("date"), "yyyy-MM-dd")) for n, c in (("EXIF", exif), ("filename", name), ("digitized", digitized), ("mtime", modified))]
    text = F.concat_ws(" ", *shown)
    return F.when(text == "", "no candidates").otherwise(text)


def override_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "y-M-d")).cast("timestamp_ntz")


def folder_date_range(name: Column) -> Column:
    """struct(lo, hi) from an event folder's name: a date, then "(Nd)" or "_Nd"."""
    pattern = r"^(\d{4}-\d{2}-\d{2})(?:\((\d+)d\)|_(\d+)d)?"
    lo = F.try_to_date(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")))
    span = F.coalesce(F.regexp_extract(name, pattern, 2).try_cast("int"), F.regexp_extract(name, pattern, 3).try_cast("int"), F.lit(1))
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), F.date_add(lo, F.greatest(span, F.lit(1)) - 1).alias("hi")))
