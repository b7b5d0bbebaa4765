"""Typed fields from raw metadata, a map of tag names to texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag names in their order of preference and the placeholder date.
DATE_TAGS = ("DateTimeOriginal", "CreationDate", "CreateDate", "MediaCreateDate")
NO_DATE = "0000:00:00 00:00:00"


def _text(tags: Column, *names: str) -> Column:
    """The first tag that is set and not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(tags[n]), F.lit("")) for n in names])


def capture_date(tags: Column) -> Column:
    return F.coalesce(*[F.when(~tags[n].isin("", NO_DATE), tags[n]) for n in DATE_TAGS])


def gps(tags: Column) -> Column:
    """struct(lat, lon, alt): all null unless both coordinates are numbers and
    the altitude, where there is one, is too; altitude 0 is null."""
    lat, lon = tags["GPSLatitude"].try_cast("double"), tags["GPSLongitude"].try_cast("double")
    raw = F.nullif(tags["GPSAltitude"], F.lit(""))
    alt = raw.try_cast("double")
    sound = lat.isNotNull() & lon.isNotNull() & (raw.isNull() | alt.isNotNull())
    return F.struct(F.when(sound, lat).alias("lat"), F.when(sound, lon).alias("lon"), F.when(sound, F.nullif(alt, F.lit(0.0))).alias("alt"))


def dimensions(tags: Column) -> Column:
    """struct(width, height); 0 where the chosen tag is no integer."""
    size = lambda a, b: F.coalesce(F.coalesce(F.when(~tags[a].isin("", "0"), tags[a]), F.when(~tags[b].isin("", "0"), tags[b])).try_cast("int"), F.lit(0))
    return F.struct(size("ImageWidth", "ExifImageWidth").alias("width"), size("ImageHeight", "ExifImageHeight").alias("height"))


def iso(tags: Column) -> Column:
    return tags["ISO"].try_cast("int")


def aperture(tags: Column) -> Column:
    return tags["FNumber"].try_cast("double")


def focal_length(tags: Column) -> Column:
    """The first word as a number ("50 mm" is 50)."""
    return F.split(F.trim(tags["FocalLength"]), r"\s+")[0].try_cast("double")


def rating(tags: Column) -> Column:
    """Whole stars, cut toward zero and held within 0 to 5."""
    stars = tags["Rating"].try_cast("double").try_cast("int")
    return F.when(stars.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(0), stars)))


def keywords(tags: Column) -> Column:
    """JSON array of trimmed words; Subject before Keywords, each either a JSON
    array or one word; null when none is left."""
    raw = F.coalesce(F.nullif(tags["Subject"], F.lit("")), F.nullif(tags["Keywords"], F.lit("")))
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    words = F.filter(F.transform(F.coalesce(listed, F.array(raw)), lambda w: F.trim(w)), lambda w: w != "")
    return F.when(F.size(words) > 0, F.to_json(words))


def description(tags: Column) -> Column:
    return _text(tags, "Description", "ImageDescription")


def label(tags: Column) -> Column:
    return _text(tags, "Label")


def codec(tags: Column) -> Column:
    return _text(tags, "CompressorID")


def duration(tags: Column) -> Column:
    return tags["Duration"].try_cast("double")


def frame_rate(tags: Column) -> Column:
    return tags["VideoFrameRate"].try_cast("double")


def duration_text(seconds: Column) -> Column:
    """Seconds as "1h 02m 03s", "2m 03s" or "3s"."""
    s = F.when(seconds.isNotNull(), F.greatest(F.lit(0), F.round(seconds).cast("long")))
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), (s % 60).cast("long")
    return F.when(s >= 3600, F.format_string("%dh %02dm %02ds", h, m, r)).when(s >= 60, F.format_string("%dm %02ds", m, r)).when(s.isNotNull(), F.format_string("%ds", r))
