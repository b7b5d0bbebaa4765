"""Rule-based classification of files by extension, folders, software and size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import base_name, parts, stem

# The extensions, folder names, suffixes and programs that decide a class.
RAW = ("arw", "srf", "sr2", "cr3", "cr2", "crw", "nef", "nrw", "raf", "rw2", "rwl", "orf", "pef", "dng", "srw", "x3f", "iiq", "3fr", "fff")
JPEG = ("jpg", "jpeg")
VIDEO = ("mp4", "mov", "m4v", "avi", "mkv", "wmv", "flv", "webm", "mts", "m2ts", "3gp", "3g2", "mpg", "mpeg")
HEIC = ("heic", "heif")
OTHER_SUPPORTED = ("tif", "tiff", "heic", "heif", "png", "webp")
RESIZED_FOLDERS = ("resize", "resized", "thumb", "thumbs", "thumbnail", "thumbnails")
SHARE_FOLDERS = ("export", "exports", "share", "shared", "sharing", "web", "websize", "web_size", "small", "preview", "previews", "instagram", "ig", "blog", "send", "sent", "proof", "proofs")
RESIZED_STEM = r"(?:_sm|_small|_web|_w|_thumb|_tn|_\d{3,4}px|-resized|_export|_share|_ig|_blog)$"
DEVELOPERS = ("lightroom", "camera raw", "capture one", "captureone", "darktable", "aperture", "photoshop", "dxo", "photolab", "luminar", "on1", "rawtherapee", "affinity", "silkypix", "capture nx", "nx studio", "raw power", "exposure x", "acdsee", "gimp", "pixelmator")
EXPORTERS = ("lightroom", "aperture", "capture one", "darktable", "photos", "google photos", "flickr", "squarespace", "wordpress", "whatsapp", "line", "telegram")
RESIZED_WIDTH = 2500
PHOTO_TYPES = ("RAW", "CAMERA_JPEG", "DEV_JPEG", "HEIC")
DATED_TYPES = (*PHOTO_TYPES, "VIDEO")
COPY_TYPES = ("CAMERA_JPEG", "DEV_JPEG", "HEIC")
ALL_TYPES = (*PHOTO_TYPES, "RESIZED_JPEG", "VIDEO", "UNKNOWN")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]*)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*RAW, *JPEG, *VIDEO, *OTHER_SUPPORTED)


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def classify(path: Column, software: Column, width: Column | None = None, secondary: bool = False, width_limit: int = RESIZED_WIDTH) -> Column:
    """RAW, VIDEO, HEIC, UNKNOWN, RESIZED_JPEG, DEV_JPEG or CAMERA_JPEG.

    With ``secondary`` weak signals are scored (folder 2, suffix 2, width 1,
    software 1): two or more give RESIZED_JPEG, one gives UNKNOWN. Null software
    and width say nothing; a null path gives UNKNOWN.
    """
    ext = extension(path)
    names = F.transform(parts(path), lambda x: F.lower(x))
    folders = F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))
    program = F.coalesce(F.lower(software), F.lit(""))
    plain = F.when(_any_of(program, DEVELOPERS), "DEV_JPEG").otherwise("CAMERA_JPEG")
    if secondary:
        score = (
            F.when(F.arrays_overlap(names, F.array(*map(F.lit, SHARE_FOLDERS))), 2).otherwise(0)
            + F.when(F.lower(stem(base_name(path))).rlike(RESIZED_STEM), 2).otherwise(0)
            + F.when(F.coalesce((width > 0) & (width < width_limit), F.lit(False)), 1).otherwise(0)
            + F.when(_any_of(program, EXPORTERS), 1).otherwise(0)
        )
        plain = F.when(score >= 2, "RESIZED_JPEG").when(score == 1, "UNKNOWN").otherwise(plain)
    return (
        F.when(path.isNull(), "UNKNOWN")
        .when(ext.isin(*RAW), "RAW")
        .when(ext.isin(*VIDEO), "VIDEO")
        .when(ext.isin(*HEIC), "HEIC")
        .when(~ext.isin(*JPEG), "UNKNOWN")
        .when(F.arrays_overlap(folders, F.array(*map(F.lit, RESIZED_FOLDERS))), "RESIZED_JPEG")
        .otherwise(plain)
    )
