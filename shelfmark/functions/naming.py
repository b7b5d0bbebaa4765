"""Event labels from folder names: which names carry meaning, and their clean form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import parts, stem

LABEL_LENGTH = 40

# The names and patterns below decide what counts as a label.
_DATE_TOKEN = r"(?:\d{8}(?:_\d{6})?|\d{4}_\d{4}|\d{4}(?:_\d{2}){1,2}|\d{4})(?:_?\d{1,2}d)?(?=_|$|[^\x00-\x7f])"
_DRIVE = r"^[A-Za-z]:[\\/]?$"
_RANGES = (r"^(\d{4})(\d{2})(\d{2})([~&_-])(\d{1,2})(?=\D|$)", r"^(\d{4})-(\d{2})-(\d{2})([~&_])(\d{1,2})(?=\D|$)")
_UNORGANISED = (
    _DRIVE,
    r"^\d{4}([-_.]?\d{1,2}){0,2}$",
    r"^\d{8}([-_]?\d{6})?$",
    r"^\d+$",
    r"(?i)^\d{3}[-_]?[a-z0-9]{2,6}(?:[._](?:done|old|bak|copy))?$",
    r"(?i)^dcim$",
    r"(?i)^(img|dsc|dscf|p|pic|photo|mvi|gopr)[-_]?\d{3,}$",
)
CONTAINERS = (
    "raw_files", "rawtank", "raw_old", "albums", "album", "photos", "照片", "jpg", "jpeg", "jpegtank", "depository_aged", "完整備份相簿",
    "slides", "pic", "pics", "samples", "icqreceived_old", "thmbnl", "thmbnls", "video", "videos", "待整理", "m4root",
    "develop", "develops", "developed", "export", "exports", "share", "station", "office11",
    "old", "new", "misc", "backup", "bak", "copy", "untitled", "新增資料夾", "未命名", "暫存",
)
_DEVICE_WORDS = ("手機", "ipad", "iphone")
_CONTAINER_PATTERNS = r"^dcim|^temp(\d+|_\d+)?$|已燒錄|^\d{6}$|^v\d+_|(?:_|^)[tf]x\d"
_CAMERA_NAME = r"(?i)^(?:img|_mg|dsc|dscf|dscn|pict?|photo|mvi|gopr|pano|cimg|hpim|sdc|dji)[-_]?\d{3,}$"
DERIVATIVE_TOKENS = ("resize", "resized", "crop", "cropped", "share", "shared", "export", "exports", "web", "websize", "small", "thumb", "thumbs", "thumbnail", "thumbnails", "preview", "previews", "proof", "proofs")
NONCANONICAL = ("all in lightroom", "depository", "rawtank", "jpegtank", "raw.old", "raw_old", ".out", "完整備份", "待整理", "archive", "backup", "- copy", "_copy", " copy", "copy of", "temp", "tmp", ".old", ".bak")


def _underscored(name: Column) -> Column:
    """Runs of anything but letters and digits of any script as one "_", none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def strip_range(name: Column, last_day: Column | None = None) -> Column:
    """Without a leading date range. "~" and "&" always mark one; "_" and "-"
    only if the day after them, in the same or the next month, is ``last_day``."""
    out = F.lit(None).cast("string")
    for pattern in reversed(_RANGES):
        g = lambda i, p=pattern: F.regexp_extract(name, p, i)
        year, month, first, tail = (g(i).try_cast("int") for i in (1, 2, 3, 5))
        following = F.when(tail < first, 1).otherwise(0)
        sure = g(4).isin("~", "&")
        if last_day is not None:
            whole = year * 12 + month - 1 + following
            end = F.to_date(F.try_make_timestamp_ntz(F.floor(whole / 12).cast("int"), (whole % 12 + 1).cast("int"), tail, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")))
            sure = sure | F.coalesce((month <= 12) & (end == last_day), F.lit(False))
        out = F.when(name.rlike(pattern) & sure, F.regexp_replace(name, pattern, "")).otherwise(out)
    return F.coalesce(out, name)


def sanitize_event(name: Column, last_day: Column | None = None) -> Column:
    """The label of a folder name: no leading dates and day counts, separators as
    one "_", at most 40 characters; "" for null, empty and drive names."""
    clean = _underscored(strip_range(name, last_day))
    bare = F.regexp_replace(clean, rf"^(?:_*{_DATE_TOKEN})+_*", "")
    return F.when(name.isNull() | name.rlike(_DRIVE), "").otherwise(F.substring(F.regexp_replace(bare, "^_+|_+$", ""), 1, LABEL_LENGTH))


def is_unorganised(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n == "") | reduce(lambda a, b: a | b, [n.rlike(p) for p in _UNORGANISED])


def is_container(name: Column) -> Column:
    n = F.lower(_underscored(F.coalesce(name, F.lit(""))))
    return (n == "") | n.isin(*CONTAINERS) | reduce(lambda a, b: a | b, [n.contains(w) for w in _DEVICE_WORDS]) | n.rlike(_CONTAINER_PATTERNS)


def is_label(name: Column) -> Column:
    return ~is_unorganised(name) & ~is_container(name) & (sanitize_event(name) != "")


def has_event_parent(name: Column) -> Column:
    return ~is_unorganised(name) & (sanitize_event(name) != "")


def is_camera_name(filename: Column) -> Column:
    return F.coalesce(F.trim(stem(filename)).rlike(_CAMERA_NAME), F.lit(False))


def noncanonical_score(folder: Column) -> Column:
    low = F.lower(folder)
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in NONCANONICAL])


def sanitize_camera(model: Column) -> Column:
    """A camera model as a file name: at most 20 characters, others than letters, digits and _ as _."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(model, r"(?U)[^\w]", "_"), "^_+|_+$", ""), 1, 20)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("Unknown"))


def derivative_root(path: Column) -> Column:
    """The lower-case folder above the first export folder of a path, or null;
    "" if the export folder comes first."""
    names = F.transform(parts(path), lambda x: F.lower(x))
    folders = F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))
    tokens = F.array(*map(F.lit, DERIVATIVE_TOKENS))
    hits = F.transform(folders, lambda x: F.arrays_overlap(F.split(x, "[^a-z0-9]+"), tokens))
    at = F.array_position(hits, F.lit(True)).cast("int")
    sep = F.when(path.contains("\\"), F.lit("\\")).otherwise(F.lit("/"))
    return F.when(at > 0, F.call_function("array_join", F.slice(names, 1, at - 1), sep))


def event_label(target: Column) -> Column:
    """The label of the first path part shaped like "YYYY-MM-DD[(Nd)] label"."""
    shaped = F.filter(F.split(target, r"[\\/]+"), lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}(\(\d{1,2}d\))?\s+."))
    return F.nullif(F.regexp_extract(F.get(shaped, F.lit(0)), r"^\d{4}-\d{2}-\d{2}(?:\(\d{1,2}d\))?\s+(.+)$", 1), F.lit(""))


def has_residue(label: Column) -> Column:
    return label.rlike(r"\d{8}") | label.rlike(r"^\d{1,2}d(?:_|$)")


def base_and_event(target: Column) -> tuple[Column, Column]:
    """(base, event folder): the first part named Masters or Others, in lower
    case, that has two parts after it, and the second of these."""
    p = F.split(target, r"[\\/]+")
    at = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.lower(F.get(p, i)).isin("masters", "others") & (i + 2 < F.size(p)))
    first = F.get(at, F.lit(0))
    return F.lower(F.get(p, first)), F.get(p, first + 2)


