"""Path columns. Windows and POSIX paths are both accepted: either separator
splits, and a folder keeps the separator its path uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[\\/]"


def separator(path: Column) -> Column:
    return F.when(path.contains("\\"), F.lit("\\")).otherwise(F.lit("/"))


def parts(path: Column) -> Column:
    """Components; the first is the drive, or empty for an absolute POSIX path."""
    return F.split(F.regexp_replace(path, r"[\\/]+$", ""), SPLIT)


def parent(path: Column) -> Column:
    """The folder of a path, null if it has none."""
    return F.nullif(F.regexp_extract(path, r"(?s)^(.*)[\\/][^\\/]*$", 1), F.lit(""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def norm_stem(name: Column) -> Column:
    return F.lower(F.trim(stem(name)))


def ancestors(path: Column) -> Column:
    """All folders above a path below its drive or root, shortest first."""
    p = parts(path)
    sep = separator(path)
    return F.when(F.size(p) > 2, F.transform(F.sequence(F.lit(2), F.size(p) - 1), lambda i: F.call_function("array_join", F.slice(p, 1, i), sep))).otherwise(F.array().cast("array<string>"))


def within(path: Column, folder: Column) -> Column:
    """Whether ``path`` lies below ``folder``: exact prefix plus a separator, no wildcards."""
    clean = F.regexp_replace(folder, r"[\\/]+$", "")
    return path.startswith(F.concat(clean, F.lit("\\"))) | path.startswith(F.concat(clean, F.lit("/")))


def rebase(path: Column, old: Column, new: Column) -> Column:
    """``path`` with its prefix ``old`` replaced by ``new``; unchanged if it is not below ``old``."""
    return F.when((path == old) | within(path, old), F.concat(new, F.substr(path, F.length(old) + 1))).otherwise(path)


def root_key(path: Column) -> Column:
    """Separator- and case-neutral form for comparing folders."""
    return F.lower(F.regexp_replace(F.translate(path, "/", "\\"), r"\\+$", ""))
