"""Writers: merges by key as frames, and reports. Tables are rewritten or
appended whole; each merge is a pure function of the old table and the change."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import parent

#: Columns of files that an update may set.
UPDATABLE = ("file_type", "sha256", "phash", "status", "error_msg", "date_source", "date_confidence", "rating", "keywords", "width", "height", "path", "filename", "updated_at")


def insert_new(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``; of equal keys in ``new``
    the least row. A null in a key never equals another."""
    whole = new.where(F.expr(" and ".join(f"{k} is not null" for k in keys)))
    one = whole.groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys] or [F.lit(0).alias("_")])).alias("_x"))
    one = one.select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in new.columns])
    loose = new.where(F.expr(" or ".join(f"{k} is null" for k in keys)))
    return one.join(existing.select(*keys), list(keys), "left_anti").select(*new.columns).unionByName(loose)


def upsert(existing: DataFrame, change: DataFrame, *keys: str) -> DataFrame:
    """``change`` replaces rows of equal keys."""
    return existing.join(change.select(*keys), list(keys), "left_anti").select(*existing.columns).unionByName(change.select(*existing.columns))


def patch(existing: DataFrame, change: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    """Set the columns of ``change`` where it has a row for the key, to null if
    that is what it says. Columns outside UPDATABLE are refused; of several
    rows of one key the greatest holds."""
    cols = [c for c in change.columns if c != key]
    if bad := [c for c in cols if c not in UPDATABLE]:
        raise ValueError(f"columns that may not be set: {', '.join(bad)}")
    given = change.groupBy(key).agg(F.max(F.struct(*cols)).alias("_new"))
    j = existing.join(given, key, "left")
    hit = F.col("_new").isNotNull()
    value = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in cols}
    if now is not None and "updated_at" in existing.columns:
        value["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return j.select(*[value[c].alias(c) if c in value else F.col(c) for c in existing.columns])


def record_errors(files: DataFrame, failed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Files that could not be read, ``failed`` (path, error_msg): the catalogue
    with a row of type UNKNOWN and status error for each path, in place of any
    other, under the id that the path had; and log rows (phase, level, message,
    path, logged_at). Of several messages of a path the least holds."""
    one = failed.where("path is not null").groupBy("path").agg(F.min("error_msg").alias("error_msg"))
    had = files.groupBy("path").agg(F.min("file_id").alias("file_id"))
    given = {"file_type": F.lit("UNKNOWN"), "status": F.lit("error"), "updated_at": now, "scanned_at": now}
    rows = one.join(had, "path", "left")
    new = rows.select(*[F.col(c) if c in rows.columns else given.get(c, F.lit(None)).cast(files.schema[c].dataType).alias(c) for c in files.columns])
    log = one.select(F.lit("scan").alias("phase"), F.lit("ERROR").alias("level"), F.col("error_msg").alias("message"), "path", now.alias("logged_at"))
    return upsert(files, new, "path"), log


def delete_keys(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Without the rows of ``gone``; KeyError if one does not exist."""
    lost = [r[0] for r in gone.select(key).join(existing.select(key), key, "left_anti").limit(3).collect()]
    if lost:
        raise KeyError(lost[0])
    return existing.join(gone.select(key), key, "left_anti")


def merge_override(existing: Column, given: Column, present: Column) -> Column:
    """A field of an override: what is given if the field is present, blank as null, else what was there."""
    return F.when(present, F.nullif(F.trim(given), F.lit(""))).otherwise(existing)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def replace_partition(df: DataFrame, path: str, column: str, value: str) -> None:
    """Write one partition anew and leave the others: a repeated run replaces its own rows."""
    df.drop(column).write.mode("overwrite").parquet(f"{path}/{column}={value}")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def html_report(groups: DataFrame, title: str, limit: int | None = None) -> str:
    """A page of collapsible groups (mother, total, children), largest first.
    With ``limit`` only so many groups are shown, and the page says how many are
    not; for more folders than one page can hold see :func:`write_html`."""
    ordered = groups.orderBy(F.desc("total"), "mother")
    shown = ordered.limit(limit) if limit else ordered
    body, n = [], 0
    for r in shown.toLocalIterator():
        n += 1
        body.append(f"<details><summary>{escape(r.mother)} ({r.total})</summary><ul>" + "".join(f"<li>{escape(c.folder)}: {c.files}</li>" for c in r.children) + "</ul></details>")
    left = groups.count() - n if limit else 0
    more = f"<p>{left} more</p>" if left else ""
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>{''.join(body)}{more}"


def write_html(folders: DataFrame, path: str) -> None:
    """The same list as text files, one folder (folder, files) a line under a
    line for its mother, in order of the mothers' totals: any number of folders,
    none of them gathered."""
    mother = F.coalesce(parent(F.col("folder")), F.lit(""))
    rows = folders.select(mother.alias("mother"), "folder", "files")
    totals = rows.groupBy("mother").agg(F.sum("files").alias("total"))
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    heads = totals.select("mother", "total", F.lit(None).cast("long").alias("files"), F.lit("").alias("folder"), F.concat(F.lit("<h2>"), text(F.col("mother")), F.lit(" ("), "total", F.lit(")</h2>")).alias("value"))
    lines = rows.join(totals, "mother").select("mother", "total", "files", "folder", F.concat(F.lit("<li>"), text(F.col("folder")), F.lit(": "), "files", F.lit("</li>")).alias("value"))
    heads.unionByName(lines).orderBy(F.desc("total"), "mother", F.desc_nulls_first("files"), "folder").select("value").write.mode("overwrite").text(path)
