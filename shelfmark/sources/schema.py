"""Versions of the catalogue's tables: upgrades of older ones, refusal of newer ones."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column; ``since`` is the first version that has it, ``values`` what it may hold."""

    name: str
    type: str
    since: int = 1
    default: object = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    version: int
    columns: tuple[Field, ...]


# States and types of the tables.
STATES = ("pending", "scanned", "hashed", "flagged", "confirmed", "done", "error")
OPERATIONS = ("MOVE", "RENAME", "STAGE_DELETE", "DELETE")
OPERATION_STATES = ("planned", "confirmed", "in_progress", "done", "error", "skipped")

FILES = Table("files", 3, (
    Field("file_id", "long"), Field("path", "string"), Field("filename", "string"), Field("extension", "string"), Field("size_bytes", "long"), Field("mtime", "string"),
    Field("file_type", "string", default="UNKNOWN"), Field("datetime_original", "string"), Field("datetime_digitized", "string"), Field("camera_make", "string"), Field("camera_model", "string"),
    Field("width", "int"), Field("height", "int"), Field("gps_lat", "double"), Field("gps_lon", "double"), Field("iso", "int"), Field("software", "string"), Field("sha256", "string"), Field("phash", "string"),
    Field("rating", "int", 2), Field("keywords", "string", 2), Field("duration_seconds", "double", 2), Field("status", "string", values=STATES), Field("error_msg", "string"), Field("scanned_at", "string"), Field("updated_at", "string"),
    Field("date_source", "string", 3), Field("date_confidence", "string", 3),
))
RUNS = Table("operations", 2, (
    Field("op_id", "long"), Field("file_id", "long"), Field("op_type", "string", values=OPERATIONS), Field("source_path", "string"), Field("target_path", "string"), Field("status", "string", values=OPERATION_STATES),
    Field("error_msg", "string"), Field("planned_at", "string"), Field("executed_at", "string"), Field("stage_reason", "string", 2), Field("dupe_of_file_id", "long", 2),
))


def violations(rows: DataFrame, table: Table) -> DataFrame:
    """Rows that hold a value which the table does not allow; null is allowed."""
    bad = [F.col(c.name).isNotNull() & ~F.col(c.name).isin(*c.values) for c in table.columns if c.values and c.name in rows.columns]
    return rows.where(reduce(lambda a, b: a | b, bad, F.lit(False)))


def upgrade(rows: DataFrame, table: Table, version: int) -> DataFrame:
    """``rows`` of an older version with the columns of the present one, in its
    order; missing columns get their defaults, others are dropped. A newer
    version, and values that are not allowed, are refused with ValueError."""
    if version > table.version:
        raise ValueError(f"{table.name} has version {version}, newer than {table.version}")
    if wrong := violations(rows, table).limit(1).collect():
        raise ValueError(f"{table.name} holds a value that is not allowed: {wrong[0]}")
    return rows.select(*[F.col(c.name).cast(c.type) if c.name in rows.columns else F.lit(c.default).cast(c.type).alias(c.name) for c in table.columns])
