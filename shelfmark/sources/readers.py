"""Readers: file listings, raw metadata, tables, configuration."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import metadata
from shelfmark.functions.classify import classify, extension, is_supported
from shelfmark.functions.paths import base_name
from shelfmark.runtime import spread
from shelfmark.sources.fsops import digest

# Folders that a walk leaves out.
SKIPPED = ("_staging", ".Spotlight-V100", ".Trashes", ".fseventsd")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, mtime) of the supported files below ``root``, without
    hidden and system folders. Contents are not read: the column is not selected."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    rel = F.substring(F.col("path"), len(root.rstrip("/")) + 1, 2**31 - 1)
    hidden = F.exists(F.split(rel, "/"), lambda p: p.startswith(".") | p.isin(*SKIPPED))
    return rows.where(~hidden & is_supported(F.col("path")))


def unseen(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files that have no row without error yet."""
    return listing.join(files.where("status <> 'error'").select("path"), "path", "left_anti")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, tags): records of extracted metadata, one JSON object a line; every value as text."""
    lines = spark.read.text(path)
    tags = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return lines.select(tags.alias("tags")).where("tags is not null").select(F.col("tags")["SourceFile"].alias("path"), "tags")


def extract_batches(listing: DataFrame, tool: Callable[[list[str]], dict[str, dict]], batch: int = 200) -> DataFrame:
    """(path, tags, error) by a tool that is given ``batch`` paths at once on the
    executors. A batch that fails gives empty tags and the reason; see
    :func:`command_tool` for a tool with a time limit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            paths = list(frame["path"])
            for at in range(0, len(paths), batch):
                some, error = paths[at : at + batch], None
                try:
                    found = tool(some)
                except Exception as e:  # noqa: BLE001 - one bad batch must not end the scan
                    found, error = {}, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": some, "tags": [{k: str(v) for k, v in found.get(p, {}).items()} for p in some], "error": pd.Series([error] * len(some), dtype=object)})

    return listing.select("path").mapInPandas(run, "path string, tags map<string,string>, error string")


def command_tool(command: list[str], seconds: float = 120.0) -> Callable[[list[str]], dict[str, dict]]:
    """A tool that runs ``command`` with the paths as further arguments and reads
    a JSON list of objects, each with its SourceFile, from its output."""

    def tool(paths: list[str]) -> dict[str, dict]:
        done = subprocess.run([*command, *paths], capture_output=True, timeout=seconds, check=False)
        if not done.stdout.strip():
            raise RuntimeError(done.stderr.decode(errors="replace")[:200] or f"no output, status {done.returncode}")
        return {r["SourceFile"]: r for r in json.loads(done.stdout) if "SourceFile" in r}

    return tool


def file_rows(listing: DataFrame, tags: DataFrame, secondary: bool = False) -> DataFrame:
    """Catalogue rows from a listing and its metadata; files without tags keep nulls."""
    t = F.col("tags")
    j = listing.join(tags, "path", "left").withColumn("tags", F.coalesce(t, F.create_map().cast("map<string,string>")))
    size, place = metadata.dimensions(t), metadata.gps(t)
    return j.select(
        "path", base_name(F.col("path")).alias("filename"), extension(F.col("path")).alias("extension"), "size_bytes",
        F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("mtime"),
        classify(F.col("path"), t["Software"], size["width"], secondary).alias("file_type"),
        metadata.capture_date(t).alias("datetime_original"), t["DateTimeDigitized"].alias("datetime_digitized"),
        t["Make"].alias("camera_make"), t["Model"].alias("camera_model"),
        F.nullif(size["width"], F.lit(0)).alias("width"), F.nullif(size["height"], F.lit(0)).alias("height"),
        place["lat"].alias("gps_lat"), place["lon"].alias("gps_lon"), place["alt"].alias("gps_alt"),
        metadata.iso(t).alias("iso"), metadata.aperture(t).alias("aperture"), metadata.focal_length(t).alias("focal_length"),
        t["Software"].alias("software"), metadata.rating(t).alias("rating"), metadata.keywords(t).alias("keywords"),
        metadata.description(t).alias("description"), metadata.label(t).alias("label"),
        metadata.duration(t).alias("duration_seconds"), metadata.codec(t).alias("video_codec"), metadata.frame_rate(t).alias("frame_rate"),
        F.lit("scanned").alias("status"),
    )


def hash_contents(listing: DataFrame) -> DataFrame:
    """(path, sha256) of the listed files, read in blocks where the executors
    reach them, so a file may be of any size; null if it cannot be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path in frame["path"]:
                try:
                    found.append(digest(path))
                except OSError:
                    found.append(None)
            yield pd.DataFrame({"path": frame["path"], "sha256": pd.Series(found, dtype=object)})

    return spread(listing.select("path")).mapInPandas(run, "path string, sha256 string")


def select_files(files: DataFrame, types: tuple[str, ...] = (), status: str | None = None) -> DataFrame:
    """Catalogue rows by type and status; both filters reach the scan."""
    if types:
        files = files.where(F.col("file_type").isin(*types))
    return files.where(F.col("status") == status) if status else files


@dataclass
class Config:
    """Settings of a library; other keys are ignored."""

    db: str
    input_dirs: list[str]
    target_dir: str | None = None
    workers: int = 4
    hamming_threshold: int = 8
    use_secondary_signals: bool = False
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, text: str) -> Config:
        raw = json.loads(text)
        missing = [k for k in ("db", "input_dirs") if not raw.get(k)]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        return cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})

    def problems(self) -> list[tuple[str, str]]:
        """(severity, message): roots of a drive, repeated and overlapping folders, a target inside an input."""
        out: list[tuple[str, str]] = []
        split = [PurePath(d.replace("\\", "/").rstrip("/").lower() or "/") for d in self.input_dirs]
        for i, (raw, p) in enumerate(zip(self.input_dirs, split)):
            if len(p.parts) <= 1:
                out.append(("error", f"{raw} is the root of a drive"))
            for q in split[:i]:
                if p == q:
                    out.append(("error", f"{raw} is listed twice"))
                elif q in p.parents or p in q.parents:
                    out.append(("warning", f"{raw} overlaps another folder"))
            if self.target_dir:
                t = PurePath(self.target_dir.replace("\\", "/").rstrip("/").lower())
                if t == p or p in t.parents:
                    out.append(("error", f"the target lies inside {raw}"))
        return out


def library_path(flag: str | None, config: Config | None, target: str | None) -> str:
    """The ledger's place: flag, then configuration, then the default below the target."""
    return flag or (config.db if config else None) or f"{target or '.'}/.library/library"
