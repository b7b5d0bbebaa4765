"""Queries of the general training-data operators: hot keys (p4) and timestamps (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.hashes import valid_hex
from shelfmark.functions.timestamps import normalise_timestamps
from shelfmark.operators.hotkeys import key_profiles
from shelfmark.runtime import table

#: A key is reported as hot from this share of all rows.
HOT_SHARE = 0.01


def _profiles(spark: SparkSession, sf_dir: str, min_share: float) -> DataFrame:
    files = table(spark, sf_dir, "files")
    keys = {"phash": valid_hex(F.col("phash"), 16), "sha256": valid_hex(F.col("sha256"), 64)}
    return key_profiles(files, keys, F.col("size_bytes"), F.col("scanned_at"), min_share)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir, HOT_SHARE).select("field_name", "key_value")


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir, 0.0)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, roots = table(spark, sf_dir, "files"), table(spark, sf_dir, "scan_roots")
    return normalise_timestamps(files, roots, ["datetime_original", "datetime_digitized", "mtime"])


QUERIES = {"p4_found": p4_found, "p4_profile": p4_profile, "p6_found": p6_found}

_KEYS = """
keyed as (
  select 'phash' as field_name, lower(trim(phash)) as key_value, size_bytes, scanned_at from files
  where regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}')
  union all
  select 'sha256', lower(trim(sha256)), size_bytes, scanned_at from files
  where regexp_full_match(lower(trim(sha256)), '[0-9a-f]{64}')
)
"""

SQL = {
    "p4_found": f"""with {_KEYS}
select field_name, key_value from keyed group by 1, 2
having count(*) / (select count(*) from files)::double >= 0.01""",
    "p4_profile": f"""with {_KEYS},
ranked as (
  select field_name, key_value, size_bytes,
    row_number() over (partition by field_name, key_value order by size_bytes) as r,
    count(*) over (partition by field_name, key_value) as n
  from keyed where size_bytes is not null
),
quantile as (
  select field_name, key_value,
    max(size_bytes) filter (where r = greatest(1, ceil(0.5 * n))) as p50_value,
    max(size_bytes) filter (where r = greatest(1, ceil(0.9 * n))) as p90_value
  from ranked group by 1, 2
),
totals as (
  select field_name, key_value, count(*) as row_count, count(size_bytes) as value_count,
    cast(sum(size_bytes) as bigint) as total_value, min(size_bytes) as min_value, max(size_bytes) as max_value,
    min(scanned_at) as first_stamp, max(scanned_at) as last_stamp
  from keyed group by 1, 2
)
select t.*, q.p50_value, q.p90_value from totals t left join quantile q using (field_name, key_value)""",
}
