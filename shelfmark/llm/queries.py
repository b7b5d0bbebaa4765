"""Queries pN_ of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import cells, components, fusion, garble, mixing, neighbours, tokens
from shelfmark.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_groups(components.counted_links(table(spark, sf_dir, "duplicates")))


def p2_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field by its maximum posterior; maps and lists as texts."""
    return fusion.golden_records(*(table(spark, sf_dir, t) for t in ("files", "duplicates", "known_cameras", "scan_roots")))


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivor with its own values, and the fused ones only where it has none."""
    g = p2_golden(spark, sf_dir)
    return g.select("group_id", "keep_file_id", *[F.coalesce(F.col("own")[n], F.col(n)).alias(n) for n in fusion.FIELDS], "filled")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and ranking alone name the survivor; its values take no part in that."""
    files, duplicates, cameras = (table(spark, sf_dir, t) for t in ("files", "duplicates", "known_cameras"))
    return fusion.survivors(fusion.duplicate_groups(duplicates), duplicates, files, cameras).select("group_id", "keep_file_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.match_new_files(table(spark, sf_dir, "files"))


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.nearest_accepted(table(spark, sf_dir, "files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_hashes(table(spark, sf_dir, "files"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mixing.mix_report(mixing.mix_sources(documents, targets), documents, targets)


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.restore_texts(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_restored(spark, sf_dir).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_golden": p2_golden,
    "p2_filled": p2_filled,
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p5_found": p5_found,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_LINKS = """
links as (
  select distinct file_id_a as a, file_id_b as b from duplicates
  where file_id_a <> file_id_b and (dup_type = 'EXACT' or coalesce(hamming_distance, 0) <= 2)
),
both_ways as (select a, b from links union select b, a from links),
reach(file_id, root) as (
  select a, a from both_ways
  union
  select e.b, r.root from reach r join both_ways e on e.a = r.file_id where r.root < e.b
),
grouped as (select file_id, min(root) as group_id from reach group by file_id)
"""

_HASHED = """
hashed as (
  select file_id, coalesce(status, '') as status,
    case when regexp_full_match(lower(trim(sha256)), '[0-9a-f]{64}') then lower(trim(sha256)) end as s,
    case when regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}') then lower(trim(phash)) end as p
  from files
)
"""

SQL: dict[str, str] = {
    "p1_found": f"with recursive {_LINKS} select file_id, group_id from grouped",
    "p2_found": f"""with recursive {_LINKS},
facts as (
  select g.group_id, g.file_id,
    case when f.width > 0 and f.height > 0 then f.width::bigint * f.height else 0 end as area,
    coalesce(f.size_bytes, 0) as size,
    case when lower(trim(f.camera_model)) in (select lower(trim(model)) from known_cameras where owner = 'self') then 1 else 0 end as own,
    length(f.path) as len
  from grouped g left join files f using (file_id)
),
ranked as (
  select group_id, file_id, row_number() over (partition by group_id order by area desc, size desc, own desc, len, file_id) as r from facts
),
decided as (
  select g.group_id, d.keep_file_id,
    row_number() over (partition by g.group_id order by coalesce(d.resolved_at, '') desc, d.keep_file_id) as r
  from duplicates d join grouped g on g.file_id = d.file_id_a
  join grouped k on k.file_id = d.keep_file_id and k.group_id = g.group_id
  where d.status in ('reviewed', 'resolved') and d.file_id_a <> d.file_id_b
    and (d.dup_type = 'EXACT' or coalesce(d.hamming_distance, 0) <= 2)
)
select r.group_id, coalesce(d.keep_file_id, r.file_id) as keep_file_id
from ranked r left join decided d on d.group_id = r.group_id and d.r = 1 where r.r = 1""",
    "p3_found": f"""with {_HASHED},
rare as (
  select file_id, status,
    case when count(*) over (partition by s) < 8 then s end as s,
    case when count(*) over (partition by p) < 8 then ('0x' || p)::ubigint end as p
  from hashed
),
old as (select * from rare where status = 'done'),
new as (select * from rare where status not in ('done', 'error'))
select least(o.file_id, n.file_id) as file_id_a, greatest(o.file_id, n.file_id) as file_id_b
from old o join new n on bit_count(xor(o.p, n.p)) <= 6
union
select least(o.file_id, n.file_id), greatest(o.file_id, n.file_id) from old o join new n on o.s = n.s""",
    "p3_nearest": f"""with {_HASHED},
k as (select file_id, status, ('0x' || p)::ubigint as k from hashed where p is not null),
old as (select k, min(file_id) as file_id from k where status = 'done' group by 1),
new as (select * from k where status not in ('done', 'error')),
near as (select n.k, o.file_id, bit_count(xor(n.k, o.k))::int as distance from (select distinct k from new) n join old o on bit_count(xor(n.k, o.k)) <= 6),
best as (select k, (array_agg(file_id order by distance, file_id))[1] as nearest_id, min(distance) as distance from near group by 1)
select n.file_id, b.nearest_id, b.distance from new n join best b using (k)""",
    "p5_found": f"""with {_HASHED},
keys as (select distinct p, ('0x' || p)::ubigint as k from hashed where p is not null),
near as (
  select a.p as x, b.p as y, row_number() over (partition by a.p order by bit_count(xor(a.k, b.k)), b.p) as r
  from keys a join keys b on a.k <> b.k and bit_count(xor(a.k, b.k)) <= 6
)
select distinct least(x, y) as phash_a, greatest(x, y) as phash_b from near where r <= 3""",
}
