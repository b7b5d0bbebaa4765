"""Queries of joins, pairs, survivors, overlaps, events, plans and the ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.functions import naming, paths
from shelfmark.functions.hashes import hex_to_long, valid_hex
from shelfmark.operators import events, graph, ledger, overlap, pairs, survivor
from shelfmark.plans import incremental, organise
from shelfmark.queries.reports import LADDER_SQL, NAME, PARENT, STEM, container_sql, exif_sql, sanitize_sql, today, unorganised_sql
from shelfmark.runtime import number_rows, spread, table, write_scratch
from shelfmark.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        names = fn.__code__.co_varnames[: fn.__code__.co_argcount]
        QUERIES[name] = lambda spark, sf_dir: fn(*(table(spark, sf_dir, n) for n in names))
        if sql:
            SQL[name] = sql
        return fn

    return add


#: Near hashes are looked for within so many bits.
RADIUS = 8


def hashed(files):
    text = valid_hex(F.col("phash"), 16)
    return files.withColumns({"sha256": valid_hex(F.col("sha256"), 64), "phash": text, "key": F.when(text.isNotNull(), hex_to_long(text))})


def ranking(rows, known_cameras):
    """The ranked files, written once: several branches of a query read them."""
    needed = rows.drop("error_msg", "keywords", "updated_at", "scanned_at", "date_source", "rating", "software", "key")
    return write_scratch(survivor.with_rank(spread(needed), known_cameras), "ranked")[0]


HASHED = """
h as (
  select * replace (
    case when regexp_full_match(lower(trim(sha256)), '[0-9a-f]{64}') then lower(trim(sha256)) end as sha256,
    case when regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}') then lower(trim(phash)) end as phash)
  from files
)"""
RANKED = f"""
ranked as (
  select f.*, coalesce(width, 0)::bigint * coalesce(height, 0) as area, coalesce(size_bytes, 0) as size0,
    (coalesce(lower(camera_model), '') <> '' and lower(camera_model) in (select lower(model) from known_cameras where owner = 'self'))::int as own,
    (not {unorganised_sql(NAME.format(PARENT.format('path')))} and {sanitize_sql(NAME.format(PARENT.format('path')))} <> '')::int as event,
    length(path) as len
  from h f
)"""
ORDER = "area desc, size0 desc, own desc, event desc, len, file_id"


def join_sql(items: str, sep: str = "sep") -> str:
    """Path parts as a text with the path's own separator."""
    return rf"case when {sep} = '/' then array_to_string({items}, '/') else array_to_string({items}, '\') end"


def components_sql(edges: str, name: str = "comp", node: str = "file_id", out: str = "group_id") -> str:
    """Recursive components of a table (a, b) named by ``edges``."""
    return f"""
{name}_e as (select a, b from {edges} where a <> b union select b, a from {edges} where a <> b),
{name}_r(n, root) as (select a, a from {name}_e union select e.b, r.root from {name}_r r join {name}_e e on e.a = r.n where r.root < e.b),
{name} as (select n as {node}, min(root) as {out} from {name}_r group by n)"""


@query("j01_worklist", "select o.op_id, o.file_id, o.op_type, f.path, f.file_type from (select distinct op_id, file_id, op_type, status from operations) o join files f using (file_id) where o.status = 'confirmed' and o.op_type = 'MOVE'")
def _(operations, files):
    ops = operations.dropDuplicates(["op_id", "file_id", "op_type", "status"])
    return ledger.worklist(ops, files, op_type="MOVE").select("op_id", "file_id", "op_type", "path", "file_type")


@query("j02_files_with_confirmed", "select file_id from files where file_id in (select file_id from operations where status = 'confirmed')")
def _(files, operations):
    return files.join(operations.where("status = 'confirmed'").select("file_id"), "file_id", "left_semi").select("file_id")


@query("j03_orphan_operations", "select distinct op_id, file_id from operations o where not exists (select 1 from files f where f.file_id = o.file_id)")
def _(operations, files):
    return ledger.orphan_operations(operations, files).select("op_id", "file_id").distinct()


@query("j04_exact_links", f"""with {HASHED}, g as (select sha256, min(file_id) as first_id from h where sha256 is not null group by 1)
select g.first_id as a, h.file_id as b from h join g using (sha256) where h.file_id <> g.first_id""")
def _(files):
    return pairs.star_edges(hashed(files), "sha256", "file_id")


@query("a12_exact_groups", f"with {HASHED} select sha256, min(file_id) as first_id, count(*) as members from h where sha256 is not null group by 1 having count(*) > 1")
def _(files):
    return pairs.equal_key_groups(hashed(files), "sha256", "file_id")


@query("x03_exact_star_edges", f"""with {HASHED}, g as (select sha256, min(file_id) as first_id from h where sha256 is not null and status <> 'error' group by 1 having count(*) > 1)
select g.first_id as file_id_a, h.file_id as file_id_b from h join g using (sha256) where h.file_id <> g.first_id and h.status <> 'error'""")
def _(files):
    return survivor.exact_star_edges(hashed(files))


@query("j06_near_classes", f"""with {HASHED}, k as (select file_id, ('0x' || phash)::ubigint as k from h where phash is not null and file_type in ('CAMERA_JPEG', 'DEV_JPEG', 'HEIC')),
g as (select k, min(file_id) as class_id, count(*) as members from k group by 1),
near as (select a.k, sum(b.members) as m from g a join g b on a.k <> b.k and bit_count(xor(a.k, b.k)) <= {RADIUS} group by 1)
select k.file_id, g.class_id, g.members, (g.members - 1 + coalesce(m, 0))::bigint as links from k join g using (k) left join near using (k)""")
def _(files):
    return pairs.near_classes(hashed(files).where(F.col("file_type").isin("CAMERA_JPEG", "DEV_JPEG", "HEIC")), "key", "file_id", RADIUS)


@query("j06_near_links", f"""with {HASHED}, k as (select file_id, ('0x' || phash)::ubigint as k from h where phash is not null and file_type in ('CAMERA_JPEG', 'DEV_JPEG', 'HEIC')),
g as (select k, min(file_id) as f from k group by 1)
select g.f as file_id_a, k.file_id as file_id_b, 0 as hamming_distance from k join g using (k) where k.file_id <> g.f
union all select least(a.f, b.f), greatest(a.f, b.f), bit_count(xor(a.k, b.k))::int from g a join g b on a.k < b.k and bit_count(xor(a.k, b.k)) <= {RADIUS}""")
def _(files):
    return pairs.near_links(hashed(files).where(F.col("file_type").isin("CAMERA_JPEG", "DEV_JPEG", "HEIC")), "key", "file_id", RADIUS)


@query("k04_normalised_links", """select least(file_id_a, file_id_b) as file_id_a, greatest(file_id_a, file_id_b) as file_id_b, min(dup_type) as dup_type,
 arg_min(coalesce(hamming_distance, -1), ((dup_type <> 'EXACT')::int, (hamming_distance is null)::int, coalesce(hamming_distance, 0))) as hamming_distance
from duplicates where file_id_a <> file_id_b group by 1, 2""")
def _(duplicates):
    return pairs.normalise_edges(duplicates).withColumn("hamming_distance", F.coalesce("hamming_distance", F.lit(-1)))


@query("k04_new_star_links", f"""with {HASHED}, g as (select sha256, min(file_id) as f from h where sha256 is not null group by 1)
select g.f as file_id_a, h.file_id as file_id_b, 'EXACT' as dup_type, 0 as hamming_distance from h join g using (sha256) where h.file_id <> g.f
and not exists (select 1 from duplicates d where d.dup_type = 'EXACT' and least(d.file_id_a, d.file_id_b) = g.f and greatest(d.file_id_a, d.file_id_b) = h.file_id)""")
def _(files, duplicates):
    return pairs.new_exact_links(duplicates, hashed(files))


@query("a13_exact_components", f"with recursive links as (select file_id_a as a, file_id_b as b from duplicates where dup_type = 'EXACT'), {components_sql('links')} select file_id, group_id from comp")
def _(duplicates):
    return survivor.exact_groups(duplicates)


@query("a15_exact_losers", f"""with recursive {HASHED}, {RANKED}, links as (select file_id_a as a, file_id_b as b from duplicates where dup_type = 'EXACT'), {components_sql('links')},
m as (select c.group_id, r.file_id, first_value(r.file_id) over (partition by c.group_id order by {ORDER}) as keeper from comp c join ranked r using (file_id))
select file_id, keeper from m where file_id <> keeper""")
def _(files, duplicates, known_cameras):
    return survivor.exact_losers(duplicates, ranking(hashed(files), known_cameras))


@query("w01_keep_rank", f"""with {HASHED}, {RANKED} select file_id, sha256, row_number() over (partition by sha256 order by {ORDER}) as place from ranked where sha256 is not null""")
def _(files, known_cameras):
    rows = ranking(hashed(files), known_cameras).where("sha256 is not null")
    order = [(-F.col(f"keep_rank.{c}")) for c in ("area", "size", "own", "event", "short", "first")]
    return number_rows(rows.select("file_id", "sha256", "keep_rank"), "place", *order, group="sha256").drop("keep_rank")


NEAR_LOSERS = """
near_losers as (
  select case when keep_file_id = file_id_b then file_id_a else file_id_b end as file_id, arg_max(keep_file_id, dup_id) as keeper
  from duplicates where dup_type = 'NEAR' and status = 'reviewed' and keep_file_id is not null group by 1
)"""


@query("x08_near_losers", f"with {NEAR_LOSERS} select file_id, keeper from near_losers")
def _(duplicates):
    return survivor.near_losers(duplicates)


_TOKENS = ", ".join(f"'{t}'" for t in naming.DERIVATIVE_TOKENS)
_CAMERA = r"(?i)^(?:img|_mg|dsc|dscf|dscn|pict?|photo|mvi|gopr|pano|cimg|hpim|sdc|dji)[-_]?\d{3,}$"
REDUNDANT = rf"""
copies as (
  select *, lower(trim({STEM.format('filename')})) as stem, regexp_matches(trim({STEM.format('filename')}), '{_CAMERA}') as cam, width / height::double as aspect
  from ranked where file_type in ('CAMERA_JPEG', 'DEV_JPEG', 'HEIC') and width > 0 and height > 0
),
dated as (select * from copies where datetime_original is not null),
content as (select * from dated where phash is not null and phash not in (select phash from h where phash is not null group by 1 having count(*) >= 8)),
anchor as (
  select datetime_original, phash, coalesce((array_agg(file_id order by {ORDER}) filter (where cam))[1], min(file_id)) as anchor from content group by 1, 2
),
shot_links as (
  select a.file_id as a, b.file_id as b from dated a join dated b on a.stem = b.stem and a.datetime_original = b.datetime_original and a.file_id < b.file_id and abs(a.aspect - b.aspect) <= 0.02
  union select c.file_id, x.anchor from content c join anchor x on x.datetime_original = c.datetime_original and x.phash = c.phash where not c.cam and c.file_id <> x.anchor
),
{components_sql('shot_links', 'shot', 'file_id', 'component')},
shot_best as (select s.component, s.file_id, first_value(d.file_id) over (partition by s.component order by {ORDER}) as keeper from shot s join dated d using (file_id)),
placed as (
  select f.file_id, f.filename, lower({PARENT.format('path')}) as folder, string_split_regex(lower(path), '[\\/]') as p, case when contains(path, '\') then '\' else '/' end as sep from h f
),
rooted as (
  select *, list_position(list_transform(p[:len(p) - 1], lambda x: list_has_any(string_split_regex(x, '[^a-z0-9]+'), [{_TOKENS}])), true) as spot from placed
),
derivative as (select *, lower(trim({STEM.format('filename')})) as stem, case when spot > 0 then {join_sql('p[:spot - 1]')} end as root from rooted),
folder_rule as (
  select d.file_id, min(m.file_id) as keeper from derivative d join copies c using (file_id) join derivative m on m.stem = d.stem and m.root is null and starts_with(m.folder, d.root)
  where d.root is not null group by 1
),
redundant as (
  select file_id, keeper from shot_best where file_id <> keeper
  union all select file_id, keeper from folder_rule where file_id not in (select file_id from shot_best where file_id <> keeper)
)"""


@query("x05_redundant_copies", f"with recursive {HASHED}, {RANKED}, {REDUNDANT} select file_id, keeper from redundant")
def _(files, known_cameras):
    ranked = ranking(hashed(files), known_cameras)
    return survivor.redundant_copies(ranked, ranked)


CLUSTERS = f"""
sha_losers as (select file_id from (select file_id, row_number() over (partition by sha256 order by {ORDER}) as r from ranked where sha256 is not null) where r > 1),
junk_files as (select file_id from h where phash in (select phash from h where phash is not null group by 1 having count(*) >= 8)),
excluded as (select file_id from sha_losers union select file_id from junk_files union select file_id from redundant),
near_links as (
  select file_id_a as a, file_id_b as b, coalesce(hamming_distance, 0) as d from duplicates where dup_type = 'NEAR' and status = 'pending' and coalesce(hamming_distance, 0) <= 2
    and file_id_a <> file_id_b and file_id_a not in (select file_id from excluded) and file_id_b not in (select file_id from excluded)
),
{components_sql('near_links', 'cl', 'file_id', 'cluster_id')},
cluster_min as (select cl.cluster_id, min(d) as min_hamming from near_links n join cl on cl.file_id = n.a group by 1)"""


@query("x06_near_clusters", f"with recursive {HASHED}, {RANKED}, {REDUNDANT}, {CLUSTERS} select cl.file_id, cl.cluster_id, m.min_hamming from cl join cluster_min m using (cluster_id)")
def _(files, duplicates, known_cameras):
    ranked = ranking(hashed(files), known_cameras)
    return survivor.near_clusters(ranked, duplicates, ranked, survivor.redundant_copies(ranked, ranked))


@query("x07_resolved_clusters", f"""with recursive {HASHED}, {RANKED}, {REDUNDANT}, {CLUSTERS},
m as (select cl.cluster_id, lower(trim({STEM.format('r.filename')})) as stem, r.*, (coalesce(width, 0) < 200 or coalesce(height, 0) < 200 or coalesce(size_bytes, 0) = 0) as bad from cl join ranked r using (file_id)),
g as (select cluster_id, stem, count(*) as members, bool_or(bad) as degenerate, (array_agg(file_id order by {ORDER}))[1] as best from m group by 1, 2)
select cluster_id, stem, members, case when not degenerate and members > 1 then best end as keeper, degenerate, count(*) over (partition by cluster_id) > 1 as several_stems from g""")
def _(files, duplicates, known_cameras):
    ranked = ranking(hashed(files), known_cameras)
    return survivor.resolve_clusters(survivor.near_clusters(ranked, duplicates, ranked, survivor.redundant_copies(ranked, ranked)), ranked)


@query("x08_applied_decisions", """with d as (select file_id, file_type as cluster, min(file_id) over (partition by file_type) as keeper from files where file_type in ('HEIC', 'DEV_JPEG'))
select x.dup_id, count(*) as copies, min(case when x.dup_type = 'NEAR' and x.status = 'pending' and a.cluster = b.cluster then 'reviewed' else x.status end) as status,
  min(case when x.dup_type = 'NEAR' and x.status = 'pending' and a.cluster = b.cluster then a.keeper else x.keep_file_id end) as keep_file_id
from duplicates x left join d a on a.file_id = x.file_id_a left join d b on b.file_id = x.file_id_b group by 1""")
def _(files, duplicates):
    some = files.where("file_type in ('HEIC', 'DEV_JPEG')")
    keepers = some.groupBy("file_type").agg(F.min("file_id").alias("keeper"))
    decisions = some.join(keepers, "file_type").select("file_id", F.col("file_type").alias("cluster_id"), "keeper")
    done = survivor.apply_decisions(duplicates, decisions, F.lit("2026-01-01T00:00:00+00:00"))
    return done.groupBy("dup_id").agg(F.count("*").alias("copies"), F.min("status").alias("status"), F.min("keep_file_id").alias("keep_file_id"))


MEMBERS = rf"""
up as (select distinct sha256, string_split_regex(path, '[\\/]') as p, case when contains(path, '\') then '\' else '/' end as sep from h where sha256 is not null and status <> 'error'),
members as (
  select distinct folder, sha256 from (select sha256, {join_sql('p[:i]')} as folder from (select sha256, p, sep, unnest(range(2, len(p))) as i from up)) m
  where exists (select 1 from scan_roots r where starts_with(lower(replace(folder, '/', '\')) || '\', lower(replace(rtrim(r.path_prefix, '\/'), '/', '\')) || '\'))
)"""


@query("a25_subtree_sets", f"with {HASHED}, {MEMBERS} select folder, count(*) as items from members group by 1")
def _(files, scan_roots):
    return overlap.subtree_members(hashed(files).where("status <> 'error'"), scan_roots).groupBy("folder").agg(F.count("*").alias("items"))


def _twins_sql(coverage: float, shared: int) -> str:
    marks = lambda c: " + ".join(f"(contains(lower({c}), '{m}'))::int" for m in naming.NONCANONICAL)
    below = lambda x, y: rf"starts_with({x}, {y} || case when contains({y}, '\') then '\' else '/' end)"
    return f"""
sizes as (select folder, count(*) as n from members group by 1),
useful as (select * from members where sha256 in (select sha256 from members group by 1 having count(*) between 2 and 30)),
both_sides as (select a.folder as fa, b.folder as fb, count(*) as shared from useful a join useful b on a.sha256 = b.sha256 and a.folder < b.folder where not {below('a.folder', 'b.folder')} and not {below('b.folder', 'a.folder')} group by 1, 2 having count(*) >= {shared}),
twins as (
  select fa as folder_a, fb as folder_b, shared as shared_count, a.n - shared as a_only_count, b.n - shared as b_only_count, shared / a.n::double as coverage_a, shared / b.n::double as coverage_b,
    case when ({marks('fa')}, length(fa), fa) <= ({marks('fb')}, length(fb), fb) then 'a' else 'b' end as keeper
  from both_sides join sizes a on a.folder = fa join sizes b on b.folder = fb where least(shared / a.n::double, shared / b.n::double) >= {coverage}
)"""


#: True twins hardly exist in the test tables, so the query also looks at weaker overlaps.
WEAK = {"coverage": 0.02, "min_shared": 1}


@query("j14_twin_folders", f"with {HASHED}, {MEMBERS}, {_twins_sql(0.02, 1)} select * from twins")
def _(files, scan_roots):
    return overlap.twin_folders(overlap.subtree_members(hashed(files).where("status <> 'error'"), scan_roots), **WEAK)


_ROLLUP = rf"""
parts as (select folder_a, folder_b, string_split_regex(folder_a, '[\\/]') as pa, string_split_regex(folder_b, '[\\/]') as pb, case when contains(folder_a, '\') then '\' else '/' end as sa, case when contains(folder_b, '\') then '\' else '/' end as sb from twins),
steps as (select folder_a, folder_b, k, {join_sql('pa[:len(pa) - k]', 'sa')} as x, {join_sql('pb[:len(pb) - k]', 'sb')} as y from (select *, unnest(range(1, least(len(pa), len(pb)) - 1)) as k from parts)),
stops as (select folder_a, folder_b, min(k) as stop from steps where x = y group by 1, 2),
covered as (select distinct s.folder_a, s.folder_b from steps s left join stops t using (folder_a, folder_b) join twins u on u.folder_a = least(s.x, s.y) and u.folder_b = greatest(s.x, s.y) where t.stop is null or s.k < t.stop),
rolled as (select t.* from twins t where not exists (select 1 from covered c where c.folder_a = t.folder_a and c.folder_b = t.folder_b))"""


@query("x09_folder_overlaps", f"with {HASHED}, {MEMBERS}, {_twins_sql(0.02, 1)}, {_ROLLUP} select * from rolled")
def _(files, scan_roots):
    return overlap.folder_overlaps(hashed(files), scan_roots, **WEAK)


def _reviewed(files, scan_roots):
    return overlap.folder_overlaps(hashed(files), scan_roots, **WEAK).withColumn("status", F.lit("reviewed"))


MERGE = rf"""
decided as (select distinct folder_a, folder_b, case keeper when 'a' then folder_a else folder_b end as win, case keeper when 'a' then folder_b else folder_a end as lose from rolled),
file_up as (select file_id, sha256, status, {join_sql('p[:i]')} as folder from (select *, unnest(range(2, len(p))) as i from (select file_id, sha256, status, string_split_regex(path, '[\\/]') as p, case when contains(path, '\') then '\' else '/' end as sep from h where status <> 'error'))),
winners as (select folder, sha256, min(file_id) as keeper from file_up where sha256 is not null and folder in (select win from decided) group by 1, 2),
losing as (select d.folder_a, d.folder_b, u.file_id, w.keeper from file_up u join decided d on d.lose = u.folder left join winners w on w.folder = d.win and w.sha256 = u.sha256 where u.status <> 'done'),
merge_losers as (select file_id, min(keeper) as keeper from losing where keeper is not null group by 1)"""


@query("x10_merge_losers", f"with {HASHED}, {MEMBERS}, {_twins_sql(0.02, 1)}, {_ROLLUP}, {MERGE} select file_id, keeper from merge_losers")
def _(files, scan_roots):
    return overlap.merge_losers(hashed(files), _reviewed(files, scan_roots))[0]


@query("x10_unique_to_loser", f"with {HASHED}, {MEMBERS}, {_twins_sql(0.02, 1)}, {_ROLLUP}, {MERGE} select folder_a, folder_b, count(*) filter (where keeper is null) as unique_count from losing group by 1, 2")
def _(files, scan_roots):
    return overlap.merge_losers(hashed(files), _reviewed(files, scan_roots))[1]


@query("j14_true_twins", f"with {HASHED}, {MEMBERS}, {_twins_sql(overlap.COVERAGE, overlap.MIN_SHARED)} select * from twins")
def _(files, scan_roots):
    return overlap.twin_folders(overlap.subtree_members(hashed(files).where("status <> 'error'"), scan_roots))


@query("x09_true_overlaps", f"with {HASHED}, {MEMBERS}, {_twins_sql(overlap.COVERAGE, overlap.MIN_SHARED)}, {_ROLLUP} select * from rolled")
def _(files, scan_roots):
    return overlap.folder_overlaps(hashed(files), scan_roots)


@query("o03_overlaps_by_shared", f"with {HASHED}, {MEMBERS}, {_twins_sql(0.02, 1)}, {_ROLLUP} select folder_a, folder_b, shared_count, row_number() over (order by shared_count desc, folder_a, folder_b) as place from rolled")
def _(files, scan_roots):
    return number_rows(overlap.folder_overlaps(hashed(files), scan_roots, **WEAK).select("folder_a", "folder_b", "shared_count"), "place", -F.col("shared_count"), F.col("folder_a"), F.col("folder_b"))


@query("a35_grouped_review", f"with {HASHED}, {MEMBERS}, {_twins_sql(0.02, 1)}, {_ROLLUP} select {PARENT.format('folder_a')} as parent_a, {PARENT.format('folder_b')} as parent_b, count(*) as pairs, sum(shared_count)::bigint as shared, count(*) as pending from rolled group by 1, 2")
def _(files, scan_roots):
    from shelfmark.operators.reports import grouped_review

    return grouped_review(overlap.folder_overlaps(hashed(files), scan_roots, **WEAK))


FOLDERS = rf"""
folders as (select distinct {PARENT.format('path')} as folder from files where {PARENT.format('path')} is not null),
chain as (select folder, len(p) - i as steps, {join_sql('p[:i]')} as up, p[i] as name from (select folder, p, sep, unnest(range(2, len(p) + 1)) as i from (select folder, string_split_regex(folder, '[\\/]') as p, case when contains(folder, '\') then '\' else '/' end as sep from folders))),
judged as (
  select c.*, not {unorganised_sql('name')} and not {container_sql('name')} and {sanitize_sql('name')} <> '' as good,
    lower(replace(up, '/', '\')) in (select lower(replace(rtrim(path_prefix, '\/'), '/', '\')) from scan_roots) as top
  from chain c
),
limits as (select folder, min(steps) filter (where top) as top_at from judged group by 1),
resolved as (
  select f.folder, (array_agg(j.up order by j.steps) filter (where j.good))[1] as event_folder, (array_agg(j.name order by j.steps) filter (where j.good))[1] as event_name
  from folders f left join limits l using (folder) left join judged j on j.folder = f.folder and (l.top_at is null or j.steps <= l.top_at) group by 1
)"""


@query("f21_event_folders", f"with {FOLDERS} select folder, event_folder, event_name from resolved")
def _(files, scan_roots):
    return events.resolve_folders(files, scan_roots).drop("event_label")


@query("a16_sibling_hints", f"""with d as (select {PARENT.format('path')} as folder, {exif_sql('datetime_original')}::date as day from files where file_type <> 'VIDEO' and status <> 'error' and date_confidence in ('HIGH', 'MEDIUM')),
c as (select folder, day, count(*) as n from d where day is not null and folder is not null group by 1, 2)
select folder, day as hint from (select *, row_number() over (partition by folder order by n desc, day) as r from c) where r = 1""")
def _(files):
    return events.sibling_hints(files)


DAYS = rf"""
conf as (select file_id, {PARENT.format('path')} as folder, {exif_sql('datetime_original')}::date as day from files where file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC') and status <> 'error' and date_confidence in ('HIGH', 'MEDIUM')),
conf_days as (select * from conf where day is not null and folder is not null),
day_counts as (select folder, day, count(*) as n from conf_days group by 1, 2),
day_ranked as (select *, row_number() over (partition by folder order by n desc, day) as r, sum(n) over (partition by folder) as total from day_counts),
dominant as (select folder, day, n, total::bigint as total from day_ranked where r = 1 and n / total::double >= 0.9),
tops as (select lower(replace(rtrim(path_prefix, '\/'), '/', '\')) as k from scan_roots),
event_days as (select distinct r.event_folder, r.event_name, d.day from conf_days d join resolved r using (folder) where r.event_folder is not null and lower(replace(r.event_folder, '/', '\')) not in (select k from tops)),
gaps as (select event_folder, count(*) as days, min(day) as lo, max(day) as hi, max(gap) as max_gap, min(event_name) as event_name from (select *, date_diff('day', lag(day) over (partition by event_folder order by day), day) as gap from event_days) group by 1)"""


@query("a17_dominant_days", f"with {FOLDERS}, {DAYS} select folder, day, n, total from dominant")
def _(files):
    return events.dominant_days(files)


@query("a21_per_day_events", rf"""with {FOLDERS}, {DAYS}, sub as (select d.*, r.event_folder from dominant d join resolved r using (folder) where r.event_folder is not null and r.event_folder <> d.folder and lower(replace(r.event_folder, '/', '\')) not in (select k from tops)),
sd as (select distinct event_folder, day from sub), sg as (select event_folder, count(*) as days, min(day) as lo, max(day) as hi, max(gap) as g from (select *, date_diff('day', lag(day) over (partition by event_folder order by day), day) as gap from sd) group by 1),
n as (select event_folder, count(*) as subfolders from sub group by 1)
select event_folder, days, date_diff('day', lo, hi) + 1 as span, subfolders from sg join n using (event_folder) where days >= 2 and subfolders >= 2 and g <= 3 and date_diff('day', lo, hi) + 1 <= 30""")
def _(files, scan_roots):
    return events.per_day_events(files, events.resolve_folders(files, scan_roots), scan_roots)


@query("a22_scattered_events", f"with {FOLDERS}, {DAYS} select event_folder, days, date_diff('day', lo, hi) + 1 as span from gaps where days >= 2 and max_gap > 3 and date_diff('day', lo, hi) + 1 <= 30")
def _(files, scan_roots):
    return events.scattered_events(files, events.resolve_folders(files, scan_roots), scan_roots)


@query("a23_unconfirmed_subjects", f"""with {FOLDERS}, {DAYS} select event_folder, {sanitize_sql('event_name')} as label, date_diff('day', lo, hi) + 1 as span, days, strftime(lo, '%Y-%m-%d') as date_lo, strftime(hi, '%Y-%m-%d') as date_hi
from gaps where date_diff('day', lo, hi) + 1 > 30 and {sanitize_sql('event_name')} <> '' and event_folder not in (select source_folder from folder_overrides where confirmed_subject <> 0)""")
def _(files, folder_overrides, scan_roots):
    return events.unconfirmed_subjects(files, events.resolve_folders(files, scan_roots), folder_overrides, scan_roots)


@query("a18_event_spans", f"""with {LADDER_SQL}, {FOLDERS}, g as (select r.event_folder, min(r.event_name) as event_name, min(l.dt::date) as start, max(l.dt::date) as last from ladder l join resolved r on r.folder = {PARENT.format('l.path')}
  where l.dt is not null and r.event_folder is not null and l.status <> 'error' and l.file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC', 'VIDEO') group by 1)
select event_folder, case when date_diff('day', start, last) + 1 > 30 then 'subject' else 'event' end as kind, start, last, date_diff('day', start, last) + 1 as span, {sanitize_sql('event_name')} as label from g where start <> last""")
def _(files, scan_roots):
    rows = organise.date_ladder(files.where("status <> 'error' and file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC', 'VIDEO')"), today())
    dated = rows.withColumn("folder", paths.parent(F.col("path"))).join(events.resolve_folders(files, scan_roots), "folder")
    return events.span_groups(dated.withColumn("day", F.col("dt").cast("date")))


@query("a20_event_bases", f"""with {FOLDERS} select r.event_folder, case when bool_or(coalesce(lower(f.camera_model) in (select lower(model) from known_cameras where owner = 'self'), false)) then 'Masters' else 'Others' end as base
from files f join resolved r on r.folder = {PARENT.format('f.path')} where r.event_folder is not null and f.status <> 'error' and f.file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC') group by 1""")
def _(files, scan_roots, known_cameras):
    return events.event_bases(files, events.resolve_folders(files, scan_roots), survivor.own_cameras(known_cameras))


@query("a24_existing_events", rf"""with m as (select distinct {PARENT.format('o.target_path')} as dir, {PARENT.format('o.source_path')} as source, string_split_regex(o.target_path, '[\\/]') as p from operations o join files f using (file_id) where o.op_type = 'MOVE' and o.status = 'done'),
b as (select dir, source, case when list_contains(p[:len(p) - 1], 'Masters') then 'Masters' when list_contains(p[:len(p) - 1], 'Others') then 'Others' end as base from m)
select dir, base, count(distinct source) as sources from b where base is not null and dir is not null group by 1, 2""")
def _(operations, files):
    there = operations.where("op_type = 'MOVE' and status = 'done'").select("file_id", F.col("target_path").alias("path"))
    moved = operations.join(files.select("file_id"), "file_id", "left_semi")
    return _lineage(moved, there)


def _lineage(moved, there):
    ev = events.existing_events(moved.select("op_id", "file_id", "op_type", "status", "source_path").distinct(), there.distinct())
    return ev.select("dir", "base", F.size("lineage").cast("long").alias("sources"))


@query("a36_organize_candidates", f"""with r as (select {PARENT.format('path')} as folder, file_type, date_confidence, path, case when date_confidence in ('HIGH', 'MEDIUM') then {exif_sql('datetime_original')}::date end as day from files where file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC', 'VIDEO') and status <> 'error')
select folder, count(*) as files, count(*) filter (where file_type <> 'VIDEO' and coalesce(date_confidence, 'LOW') = 'LOW') as low_dates, min(day) as first_day, max(day) as last_day, (list(path order by path))[:8] as samples from r where folder is not null group by 1""")
def _(files):
    return events.organize_candidates(files)


@query("j07_near_library_links", f"""with {HASHED}, k as (select file_id, status, ('0x' || phash)::ubigint as k from h where phash is not null),
n as (select k, file_id, min(file_id) over (partition by k) as f from k where status not in ('done', 'error') and file_id not in (select file_id from operations where status = 'done')),
o as (select k, file_id, min(file_id) over (partition by k) as f from k where status = 'done'),
near as (select n.k as nk, o.k as ok, n.f as new_id, o.f as library_id, bit_count(xor(n.k, o.k))::int as hamming_distance from (select distinct k, f from n) n join (select distinct k, f from o) o on bit_count(xor(n.k, o.k)) <= {RADIUS})
select new_id, library_id, hamming_distance, 'near' as kind from near
union all select file_id, f, 0, 'new' from n where file_id <> f and k in (select nk from near)
union all select f, file_id, 0, 'library' from o where file_id <> f and k in (select ok from near)""")
def _(files, operations):
    rows = hashed(files)
    return incremental.near_library_links(incremental.new_files(rows, operations), rows.where("status = 'done'"), RADIUS)


@query("j08_exact_new_vs_library", f"""with {HASHED}, new as (select file_id, sha256 from h where status not in ('done', 'error') and file_id not in (select file_id from operations where status = 'done'))
select n.file_id, min(o.file_id) as keeper from new n join h o on o.sha256 = n.sha256 and o.status = 'done' group by 1""")
def _(files, operations):
    rows = hashed(files)
    return incremental.exact_matches(incremental.new_files(rows, operations), rows.where("status = 'done'"))


@query("j17_interval_match", f"""with ev as (select source_folder as dir, date_override::date as lo, date_override::date + 20 as hi from folder_overrides where date_override is not null),
p as (select file_id, {exif_sql('datetime_original')}::date as day from files where file_type = 'HEIC')
select p.file_id, (array_agg(e.dir order by e.lo, e.dir))[1] as dir from p join ev e on p.day between e.lo and e.hi group by 1""")
def _(files, folder_overrides):
    from shelfmark.functions.dates import metadata_datetime

    lo = F.to_date("date_override")
    ev = folder_overrides.where("date_override is not null").select(F.col("source_folder").alias("dir"), F.lit("b").alias("base"), lo.alias("date_lo"), F.date_add(lo, 20).alias("date_hi"), F.array().cast("array<string>").alias("lineage"))
    rows = files.where("file_type = 'HEIC'").select("file_id", F.lit("").alias("source"), F.lit("b").alias("base"), metadata_datetime(F.col("datetime_original")).cast("date").alias("day"))
    return events.match_events(rows, ev)


@query("j17_photo_events", f"""with ev as (select source_folder as dir, date_override::date as lo, date_override::date + 20 as hi from folder_overrides where date_override is not null),
p as (select file_id, {PARENT.format('path')} as source, {exif_sql('datetime_original')}::date as day from files where file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC')),
linked as (select p.file_id, count(*) as n, (array_agg(e.dir order by e.lo, e.dir))[1] as one, (array_agg(e.dir order by e.lo, e.dir) filter (where p.day between e.lo and e.hi))[1] as held from p join ev e on e.dir = p.source group by 1)
select file_id, case when n = 1 then one else held end as dir from linked where n = 1 or held is not null
union all select p.file_id, (array_agg(e.dir order by e.lo, e.dir))[1] from p join ev e on p.day between e.lo and e.hi where p.file_id not in (select file_id from linked) group by 1""")
def _(files, folder_overrides):
    return photo_events(files, folder_overrides)


def photo_events(files, folder_overrides):
    """(file_id, dir): the event of every photo. A dated folder of the overrides is
    an event of 21 days, filled from that folder."""
    from shelfmark.functions.classify import PHOTO_TYPES
    from shelfmark.functions.dates import metadata_datetime

    lo = F.to_date("date_override")
    ev = folder_overrides.where("date_override is not null").select(F.col("source_folder").alias("dir"), F.lit("b").alias("base"), lo.alias("date_lo"), F.date_add(lo, 20).alias("date_hi"), F.array("source_folder").alias("lineage"))
    rows = files.where(F.col("file_type").isin(*PHOTO_TYPES)).select("file_id", paths.parent(F.col("path")).alias("source"), F.lit("b").alias("base"), metadata_datetime(F.col("datetime_original")).cast("date").alias("day"))
    return events.match_events(rows, ev)


@query("j18_relocated", f"""with {HASHED}, l0 as (select file_id, coalesce(filename, '') as n, sha256 from h where status = 'flagged' and sha256 is not null), r0 as (select path, coalesce(filename, '') as n, sha256 from h where status = 'pending' and sha256 is not null),
same as (select l.file_id, r.path from (select *, row_number() over (partition by sha256, n order by file_id) as k from l0) l join (select *, row_number() over (partition by sha256, n order by path) as k from r0) r using (sha256, n, k)),
rest as (select l.file_id, r.path from (select *, row_number() over (partition by sha256 order by file_id) as k from l0 where file_id not in (select file_id from same)) l join (select *, row_number() over (partition by sha256 order by path) as k from r0 where path not in (select path from same)) r using (sha256, k))
select * from same union all select * from rest""")
def _(files):
    rows = hashed(files)
    return ledger.relocate(rows.where("status = 'flagged'"), rows.where("status = 'pending'").select("path", "filename", "sha256"))[0]


@query("j22_clone_actions", """with s as (select filename as rel, max(size_bytes) as size, 0.0 as mtime from files where status = 'done' group by 1), d as (select filename as rel, max(size_bytes) as size, 1.0 as mtime from files where status <> 'done' group by 1)
select coalesce(s.rel, d.rel) as rel, case when s.rel is null then 'prune' when d.rel is not null and coalesce(s.size = d.size, false) then 'keep' else 'copy' end as action from s full join d on s.rel = d.rel""")
def _(files):
    side = lambda cond, m: files.where(cond).groupBy(F.col("filename").alias("rel")).agg(F.max("size_bytes").alias("size"), F.lit(m).alias("mtime"))
    return ledger.clone_actions(side("status = 'done'", 0.0), side("status <> 'done'", 1.0))


@query("j23_dangling_links", """with l as (select distinct dup_id, c, file_id from (select dup_id, unnest(['file_id_a', 'file_id_b', 'keep_file_id']) as c, unnest([file_id_a, file_id_b, keep_file_id]) as file_id from duplicates) where file_id is not null)
select dup_id, string_agg(c, ',' order by c) as missing from l where file_id not in (select file_id from files) group by 1""")
def _(duplicates, files):
    return ledger.dangling_duplicates(duplicates, files)


@query("s17_stale_rows", f"with {HASHED} select file_id from h where sha256 is not null and status <> 'error' and path not in (select source_path from operations where source_path is not null)")
def _(files, operations):
    return ledger.stale_rows(hashed(files), operations.select(F.col("source_path").alias("path"))).select("file_id")


@query("x23_pruned_links", "with gone as (select file_id from files where status = 'pending') select distinct dup_id from duplicates where file_id_a not in (select file_id from gone) and file_id_b not in (select file_id from gone)")
def _(files, operations, duplicates):
    return ledger.prune(files.where("status = 'pending'"), files, operations, duplicates)[2].select("dup_id").distinct()


@query("a27_target_collisions", "select target_path, count(distinct file_id) as files from operations where op_type = 'MOVE' and status = 'done' and target_path is not null group by 1 having count(distinct file_id) > 1")
def _(operations):
    return ledger.target_collisions(operations)


TWINS_EMPTY = r"""
placed as (select op_type, string_split_regex(target_path, '[\\/]+') as p from operations where status = 'done' and op_type in ('MOVE', 'STAGE_DELETE') and target_path is not null),
based as (select op_type, p, list_filter(range(1, len(p) - 1), lambda i: lower(p[i]) in ('masters', 'others'))[1] as spot from placed),
keyed as (select distinct op_type, lower(p[spot]) as base, p[spot + 2] as event from based where spot is not null),
empties as (select k.event, k.base as empty_base from keyed k where op_type <> 'MOVE' and exists (select 1 from keyed m where m.event = k.event and m.op_type = 'MOVE') and not exists (select 1 from keyed m where m.event = k.event and m.op_type = 'MOVE' and m.base = k.base))"""


@query("a28_empty_twins", f"with {TWINS_EMPTY} select event, empty_base from empties")
def _(operations):
    return ledger.empty_twins(operations)


_RESIDUE = r"""regexp_extract(list_filter(string_split_regex(target_path, '[\\/]+'), lambda x: regexp_matches(x, '^\d{4}-\d{2}-\d{2}(\(\d{1,2}d\))?\s+.'))[1], '^\d{4}-\d{2}-\d{2}(?:\(\d{1,2}d\))?\s+(.+)$', 1)"""
_RES = lambda st: rf"select count(*) from (select {_RESIDUE} as label from operations where op_type = 'MOVE' and status in ({st})) where regexp_matches(label, '\d{{8}}') or regexp_matches(label, '^\d{{1,2}}d(?:_|$)')"


@query("x21_audit", f"""with {TWINS_EMPTY}
select 'orphan_operations' as name, 'ERROR' as severity, count(*) as offenders from operations where file_id not in (select file_id from files)
union all select 'dangling_duplicates', 'ERROR', count(distinct dup_id) from duplicates where file_id_a not in (select file_id from files) or file_id_b not in (select file_id from files) or (keep_file_id is not null and keep_file_id not in (select file_id from files))
union all select 'self_referential_duplicate', 'ERROR', count(*) from duplicates where file_id_a = file_id_b
union all select 'target_path_collision', 'ERROR', count(*) from (select 1 from operations where op_type = 'MOVE' and status = 'done' and target_path is not null group by target_path having count(distinct file_id) > 1)
union all select 'event_name_residue_done', 'ERROR', ({_RES("'done'")})
union all select 'event_name_residue_pending', 'WARN', ({_RES("'planned', 'confirmed'")})
union all select 'cross_base_empty_twin', 'WARN', (select count(*) from empties)
union all select 'low_confidence_dates', 'WARN', count(*) from files where file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC', 'VIDEO') and coalesce(date_confidence, 'LOW') = 'LOW'""")
def _(files, operations, duplicates):
    return ledger.audit(files, operations, duplicates)


STATES = rf"""
ops as (select file_id, bool_or(status = 'error') as failed, bool_or(status = 'done' and op_type = 'DELETE') as deleted, bool_or(status = 'done' and op_type = 'MOVE') as moved, bool_or(status = 'done' and op_type = 'STAGE_DELETE') as staged, bool_or(status in ('planned', 'confirmed', 'pending', 'skipped', 'in_progress')) as waiting, count(*) as n from operations group by 1),
states as (
  select f.file_id, case when f.status = 'error' or o.failed then 'ERROR' when o.deleted then 'DELETED'
    when o.moved and regexp_matches({STEM.format(NAME.format('f.path'))}, '_conflict_\d+$') then 'CONFLICT' when o.moved then 'MOVED' when o.staged then 'STAGED' when o.waiting then 'SKIPPED'
    when o.n is null and f.file_type = 'UNKNOWN' then 'UNTOUCHED' else 'UNACCOUNTED' end as state
  from files f left join ops o using (file_id)
)"""


@query("j21_file_states", f"with {STATES} select file_id, state from states")
def _(files, operations):
    return ledger.reconcile_states(files, operations)


@query("a30_balance_sheet", f"with {STATES}, every(state) as (values ('MOVED'), ('STAGED'), ('CONFLICT'), ('DELETED'), ('SKIPPED'), ('ERROR'), ('UNTOUCHED'), ('UNACCOUNTED')) select e.state, coalesce(n, 0) as files from every e left join (select state, count(*) as n from states group by 1) s using (state)")
def _(files, operations):
    return ledger.balance_sheet(ledger.reconcile_states(files, operations))


@query("x20_missing_on_disk", f"with {STATES} select f.file_id, f.path from files f join states s using (file_id) where s.state in ('MOVED', 'STAGED', 'CONFLICT') and f.path not in (select source_path from operations where status = 'done')")
def _(files, operations):
    return ledger.missing_on_disk(files, ledger.reconcile_states(files, operations), operations.where("status = 'done'").select(F.col("source_path").alias("path")))


@query("o02_undo_order", "select op_id, row_number() over (order by executed_at desc nulls last, op_id desc) as place from (select distinct op_id, executed_at, status, file_id from operations) o where status = 'done' and exists (select 1 from files f where f.file_id = o.file_id)")
def _(operations, files):
    ops = operations.where("status = 'done'").dropDuplicates(["op_id", "executed_at", "status", "file_id"])
    rows = ledger.undo_list(ops, files)
    # places are counted in ranges of the sorted rows, so no single task holds them all
    days = rows.withColumn("d", F.coalesce(F.substring("executed_at", 1, 10), F.lit("")))
    sizes = days.groupBy("d").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("executed_at"), F.desc("op_id")))
    return days.join(sizes.select("d", "before"), "d").select("op_id", (F.col("before") + inside).alias("place"))


@query("w03_sequence_numbers", f"select file_id, row_number() over (partition by {PARENT.format('path')} order by file_id) - 1 as seq from files where file_type = 'VIDEO'")
def _(files):
    videos = files.where("file_type = 'VIDEO'").select("file_id", F.coalesce(paths.parent(F.col("path")), F.lit("")).alias("folder"))
    return number_rows(videos, "n", "file_id", group="folder").select("file_id", (F.col("n") - 1).alias("seq"))


@query("w08_conflict_numbers", r"""with p as (select distinct file_id, target_path as raw from operations where target_path is not null and op_type = 'MOVE' and status <> 'done'),
t as (select distinct target_path as raw, 1 as taken from operations where status = 'done' and target_path is not null),
n as (select p.*, row_number() over (partition by raw order by file_id) - 1 + coalesce(taken, 0) as k from p left join t using (raw)),
held as (select distinct raw from (select raw from t union all select raw from p)),
split as (select regexp_replace(raw, '([^./\\])(\.[^./\\]*)?$', '\1') as name, regexp_extract(raw, '[^./\\](\.[^./\\]*)?$', 1) as tail from held),
used as (select regexp_replace(name, '_conflict_[0-9]+$', '') || tail as raw, list_sort(list(distinct regexp_extract(name, '_conflict_([1-9][0-9]{0,17})$', 1)::bigint)) as us from split where regexp_matches(name, '_conflict_[1-9][0-9]{0,17}$') group by 1),
m as (select n.*, k + coalesce(len(list_filter(range(1, len(us) + 1), lambda i: us[i] - i < k)), 0) as c from n left join used using (raw))
select file_id, case when k > 0 then regexp_replace(raw, '([^./\\])(\.[^./\\]*)?$', '\1') || '_conflict_' || c || regexp_extract(raw, '[^./\\](\.[^./\\]*)?$', 1) else raw end as target_path from m""")
def _(operations):
    rows = operations.where("target_path is not null and op_type = 'MOVE' and status <> 'done'").select("file_id", "target_path").distinct()
    return organise.number_conflicts(rows, operations.where("status = 'done' and target_path is not null")).select("file_id", "target_path")


@query("u_file_set_operations", """select 'union' as op, count(*) as n from (select file_id_a from duplicates union select file_id from operations)
union all select 'except', count(*) from (select file_id from operations except select file_id_a from duplicates)
union all select 'intersect', count(*) from (select file_id from operations intersect select file_id_a from duplicates)""")
def _(duplicates, operations):
    a, b = duplicates.select(F.col("file_id_a").alias("file_id")), operations.select("file_id")
    tally = lambda n, df: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n")
    return tally("union", a.union(b).distinct()).union(tally("except", b.subtract(a))).union(tally("intersect", b.intersect(a)))


@query("t_event_sessions", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval 1 hour as "end", count(*) as n from s group by user_id, k""")
def _(events):
    return ingest.sessions(events, "ts", "user_id", "1 hour")


def x12_plan(spark, sf_dir):
    """The plan with the folder overlaps of the library reviewed as they are suggested."""
    t = {n: table(spark, sf_dir, n) for n in ("files", "duplicates", "folder_overrides", "known_cameras", "scan_roots")}
    return organise.plan(hashed(t["files"]), t["duplicates"], t["folder_overrides"], t["known_cameras"], t["scan_roots"], today(), overlaps=_reviewed(t["files"], t["scan_roots"]))


STAGE_SQL = f"""
{MEMBERS}, {_twins_sql(0.02, 1)}, {_ROLLUP}, {MERGE},
exact_links as (select file_id_a as a, file_id_b as b from duplicates where dup_type = 'EXACT'), {components_sql('exact_links', 'exact_comp')},
exact_best as (select c.group_id, r.file_id, first_value(r.file_id) over (partition by c.group_id order by {ORDER}) as keeper from exact_comp c join ranked r using (file_id)),
reasons as (
  select file_id, 'resized_jpeg' as reason, null::bigint as dupe_of, 0 as p, true as safe from h where file_type = 'RESIZED_JPEG'
  union all select file_id, 'exact_dupe', keeper, 1, false from exact_best where file_id <> keeper
  union all select file_id, 'near_dupe', keeper, 2, false from near_losers
  union all select file_id, 'redundant_copy', keeper, 3, true from redundant
  union all select file_id, 'folder_merge_loser', keeper, 4, false from merge_losers
),
chosen as (select file_id, arg_max(reason, p) as stage_reason, (array_agg(dupe_of order by p desc))[1] as dupe_of_file_id, bool_or(safe) as safe from reasons group by 1),
bytes as (select r.*, c.file_id is not null as staged from ranked r left join chosen c using (file_id) where r.sha256 is not null and not coalesce(c.safe, false)),
rescue as (select (array_agg(file_id order by {ORDER}))[1] as file_id from bytes group by sha256 having bool_and(staged)),
staged as (select file_id, stage_reason, dupe_of_file_id from chosen where file_id not in (select file_id from rescue))"""


@query("x13_staged_files", f"with recursive {HASHED}, {RANKED}, {REDUNDANT}, {NEAR_LOSERS}, {STAGE_SQL} select file_id, stage_reason, dupe_of_file_id from staged")
def _(files, duplicates, known_cameras, scan_roots):
    ranked = ranking(hashed(files), known_cameras)
    return organise.stage(ranked, organise.staging_reasons(ranked, duplicates, ranked, _reviewed(files, scan_roots)), ranked)


QUERIES["x12_plan"] = x12_plan


def _plan_sql() -> str:
    files_of_plan = "('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC', 'VIDEO')"
    return f"""with recursive {HASHED}, {RANKED}, {REDUNDANT}, {NEAR_LOSERS}, {STAGE_SQL}, {LADDER_SQL}, {FOLDERS},
hint_days as (select {PARENT.format('path')} as folder, x::date as day, count(*) as n from ladder where file_type <> 'VIDEO' and status <> 'error' and confidence in ('HIGH', 'MEDIUM') and x is not null group by 1, 2),
hints as (select folder, day as hint from (select *, row_number() over (partition by folder order by n desc, day) as r from hint_days) where r = 1),
eff as (
  select l.*, {PARENT.format('l.path')} as folder, coalesce({sanitize_sql('o.event_name')}, '') as ov_event,
    case when coalesce(l.confidence, 'LOW') = 'LOW' and try_cast(o.date_override as date) is not null then try_cast(o.date_override as timestamp)
      when coalesce(l.confidence, 'LOW') = 'LOW' and l.file_type = 'VIDEO' and hint is not null then hint::timestamp else dt end as eff
  from ladder l left join folder_overrides o on o.source_folder = {PARENT.format('l.path')} left join hints h on h.folder = {PARENT.format('l.path')}
),
spans as (select r.event_folder, min(r.event_name) as event_name, min(e.eff::date) as start, max(e.eff::date) as last from eff e join resolved r using (folder)
  where e.status <> 'error' and e.file_type in {files_of_plan} and e.eff is not null and r.event_folder is not null and e.file_id not in (select file_id from staged) group by 1 having min(e.eff::date) <> max(e.eff::date)),
grp as (select *, date_diff('day', start, last) + 1 as span, {sanitize_sql('event_name')} as label from spans),
own as (select distinct lower(model) as m from known_cameras where owner = 'self' and model <> ''),
bases as (select r.event_folder, case when bool_or(coalesce(lower(f.camera_model) in (select m from own), false)) then 'Masters' else 'Others' end as base from files f join resolved r on r.folder = {PARENT.format('f.path')}
  where r.event_folder is not null and f.status <> 'error' and f.file_type in ('RAW', 'CAMERA_JPEG', 'DEV_JPEG', 'HEIC') group by 1),
mv as (
  select e.*, f.extension, r.event_folder, g.span, g.start, g.label, case when g.span > 30 then 'subject' when g.span is not null then 'event' end as kind,
    coalesce(nullif(e.ov_event, ''), {sanitize_sql('r.event_name')}) as event, coalesce(p.per_day_split, 0) <> 0 as per_day,
    case when e.file_type = 'VIDEO' and r.event_folder is not null then coalesce(b.base, 'Others') when lower(e.camera_model) in (select m from own) then 'Masters' else 'Others' end as base
  from eff e join files f using (file_id) left join resolved r using (folder) left join grp g on g.event_folder = r.event_folder left join bases b on b.event_folder = r.event_folder left join folder_overrides p on p.source_folder = r.event_folder
  where e.status not in ('error', 'done') and e.file_type <> 'UNKNOWN' and e.file_id not in (select file_id from staged)
),
sub as (
  select *, case when eff is null then case when file_type = 'VIDEO' then 'Videos/NoDate' else 'NoDate' end else
    case when kind = 'subject' then base || '/' || coalesce(nullif(ov_event, ''), nullif(label, ''), event) || '/' || strftime(eff, '%Y')
      when kind = 'event' then base || '/' || strftime(start, '%Y') || '/' || strftime(start, '%Y-%m-%d') || '(' || span || 'd)' || case when event <> '' then ' ' || event else '' end || case when per_day then '/' || strftime(eff, '%m%d') else '' end
      else base || '/' || strftime(eff, '%Y') || '/' || strftime(eff, '%Y-%m-%d') || case when event <> '' then ' ' || event else '' end end || case when file_type = 'VIDEO' then '/Videos' else '' end end as sub
  from mv
),
named as (
  select *, case when file_type = 'VIDEO' then format('{{}}_{{:04d}}.{{}}', coalesce(strftime(eff, '%Y-%m-%d'), 'video'), row_number() over (partition by file_type = 'VIDEO', sub, coalesce(strftime(eff, '%Y-%m-%d'), 'video') order by file_id) - 1, upper(coalesce(nullif(extension, ''), 'jpg'))) else filename end as name from sub
)
select file_id, 'MOVE' as op_type, path as source_path, 'Library/' || sub || '/' || name as target_path, null::varchar as stage_reason, null::bigint as dupe_of_file_id from named
union all select f.file_id, 'STAGE_DELETE', f.path, 'Library/_staging/to_delete/' || case s.stage_reason when 'folder_merge_loser' then 'folder_merge' else s.stage_reason end || '/' || f.file_id || '_' || f.filename, s.stage_reason, s.dupe_of_file_id
from staged s join files f using (file_id) where f.status not in ('error', 'done')"""


SQL["x12_plan"] = _plan_sql()


def x12_plan_summary(spark, sf_dir):
    return organise.plan_summary(x12_plan(spark, sf_dir), table(spark, sf_dir, "files"))


QUERIES["a33_plan_summary"] = x12_plan_summary
SQL["a33_plan_summary"] = f"with plan as ({SQL['x12_plan']}) select count(*) filter (where op_type = 'MOVE') as moves, count(*) filter (where op_type <> 'MOVE') as staged, count(*) filter (where stage_reason = 'resized_jpeg') as resized, coalesce(sum(f.size_bytes) filter (where op_type <> 'MOVE'), 0)::bigint as staged_bytes from plan join files f using (file_id)"


@query("x17_plan_additions")
def _(files, operations, folder_overrides, known_cameras, scan_roots):
    return incremental.plan_additions(hashed(files), operations.dropDuplicates(["op_id"]), folder_overrides, known_cameras, scan_roots, today())


@query("g_components_all_links", f"with recursive links as (select file_id_a as a, file_id_b as b from duplicates), {components_sql('links', 'comp', 'node', 'component')} select node, component from comp")
def _(duplicates):
    return graph.connected_components(duplicates, "file_id_a", "file_id_b")
