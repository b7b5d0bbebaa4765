"""Training-data operators against brute force, exact round trips and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.hashes import valid_hex
from shelfmark.llm import cells, components, fusion, garble, mixing, neighbours, tokens
from shelfmark import runtime
from shelfmark.runtime import table

DUPES = "dup_id long, file_id_a long, file_id_b long, dup_type string, hamming_distance int, keep_file_id long, status string, resolved_at string, u long, c string, group_id long"
FILES = "file_id long, path string, status string, sha256 string, phash string, scanned_at string, width int, height int, size_bytes long, camera_make string, camera_model string, file_type string, datetime_original string, gps_lat double, gps_lon double, iso int, software string, key long, batch string, group_id long"


def dupe(i, a, b, kind="EXACT", h=0, keep=None, status="pending", at=None):
    return (i, a, b, kind, h, keep, status, at, 1, "x", 5)


def file_row(i, **k):
    base = dict(file_id=i, path=f"/r/{i}.jpg", status="hashed", sha256=None, phash=None, scanned_at=None, width=None, height=None, size_bytes=None, camera_make=None, camera_model=None, file_type=None, datetime_original=None, gps_lat=None, gps_lon=None, iso=None, software=None, key=9, batch="b", group_id=1)
    return tuple((base | k).values())


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


# groups


@pytest.mark.parametrize("hot", [100_000, 20])
def test_groups_of_chains_stars_and_random_links(spark, monkeypatch, hot):
    monkeypatch.setattr(runtime, "HOT_ROWS", hot)  # the star is a hot vertex, and its group a hot centre
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 300)] + [(5000, x) for x in range(5001, 5200)] + [(rng.randrange(7000, 7400), rng.randrange(7000, 7400)) for _ in range(260)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges if a != b]
    rows = [dupe(i, a, b) for i, (a, b) in enumerate(edges + edges[:40])] + [dupe(1, 3, 3), dupe(2, None, 4), dupe(3, 4, None)]
    got = components.connected_groups(spark.createDataFrame(rows, DUPES)).collect()
    assert {r.file_id: r.group_id for r in got} == union_find(edges) and len(got) == len(union_find(edges))


def test_groups_edges(spark):
    assert components.connected_groups(spark.createDataFrame([], DUPES)).count() == 0
    rows = [dupe(1, 1, 2, None, None), dupe(2, 3, 4, "NEAR", 3), dupe(3, 5, 6, "NEAR", None), dupe(4, 7, 7), dupe(5, -1, 2**62, "EXACT", 60), dupe(6, None, None, None, None)]
    got = {r.file_id: r.group_id for r in components.connected_groups(components.counted_links(spark.createDataFrame(rows, DUPES))).collect()}
    assert got == {1: 1, 2: 1, 5: 5, 6: 5, -1: -1, 2**62: -1}


# fusion

CAMERAS, ROOTS = "camera_id long, make string, model string, owner string", "root_id int, path_prefix string, time_zone string"


def golden(spark, files, dupes, cameras=(), roots=((1, "/r/", "UTC"), (2, "/s/", "UTC"))):
    out = fusion.golden_records(spark.createDataFrame(files, FILES), spark.createDataFrame(dupes, DUPES), spark.createDataFrame(list(cameras), CAMERAS), spark.createDataFrame(list(roots), ROOTS))
    return {r.group_id: r for r in out.collect()}


def test_survivors(spark):
    files = [file_row(1, width=10, height=10), file_row(2, width=20, height=20), file_row(3, width=-5, height=20), file_row(4, size_bytes=9), file_row(5, path="/r/long/5.jpg", camera_model=" x2 "), file_row(6), file_row(7), file_row(8), file_row(9, path=None)]
    dupes = [
        dupe(1, 1, 2), dupe(2, 3, 4), dupe(3, 5, 6), dupe(4, 7, 8, keep=8, status="resolved"), dupe(5, 7, 8, keep=7, status="reviewed", at="2024-01-01T00:00:00+00:00"),
        dupe(6, 7, 8, keep=1, status="reviewed", at="2025-01-01T00:00:00+00:00"), dupe(7, 7, 8, "NEAR", 5, 8, "resolved", "2026-01-01T00:00:00+00:00"), dupe(8, 9, 77),
    ]
    got = golden(spark, files, dupes, [(1, None, "X2", "self"), (2, None, None, "self"), (3, None, "y", None)])
    assert {g: r.keep_file_id for g, r in got.items()} == {1: 2, 3: 4, 5: 5, 7: 7, 9: 9}
    assert got[7].decided and not got[1].decided


def test_missing_fields_are_fused_and_copies_discounted(spark):
    assert golden(spark, [], []) == {}
    # three sources; b and c copy each other, mistakes included, a and d are right
    files, dupes = [], []
    for g in range(60):
        ids = [g * 10 + i for i in range(5)]
        wrong = g % 3 == 0
        for i, (fid, src) in enumerate(zip(ids, ("K", "A", "B", "C", "D"))):
            model = (None if g % 2 else "odd" if wrong else "Good") if src == "K" else "bad" if wrong and src in "BC" else "Good"
            files.append(file_row(fid, path="/r/x.jpg", file_type=src, camera_model=model, width=100 if src == "K" else 1, height=100))
            if i:
                dupes.append(dupe(fid, ids[0], fid))
    got = golden(spark, files, dupes)
    assert all(r.camera_model == "Good" for r in got.values()) and len(got) == 60
    # the survivor's own value is one vote: it is filled where it is missing, and replaced where the posterior is against it
    assert all(("camera_model" in r.filled) == bool(g // 10 % 2) and ("camera_model" in r.replaced) == (g // 10 % 6 == 0) for g, r in got.items())
    assert got[0].own["camera_model"] == "odd" and 0.4 < got[0].posterior["camera_model"] < 0.6


def plain_fusion(items):
    """The estimation in plain Python: items are lists of (source, value)."""
    names = sorted({s for item in items for s, _ in item})
    acc, dep = dict.fromkeys(names, 0.8), {}

    def post(item):
        votes = {}
        for v in dict.fromkeys(v for _, v in sorted(item)):
            backers = sorted((s for s, x in item if x == v), key=lambda s: (-acc[s], names.index(s)))
            votes[v] = sum(math.log(10 * acc[s] / (1 - acc[s])) * math.prod(1 - 0.8 * dep.get(frozenset((s, t)), 0.0) for t in backers[:i]) for i, s in enumerate(backers))
        whole = sum(map(math.exp, votes.values())) + max(0, 11 - len(votes))
        return {v: math.exp(x) / whole for v, x in votes.items()}

    for _ in range(4):
        right, seen, pair = Counter(), Counter(), defaultdict(lambda: [0.0, 0.0, 0.0])
        for item in items:
            p = post(item)
            for s, v in item:
                right[s] += p[v]
                seen[s] += 1
                for t, w in item:
                    if s < t:
                        x = pair[frozenset((s, t))]
                        if v == w:
                            x[0] += p[v]
                            x[1] += 1 - p[v]
                        else:
                            x[2] += 1
        acc = {s: min(0.99, max(0.05, (right[s] + 0.8) / (seen[s] + 1))) for s in names}
        dep = {}
        for key, (st, sf, d) in pair.items():
            a, b = (acc[s] for s in key)
            pt, pf, mean = a * b, (1 - a) * (1 - b) / 10, (a + b) / 2
            pd = max(1e-9, 1 - pt - pf)
            log = st * math.log((mean * 0.8 + pt * 0.2) / pt) + sf * math.log(((1 - mean) * 0.8 + pf * 0.2) / pf) + d * math.log(0.2) + math.log(0.25)
            dep[key] = 1 / (1 + math.exp(-max(-50, min(50, log))))
    return acc, dep, [max(post(item).items(), key=lambda x: x[1]) for item in items]


@pytest.mark.parametrize("hot", [100_000, 30])
def test_copied_votes_lose(spark, monkeypatch, hot):
    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    # A, D, F and G err alone; B errs often, and C and E copy all of B
    rows = []
    for g in range(80):
        wrong = f"bad{g}" if g % 4 == 0 else "good"
        for s, slip in (("A", 1), ("D", 2), ("F", 3), ("G", 5)):
            rows.append((g, s, f"{s}{g}" if g % 20 == slip else "good"))
        rows += [(g, s, wrong) for s in "BCE"]
    for g in range(100, 110):
        rows += [(g, s, "good") for s in "AD"] + [(g, s, "bad") for s in "BCE"]
    fused, accuracy, copying = fusion.fuse_fields(spark.createDataFrame(rows, "g long, s string, f string"), "g", "s", ["f"])
    acc = {r.source: r.accuracy for r in accuracy.collect()}
    dep = {frozenset((r.source_a, r.source_b)): r.copying for r in copying.collect()}
    assert min(dep[frozenset("BC")], dep[frozenset("CE")]) > 0.9 and dep[frozenset("AD")] < 0.5
    assert acc["A"] > acc["B"]
    got = {r.g: r for r in fused.collect()}
    assert {r.value for r in got.values()} == {"good"}
    groups = sorted(got)
    want_acc, want_dep, want = plain_fusion([sorted((s, v) for g, s, v in rows if g == i) for i in groups])
    assert acc == pytest.approx(want_acc) and dep == pytest.approx(want_dep)
    assert all(got[g].value == v and abs(got[g].posterior - p) < 1e-6 for g, (v, p) in zip(groups, want))


def test_fusion_edges(spark):
    members = spark.createDataFrame([(1, None, " X "), (1, None, "x"), (1, "b", ""), (2, "b", None), (3, "c", "y" * 100_000)], "g long, s string, f string")
    got = {(r.g, r.field): (r.value, r.posterior > 0.5) for r in fusion.fuse_fields(members, "g", "s", ["f"])[0].collect()}
    assert got == {(1, "f"): ("X", True), (3, "f"): ("y" * 100_000, True)}
    # every source has an accuracy of its own, however many there are
    many = spark.createDataFrame([(g, f"s{i}", "v" if i % 4 else f"w{i}-{g}") for i in range(200) for g in range(3)], "g long, s string, f string")
    fused, accuracy, _ = fusion.fuse_fields(many, "g", "s", ["f"])
    acc = {r.source: r.accuracy for r in accuracy.collect()}
    assert {r.value for r in fused.collect()} == {"v"} and len(acc) == 200 and acc["s1"] > 0.9 > 0.5 > acc["s4"]


# matching of batches


def brute_matches(rows, radius=6):
    cp, cs = (Counter(r[c] for r in rows if r[c]) for c in ("p", "s"))
    ok = [(r["file_id"], r["status"] or "", r["p"] if r["p"] and cp[r["p"]] < 8 else None, r["s"] if r["s"] and cs[r["s"]] < 8 else None) for r in rows]
    old, new = [r for r in ok if r[1] == "done"], [r for r in ok if r[1] not in ("done", "error")]
    return {tuple(sorted((a[0], b[0]))) for a in old for b in new if a[3] and a[3] == b[3] or a[2] and b[2] and (int(a[2], 16) ^ int(b[2], 16)).bit_count() <= radius}


@pytest.mark.parametrize("hot,bound", [(4096, 100_000), (3, 100_000), (4096, 0), (3, 0)])
def test_new_files_match_brute_force(spark, monkeypatch, hot, bound):
    monkeypatch.setattr(cells, "HOT_CELL", hot)
    monkeypatch.setattr(cells, "BROADCAST_ROWS", bound)
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    rows = []
    for i in range(400):
        k = rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64 if i % 2 else 16), rng.randrange(0, 9)))
        phash = rng.choice([f"{k:016x}", f"  {k:016X} ", None, "none", ""]) if i % 5 else f"{k:016x}"
        rows.append(file_row(i, status=rng.choice(["done", "hashed", "error", None, "done"]), phash=phash, sha256=rng.choice([None, f"{rng.randrange(60):064x}"]), scanned_at=rng.choice([None, "2020-01-01", "2021-05-05", ""])))
    rows += [file_row(1000 + i, status="done" if i % 2 else "hashed", phash="00000000000000ff", sha256="e" * 64) for i in range(9)]
    files = spark.createDataFrame(rows, FILES)
    seen = files.select("file_id", "status", valid_hex(F.col("phash"), 16).alias("p"), valid_hex(F.col("sha256"), 64).alias("s")).collect()
    got = [tuple(r) for r in cells.match_new_files(files).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_matches(seen)


def test_appended_batches_equal_one(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.getrandbits(64) - 2**63, rng.choice([None, str(i % 7)])) for i in range(120)]
    rows += [(200 + i, k ^ 5, v) for i, (_, k, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, key long, value string")
    one, more = cells.CellIndex(spark, str(tmp_path / "a")), cells.CellIndex(spark, str(tmp_path / "b"))
    one.append(df.where("id < 200"), "0")
    for b in range(3):
        for _ in range(2):  # a repeated append changes nothing
            more.append(df.where(f"id < 200 and id % 3 = {b}"), str(b))
    new = df.where("id >= 200")
    want = {tuple(r) for r in one.match(new).collect()}
    assert {tuple(r) for r in more.match(new).collect()} == want and len(want) >= 120


def scanned(spark, df):
    """Rows that the scans of an executed plan gave out."""
    df.collect()
    total = 0

    def visit(node):
        nonlocal total
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in name:
            return visit(node.plan())
        if "Scan" in name:
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return total


def test_small_batches_read_their_cells_only(spark, tmp_path):
    read = []
    for n in (4_000, 64_000):
        index = cells.CellIndex(spark, str(tmp_path / str(n)))
        index.append(spark.range(n).select("id", F.xxhash64("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value")), "0")
        batch = spark.createDataFrame([(10**9 + i, i) for i in range(2)], "id long, k long").select("id", F.xxhash64("k").bitwiseXOR(F.lit(3)).alias("key"), F.sha2(F.col("k").cast("string"), 256).alias("value"))
        df = index.match(batch)
        read.append(scanned(spark, df))
        assert {tuple(r) for r in df.collect()} == {(10**9 + i, i) for i in range(2)}
        read.append(scanned(spark, index.near_keys(batch)))
    assert read[2] <= 2 * read[0] + 2000 and read[3] < 4 * 64_000 / 3, read


def test_probes_of_a_large_batch_are_not_broadcast(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cells, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(cells, "HOT_CELL", 2)
    rng = random.Random(23)
    old = [(i, rng.getrandbits(62), None) for i in range(60)]
    new = [(1000 + i, key ^ 1 << rng.randrange(62), None) for i, key, _ in old]
    old += [(2000 + i, 7 | i << 20, None) for i in range(40)]  # hot cells
    index = cells.CellIndex(spark, str(tmp_path / "x"))
    index.append(spark.createDataFrame(old, "id long, key long, value string"), "0")
    near = index.near_keys(spark.createDataFrame(new, "id long, key long, value string"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    # the planner takes the probes to be as small as their keys
    assert not re.search(r"BroadcastHashJoin \[[^\]]*\], \[[^\]]*\], Inner", plan) and "SortMergeJoin" in plan
    assert {tuple(r)[:2] for r in near.collect()} == {(a, b) for _, a, _ in new for _, b, _ in old if (a ^ b).bit_count() <= 6}


@pytest.mark.parametrize("hot,bound", [(4096, 100_000), (3, 0)])
def test_nearest_matches_brute_force(spark, monkeypatch, hot, bound):
    monkeypatch.setattr(cells, "HOT_CELL", hot)
    monkeypatch.setattr(cells, "BROADCAST_ROWS", bound)
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(20)]
    keys = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))) for _ in range(300)]
    rows = [file_row(i, status=("done", "hashed", "error")[i % 3], phash=f"{k:016x}" if i % 11 else None) for i, k in enumerate(keys)]
    old = [(k, i) for i, k in enumerate(keys) if i % 3 == 0 and i % 11]
    want = {i: min(((k ^ o).bit_count(), j) for o, j in old) for i, k in enumerate(keys) if i % 3 == 1 and i % 11}
    got = {r.file_id: (r.distance, r.nearest_id) for r in cells.nearest_accepted(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {i: x for i, x in want.items() if x[0] <= 6}


def test_an_index_is_gone_on_with(spark, tmp_path):
    path = str(tmp_path / "index")
    first = [file_row(1, status="done", phash="0" * 16, scanned_at="2020-01-01"), file_row(2, phash="0" * 15 + "1", scanned_at="2021-01-01")]
    assert [tuple(r) for r in cells.match_new_files(spark.createDataFrame(first, FILES), path=path).collect()] == [(1, 2)]
    index = cells.CellIndex(spark, path)  # another session finds accepted and pending records
    new = spark.createDataFrame([(3, 3, None)], "id long, key long, value string")
    assert [tuple(r) for r in index.match(new).collect()] == [(3, 1)] and [tuple(r) for r in index.match(new, "pending").collect()] == [(3, 2)]


def test_matching_edges(spark):
    empty = spark.createDataFrame([], FILES)
    assert cells.match_new_files(empty).count() == 0
    assert cells.match_new_files(spark.createDataFrame([file_row(1, phash="0" * 16)], FILES)).count() == 0
    assert cells.match_new_files(spark.createDataFrame([file_row(1, status="done", phash="0" * 16)], FILES)).count() == 0
    assert sum(r + 1 for r in cells.reaches(6)) == 7 and cells.reaches(3) == [0, 0, 0, 0] and cells.reaches(1) == [0, 0, -1, -1]


# neighbours


def brute_neighbours(keys, k=3, radius=6):
    out = set()
    for a in keys:
        near = sorted(((a ^ b).bit_count(), b) for b in keys if b != a)
        out |= {tuple(sorted((f"{a:016x}", f"{b:016x}"))) for d, b in near[:k] if d <= radius}
    return out


@pytest.mark.parametrize("part", [4096, 40])
def test_neighbours_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(neighbours, "PART", part)
    rng = random.Random(part)
    base = [rng.getrandbits(64) for _ in range(700)]
    keys = {k ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for k in base for _ in range(3)} | {2**63 ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(150)}
    rows = [file_row(i, phash=f"{k:016x}") for i, k in enumerate(keys)] + [file_row(9999, phash=f" {next(iter(keys)):016X}"), file_row(9998, phash="none"), file_row(9997)]
    got = {tuple(r) for r in neighbours.similar_hashes(spark.createDataFrame(rows, FILES)).collect()}
    want = brute_neighbours(sorted(keys))
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_long_lists_are_divided_and_keep_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_CENTROIDS", 4)  # lists of a thousand vectors, as if there were 400 times as many
    monkeypatch.setattr(neighbours, "PART", 200)
    rng = random.Random(8)
    keys = {k ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for k in (rng.getrandbits(64) for _ in range(900)) for _ in range(3)}
    sizes = []
    divide = neighbours._divide
    monkeypatch.setattr(neighbours, "_divide", lambda lists, long: (sizes.append(len(long)), divide(lists, long))[1])
    rows = [file_row(i, phash=f"{k:016x}") for i, k in enumerate(keys)]
    got = {tuple(r) for r in neighbours.similar_hashes(spark.createDataFrame(rows, FILES)).collect()}
    want = brute_neighbours(sorted(keys))
    assert sizes and len(got & want) >= 0.95 * len(want), (sizes, len(got & want), len(want))


def test_recall_on_the_table(spark):
    files = table(spark, "/root/testdata/sf0.01", "files")
    got = {tuple(r) for r in neighbours.similar_hashes(files).collect()}
    keys = sorted({int(r.t, 16) for r in files.select(valid_hex(F.col("phash"), 16).alias("t")).where("t is not null").collect()})
    arr = np.array(keys, np.uint64)
    want = set()
    for a in arr:
        d = np.bitwise_count(arr ^ a)
        near = [(int(d[i]), int(arr[i])) for i in np.flatnonzero(d <= 6) if arr[i] != a]
        want |= {tuple(sorted((f"{int(a):016x}", f"{b:016x}"))) for _, b in sorted(near)[:3]}
    assert len(got & want) >= 0.99 * len(want)


def test_neighbours_edges(spark):
    keys = lambda *k: spark.createDataFrame([(x, "key") for x in k], "key long, other string")
    assert neighbours.nearest_keys(keys()).count() == 0 and neighbours.nearest_keys(keys(1, 1, None)).count() == 0
    got = sorted(tuple(r) for r in neighbours.nearest_keys(keys(0, 1, 2, 4, 8, -1)).collect() if r.key == 0)
    assert got == [(0, 1, 1), (0, 2, 1), (0, 4, 1)]


# tokens


def test_tokens_equal_a_public_library(spark):
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = tokens.read_ranks(f.read())
    public = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    odd = ["", None, " ", "<|endoftext|>", "a" * 5000, "漢字" * 2000, "naïve café\r\n\t  x", "﻿x", "🙂👍🏽" * 50, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000)), "0" * 300]
    d = spark.createDataFrame([(i, t, [1], "z") for i, t in enumerate(odd)], "doc_id long, text string, ids array<int>, tokens string")
    for df in (d, table(spark, "/root/testdata/sf0.01", "documents")):
        want = {r.doc_id: public.encode_ordinary(r.text) if r.text else [] for r in df.select("doc_id", "text").collect()}
        assert {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()} == want
        assert {r.doc_id: r.tokens for r in tokens.count_tokens(df.select("doc_id", "text"), ["doc_id"]).collect()} == {k: len(v) for k, v in want.items()}
    assert tokens.encode_texts(d.where("false")).count() == 0
    for _ in range(2000):
        w = bytes(rng.choice(b"abcdet hin\xc3\xa9") for _ in range(rng.randint(1, 80)))
        assert tokens.merge_scan(w, ranks) == tokens.merge_heap(w, ranks)


# mixing


def plain_mix(docs, goals, budget):
    """docs: (place, doc_id, source, tokens); a queue for each source, least finish time first."""
    line = []
    for s, (w, cap) in goals.items():
        queue = sorted(d for d in docs if d[2] == s and d[3])
        total, run = sum(d[3] for d in queue), 0
        for d in queue:
            run += d[3]
            line += [((p * total + run) / w, s, p + 1, d[1], d[3]) for p in range(cap)]
    out, spent = [], 0
    for f, s, p, i, n in sorted(line):
        if spent + n > budget:
            break
        spent += n
        out.append((i, s, p))
    return out


@pytest.mark.parametrize("budget", [0, 1, 300, 1000, 10**6])
def test_mix_follows_the_queues(spark, budget):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "word " * rng.randrange(0, 9), rng.choice(["A-b", " a_B", "c", "d", None]), "x", 1) for i in range(200)], "doc_id long, text string, source string, weight string, tokens int")
    targets = spark.createDataFrame([("a-b", 5.0, 2), ("C", 1.0, 3), ("e", 9.0, 1), ("d", None, 1), (None, 1.0, 1)], "source string, target_weight double, max_repeats int")
    mix = mixing.mix_sources(docs, targets, budget)
    sized = tokens.count_tokens(docs.select("doc_id", F.xxhash64("doc_id", F.lit(42)).alias("p"), mixing.source_name(F.col("source")).alias("s"), "text"), ["doc_id", "p", "s"]).collect()
    slices = lambda p: ((p % 2**64) >> 40) % mixing.SLICES
    want = plain_mix([((slices(r.p), r.p), r.doc_id, r.s, r.tokens) for r in sized], {"a_b": (5.0, 2), "c": (1.0, 3)}, budget)
    assert [(r.doc_id, r.source, r.pass_no) for r in mix.collect()] == want
    report = {r.source: r for r in mixing.mix_report(mix, docs, targets).collect()}
    assert set(report) == {"a_b", "c", "e"} and report["e"].tokens == 0 and sum(r.uses for r in report.values()) == len(want)


def test_equal_finish_times_are_cut_by_the_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICES", 4)
    docs = spark.createDataFrame([(s * 100 + i, "one two three", f"s{s}") for s in range(60) for i in range(3)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([(f"s{s}", 1.0, 1) for s in range(60)], "source string, target_weight double, max_repeats int")
    n = tokens.count_tokens(docs.limit(1), ["doc_id"]).first().tokens
    got = [(r.finish, r.source) for r in mixing.mix_sources(docs, targets, n * 100).collect()]
    assert got == sorted((float(n * k), f"s{s}") for k in (1, 2, 3) for s in range(60))[:100]


def test_shares_meet_the_targets(spark):
    d = "/root/testdata/sf0.01"
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    report = mixing.mix_report(mixing.mix_sources(docs, targets, 50_000), docs, targets).collect()
    goal = sum(r.target_share for r in report if r.tokens)
    largest = tokens.count_tokens(docs, ["doc_id"]).agg(F.max("tokens")).first()[0]
    assert all(abs(r.actual_share - r.target_share / goal) <= 2 * largest / 50_000 for r in report if r.tokens) and all(r.max_repeats_used <= r.max_repeats for r in report)
    empty = mixing.mix_sources(docs.where("false"), targets)
    assert empty.count() == 0 and mixing.mix_sources(docs, targets.where("false")).count() == 0


# garbled text


@pytest.fixture(scope="module")
def labeller(spark):
    rows = table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()
    return garble.Labeller(garble.CharacterModel(*garble.count_characters(r.text for r in rows)))


CLEAN = [
    "São Belmiro: não apague as imagens, a câmera gravou tudo às três.", "Die größeren Abzüge wirken fröhlich und müssen noch geprüft werden.", "Снимки из папки остались размытые, их около 303.",
    "Οι φωτογραφίες από το Ελατοχώρι", "昨天整理了视频，其中没有日期。请不要删除全景图", "├── 2015\n│   ├── originals\n└── Unsorted", "ATENÇÃO: NÃO MEXER ATÉ AMANHÃ, É DE VERÃO", "﻿Is this “sharp”? … – 17 °C, ½ × 3 🙂",
    "L’appareil d’Óðinn à Æbleholm était déjà là", "Café and über", "plain ascii", "",
]


def test_clean_texts_stay(labeller):
    for t in CLEAN:
        assert labeller.restore(t) == (t, []), t


def western(raw):
    return "".join(b.decode("cp1252") if b not in b"\x81\x8d\x8f\x90\x9d" else b.decode("latin-1") for b in (bytes([x]) for x in raw))


@pytest.mark.parametrize("wrong", ["western", "cp437", "cp850", "mac_roman"])
def test_round_trips(labeller, wrong):
    read = western if wrong == "western" else lambda raw: raw.decode(wrong)
    for t in CLEAN[:2] + CLEAN[2:3] + CLEAN[8:9]:
        bad = read(t.encode("utf-8"))
        fixed, spans = labeller.restore(bad)
        assert spans and fixed == t, (wrong, bad, fixed)
        part = t + "\n" + bad
        assert labeller.restore(part)[0] == t + "\n" + t


def test_other_pairs_and_double_garbling(labeller):
    ru, de, el = CLEAN[2], CLEAN[1], CLEAN[3]
    assert labeller.restore(western(ru.encode("cp1251")))[0] == ru
    assert labeller.restore(ru.encode("koi8_r").decode("cp1251"))[0] == ru
    assert labeller.restore(western(el.encode("cp1253")))[0] == el
    assert labeller.restore(western(western(de.encode("utf-8")).encode("cp1252")))[0] == de
    for lost in ("Gr��e aus K�ln", "The caf� te", "indexed\nMa�ana", "昨天整理了�视频"):
        assert labeller.restore(lost)[1] and labeller.restore(lost)[0] == lost
    assert labeller.restore("昨天整理了视频，其中没有日期".encode("utf-8").decode("gb18030", "replace"))[1]


def test_restored_table(spark):
    text = "Die größeren Abzüge wirken fröhlich und müssen noch geprüft werden. "
    rows = [(i, text * (i % 3 + 1), "r") for i in range(30)] + [(100, western(text.encode("utf-8")), "r")] * 2 + [(101, None, None), (102, "", ""), (103, "ascii only", ""), (104, " \n", ""), (105, text * 3000 + western(text.encode("utf-8")), "")]
    got = sorted((r.doc_id, r.restored.strip() == (text * (3001 if r.doc_id == 105 else 1)).strip()) for r in garble.restore_texts(spark.createDataFrame(rows, "doc_id long, text string, restored string")).collect())
    assert got == [(100, True), (100, True), (105, True)]
    assert garble.restore_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_on_planted_texts(spark, labeller):
    rows = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect() if r.text and not r.text.isascii() and not labeller.restore(r.text)[1]]
    hits, tried, by = 0, 0, defaultdict(int)
    for t in rows:
        for enc in ("western", "cp850", "mac_roman"):
            bad = western(t.encode("utf-8")) if enc == "western" else t.encode("utf-8").decode(enc)
            tried += 1
            found = bool(labeller.restore(bad)[1])
            hits += found
            by[enc] += not found
    assert hits >= 0.97 * tried, by


@pytest.mark.parametrize("step, copies", [(2, 1), (3, 20)])
def test_frequent_garbled_texts_do_not_become_clean(spark, labeller, step, copies):
    texts = sorted({r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect() if r.text and not r.text.isascii()})
    russian = [t for t in texts if sum("\u0400" <= c < "\u0500" for c in t) > 40 and not labeller.restore(t)[1]][::step]
    bad = [t.encode("cp1251", "replace").decode("koi8_r") for t in russian]
    assert len(bad) > 10
    rows = [(i, t) for i, t in enumerate(set(texts) - set(russian))] + [(-i - 1, t) for i, t in enumerate(bad) for _ in range(copies)]
    found = {r.doc_id for r in garble.restore_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows if i < 0} <= found


def test_long_texts_try_every_pair_that_could_pay(labeller):
    ru, de, el = CLEAN[2], CLEAN[1], CLEAN[3]
    parts = [(western(de.encode("utf-8")), de), (western(ru.encode("cp1251")), ru), (western(el.encode("cp1253")), el), (de.encode("utf-8").decode("cp437"), de), (ru.encode("utf-8").decode("mac_roman"), ru), (ru.encode("koi8_r").decode("cp1251"), ru)]
    sound = " plain words in between, as many as it takes\n"
    fixed, spans = labeller.restore(sound.join(bad for bad, _ in parts))
    assert len({s for _, _, states in labeller.candidates(sound.join(bad for bad, _ in parts)) for s in states}) > 4
    assert fixed == sound.join(t for _, t in parts)
    assert len({s for _, _, s in spans}) >= 6


#: Alphabets that the true encodings of the pairs are tried with.
SAMPLES = {"[\u0430-\u044f]{3}": ("cp1251", "koi8_r", "cp866", "iso8859-5", "mac_cyrillic", "utf-8"), "[\u03b1-\u03c9]{3}": ("cp1253", "iso8859-7", "cp737", "utf-8"), "[\u0151\u0171\u0142\u0105\u0119\u015b\u017e\u010d\u0159]": ("cp1250", "iso8859-2", "cp852"), "[\u4e00-\u9fff]{3}": ("gb18030", "utf-8"), "[\u3040-\u30ff]{3}": ("cp932", "euc_jp"), "[äöüéèêàçñãõ]": ("western", "cp1252", "cp850", "cp437", "mac_roman", "cp1254", "utf-8")}


def test_every_pair_is_found(spark, labeller):
    import re

    rows = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").distinct().collect() if r.text and 60 < len(r.text) < 400 and not r.text.isascii()]
    rows = sorted(t for t in rows if not labeller.label(t)[1])
    tried, found, same, exact = Counter(), Counter(), Counter(), Counter()
    for i, (true, wrong) in enumerate(garble.PAIRS):
        for pattern in [p for p, encodings in SAMPLES.items() if true in encodings]:
            for t in [t for t in rows if len(re.findall(pattern, t)) > 4][:4]:
                try:
                    raw = t.encode("cp1252" if true == "western" else true)
                    raw = western(raw).encode("utf-8") if wrong == "western twice" else raw
                    bad = western(raw) if wrong.startswith("western") else raw.decode(wrong, "replace" if wrong in garble._MULTI else "strict")
                except UnicodeError:
                    continue
                if bad != t:
                    fixed, spans = labeller.restore(bad)
                    tried[i] += 1
                    found[i] += bool(spans)
                    exact[i] += (whole := "\ufffd" not in bad and wrong not in garble._MULTI)
                    same[i] += whole and fixed == t
    assert len(tried) >= 85 and sum(found.values()) >= 0.97 * sum(tried.values()), {garble.PAIRS[i]: (tried[i], found[i]) for i in tried if found[i] < tried[i]}
    assert sum(same.values()) >= 0.85 * sum(exact.values())


def test_readings_of_several_bytes_begin_and_end_inside_a_run(labeller):
    zh, more = "这一组照片的哈希值相同", "昨天整理了视频"
    bad = more.encode("utf-8").decode("gb18030", "replace")
    fixed, spans = labeller.restore(zh + bad + zh)
    assert fixed.startswith(zh) and fixed.endswith(zh) and "昨天整理" in fixed and spans
    # lost bytes cost their characters only
    greek = "Οι φωτογραφίες από το Ελατοχώρι".encode("utf-8").decode("cp932", "replace")
    assert "\ufffd" in greek and sum(c in "Οι φωτογραφίες από το Ελατοχώρι" for c in labeller.restore(greek)[0]) > 15


def test_seven_readings_in_one_text(labeller):
    ru, de, el, pl = CLEAN[2], CLEAN[1], CLEAN[3], "Zdjęcia z gór są już posortowane, ale część jest rozmyta, więc usuń łąki."
    parts = [(western(de.encode("utf-8")), de), (western(ru.encode("cp1251")), ru), (western(el.encode("cp1253")), el), (de.encode("utf-8").decode("cp437"), de), (ru.encode("utf-8").decode("mac_roman"), ru), (ru.encode("koi8_r").decode("cp1251"), ru), (western(pl.encode("utf-8")), pl)]
    assert labeller.restore(" ".join(bad for bad, _ in parts))[0] == " ".join(t for _, t in parts)


def test_the_model_keeps_every_neighbour(spark):
    han = [chr(0x4E00 + i) for i in range(700)]
    pairs = [a + b for a in han for b in han]
    texts = [(" ".join(pairs[i : i + 7000]),) for i in range(0, len(pairs), 7000)]
    model = garble._counted(garble._pass(spark.createDataFrame(texts, "t string"), None)[0])
    assert len(pairs) > 450_000 and all(model.twos.get(p) == 1 for p in pairs)


def test_utf8_is_looked_up_only_where_a_character_can_begin(monkeypatch):
    asked = []
    look = garble.Pair._true_char
    monkeypatch.setattr(garble.Pair, "_true_char", lambda p, chunk: asked.append((p, chunk)) or look(p, chunk))
    garble.pair.cache_clear()
    true = "Grüße aus Köln, žluťoučký kůň, где живёт съешь 日本語 – «naïve» "
    texts = [true.encode("utf-8").decode("cp1251", "replace"), true.encode("utf-8").decode("latin-1") * 3]
    clean = [true, "Ещё один обычный текст, où l'été déjà fini"]
    found = [garble.Labeller(garble.CharacterModel(*garble.count_characters(iter(clean * 20)))).restore(t) for t in texts + clean]
    garble.pair.cache_clear()
    assert found[1][0] == true * 3 and found[0][1] and not found[2][1] and not found[3][1]
    utf8 = [(p, chunk) for p, chunk in asked if p.true == "utf-8" and p.single and not p.twice]
    assert utf8
    for p, chunk in utf8:
        first = p.table[chunk[0]]
        assert 0xC2 <= first < 0xF5 and len(chunk) == (2 if first < 0xE0 else 3 if first < 0xF0 else 4)
