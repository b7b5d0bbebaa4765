"""Matching new batches against all history through persisted inverted-file cells.

A 64-bit fingerprint is cut into blocks; the value of one block names a cell, so
each vector lies in one cell for each block, and its distance to any member of a
cell is at least the bits in which its block differs from the cell. A batch
probes cells in the order of these bounds: once all cells within ``reach[i]``
bits in block i are seen, nothing unseen is nearer than the sum of
``reach[i]`` + 1, and a query whose best match is nearer stops. Cells keep the
full vectors; the exact distance decides. Batches are appended as new files, and
a small batch reads the pages of the cells that it probes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.hashes import hamming, hex_to_long, valid_hex
from shelfmark.runtime import BROADCAST_ROWS, drop_scratch, exists, hot_join, hot_keys, scratch_path, scratch_scope, write_scratch

#: Bits of a block and the number of blocks.
BLOCK, BLOCKS = 16, 4
#: Files that one block's cells are spread over, by their leading bits, and files of the records by value; a batch reads only those it needs.
ZONES, SLOTS = 8, 16
#: Rows of a page of the cells, the least that is read.
PAGE = 256
#: Distinct cells, keys or values that are named in a filter of the scan, so that only their pages are read.
NAMED = 1000
#: Vectors of one cell above which the cell is divided by a second block.
HOT_CELL = 4096


def reaches(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Bits to search around each block so that every pair within ``radius`` meets:
    a pair that escapes differs in reach[i] + 1 bits or more in every block, and
    the sum of these is ``radius`` + 1. -1 means the block need not be probed."""
    each, more = divmod(radius + 1, blocks)
    return [each + (i < more) - 1 for i in range(blocks)]


def _masks(bits: int) -> list[int]:
    return [sum(1 << b for b in chosen) for k in range(bits + 1) for chosen in combinations(range(BLOCK), k)]


def _block(key: Column, i: int) -> Column:
    return F.shiftrightunsigned(key, i * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int")


def _homes(keys: DataFrame, blocks: list[int]) -> DataFrame:
    """(cell, key): each key once for each block, in its own cell."""
    cells = F.array(*[F.lit(i << BLOCK).bitwiseOR(_block(F.col("key"), i)) for i in blocks])
    return keys.select(F.explode(cells).alias("cell"), "key")


def _zone(cell: Column) -> Column:
    """The file group of a cell: its block and the leading bits of its value."""
    lead = F.shiftright(cell.bitwiseAND(F.lit((1 << BLOCK) - 1)), BLOCK - ZONES.bit_length() + 1)
    return (F.shiftright(cell, BLOCK) * ZONES + lead).cast("int")


def _around(key: Column, i: int, bits: int, cell: bool = True) -> Column:
    """Values of block i within ``bits`` bits of the key's, as cells if wanted."""
    masks = F.array(*[F.lit(m) for m in _masks(bits)])
    return F.transform(masks, lambda m: _block(key, i).bitwiseXOR(m).bitwiseOR(F.lit(i << BLOCK if cell else 0)))


def _probes(keys: DataFrame, reach: list[int]) -> DataFrame:
    """(cell, key): each key once for each cell within the reach of its blocks."""
    near = F.concat(*[_around(F.col("key"), i, r) for i, r in enumerate(reach) if r >= 0])
    return keys.select(F.explode(near).alias("cell"), "key")


def _first_block(a: Column, b: Column, reach: list[int]) -> Column:
    """The first block within reach: a pair is reported from that block only."""
    apart = lambda i: F.bit_count(_block(a.bitwiseXOR(b), i))
    return reduce(lambda rest, i: F.when(apart(i) <= reach[i], F.lit(i)).otherwise(rest), [i for i in reversed(range(len(reach))) if reach[i] >= 0], F.lit(-1))


def _slot(col: Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SLOTS)).cast("int")


class CellIndex:
    """Records on disk by status: cells of full vectors, and records by key and by value.

    Layout under ``path``, each with status= and batch= folders: cells/zone=
    (cell, key), sizes (cell, n), members/slot= (key, id), exact/slot= (value,
    id). All are sorted, in small pages. A batch that is written again replaces
    itself, so a repeated or restarted append changes nothing. A path that
    exists is gone on with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, radius: int = 6):
        self.spark, self.path, self.radius = spark, path or scratch_path(spark, "cells"), radius
        self.blocks = [i for i, r in enumerate(reaches(radius)) if r >= 0]

    def append(self, rows: DataFrame, batch: str, status: str = "accepted") -> None:
        """Add ``rows`` (id, key, value); null keys and values are left out."""
        at = f"status={status}/batch={batch}"

        def write(df: DataFrame, part: str, by: str, order: str) -> None:
            writer = df.repartition(by).sortWithinPartitions(by, order).write.mode("overwrite").partitionBy(by)
            writer.option("parquet.page.row.count.limit", PAGE).parquet(f"{self.path}/{part}/{at}")

        keyed = rows.where(F.col("key").isNotNull()).select("key", "id")
        cells = _homes(keyed.select("key").distinct(), self.blocks).withColumn("zone", _zone(F.col("cell")))
        write(cells, "cells", "zone", "cell")
        added = self._read("cells", "cell int, key long", "zone", status).where(F.col("batch") == batch)
        added.groupBy("cell").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/sizes/{at}")
        write(keyed.withColumn("slot", _slot(F.col("key"))), "members", "slot", "key")
        write(rows.where(F.col("value").isNotNull()).select("value", "id", _slot(F.col("value")).alias("slot")), "exact", "slot", "value")

    def _read(self, part: str, schema: str, by: str | None, status: str) -> DataFrame:
        whole = f"{schema}, status string, batch string" + (f", {by} int" if by else "")
        if not exists(self.spark, f"{self.path}/{part}/status={status}"):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}/status={status}")

    def _named(self, part: str, schema: str, by: str, status: str, column: str, wanted: DataFrame, place: Column) -> DataFrame:
        """Rows of a part whose ``column`` may be among ``wanted``: the folders
        that hold any, and of these only the pages of the values if they are few."""
        rows = self._read(part, schema, by, status)
        few = wanted.select(column).distinct().limit(NAMED + 1)
        values, _ = write_scratch(few, "wanted")
        some = [r[0] for r in values.collect()]  # at most NAMED + 1 rows
        if len(some) > NAMED:
            folders = [r[0] for r in wanted.select(place.alias("p")).distinct().collect()]  # at most one row a folder
            return rows.where(F.col(by).isin(folders))
        folders = [r[0] for r in values.select(place.alias("p")).distinct().collect()]
        # single comparisons are pushed into the scan, where a long list would become one range
        return rows.where(F.col(by).isin(folders) & _any([F.col(column) == v for v in sorted(some)]))

    def near_keys(self, batch: DataFrame, radius: int | None = None, status: str = "accepted") -> DataFrame:
        """(key_new, key_old, distance): distinct keys of ``batch`` and of the index within the radius.

        The sizes of the cells are kept with the index (their number is bounded
        by the blocks). The probes of a small batch are broadcast, so the cells
        are neither moved nor, where no probe names them, read; a large batch,
        whose probes outnumber the bound, is joined by shuffle. Its joins are
        named, as the planner takes a table of probes to be no larger than the
        keys that it is made of and would broadcast it.
        """
        radius = self.radius if radius is None else radius
        reach = [r if i in self.blocks else -1 for i, r in enumerate(reaches(radius))]
        keys, _ = write_scratch(batch.where(F.col("key").isNotNull()).select("key").distinct(), "new-keys")
        small = keys.count() * sum(len(_masks(r)) for r in reach if r >= 0) <= BROADCAST_ROWS
        probes = _probes(keys, reach).select("cell", F.col("key").alias("q"))
        if small:
            probes, _ = write_scratch(probes, "probes")
            cells = self._named("cells", "cell int, key long", "zone", status, "cell", probes, _zone(F.col("cell")))
        else:
            cells = self._read("cells", "cell int, key long", "zone", status)
        sizes = self._read("sizes", "cell int, n long", None, status).groupBy("cell").agg(F.sum("n").alias("n"))
        hot, _ = write_scratch(sizes.where(F.col("n") > HOT_CELL).select("cell"), "hot-cells")
        some_hot = hot.limit(1).count() > 0
        calm_probes, calm = probes, cells
        if some_hot:
            # a hot cell holds more than HOT_CELL of the vectors, so there are few; beyond the bound they are joined by shuffle
            side = F.broadcast(hot) if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hot
            calm_probes, calm = probes.join(side, "cell", "left_anti"), cells.join(side, "cell", "left_anti")
        met = calm.join(F.broadcast(calm_probes), "cell") if small else calm_probes.hint("merge").join(calm.select("cell", "key"), "cell")
        found = self._verified(met, reach, radius)
        if some_hot:
            found = found.unionByName(self._inside_hot(probes.join(side, "cell", "left_semi"), cells.join(side, "cell", "left_semi"), reach, radius))
        # a key that was appended more than once lies in its cells as often
        return found.select(F.col("q").alias("key_new"), F.col("key").alias("key_old"), hamming(F.col("q"), F.col("key")).alias("distance")).distinct()

    @staticmethod
    def _verified(met: DataFrame, reach: list[int], radius: int) -> DataFrame:
        first = _first_block(F.col("q"), F.col("key"), reach)
        return met.where((hamming(F.col("q"), F.col("key")) <= radius) & (F.shiftright("cell", BLOCK) == first)).select("q", "key", "cell")

    def _inside_hot(self, probes: DataFrame, cells: DataFrame, reach: list[int], radius: int) -> DataFrame:
        """Hot cells are divided by the other blocks, again with exact reaches:
        the pair still differs in at most ``radius`` bits over those blocks.
        Probes are many times the keys here, so they are always shuffled."""
        inner = reaches(radius, BLOCKS - 1)
        out = []
        for block in [i for i, r in enumerate(reach) if r >= 0]:
            rest = [i for i in range(BLOCKS) if i != block]
            mine = F.shiftright("cell", BLOCK) == block
            for i, r in zip(rest, inner):
                if r < 0:
                    continue
                left = probes.where(mine).select("cell", "q", F.explode(_around(F.col("q"), i, r, cell=False)).alias("sub"))
                right = cells.where(mine).select("cell", "key", _block(F.col("key"), i).alias("sub"))
                earlier = [(j, s) for j, s in zip(rest, inner) if j < i and s >= 0]
                met = left.hint("merge").join(right, ["cell", "sub"])
                for j, s in earlier:  # reported from the first of the inner blocks only
                    met = met.where(F.bit_count(_block(F.col("q").bitwiseXOR(F.col("key")), j)) > s)
                out.append(self._verified(met, reach, radius))
        return reduce(DataFrame.unionByName, out)

    def _members(self, near: DataFrame, status: str) -> DataFrame:
        wanted = near.select(F.col("key_old").alias("key"))
        return self._named("members", "key long, id long", "slot", status, "key", wanted, _slot(F.col("key"))).select(F.col("key").alias("key_old"), F.col("id").alias("id_old"))

    def match(self, batch: DataFrame, status: str = "accepted") -> DataFrame:
        """(id_new, id_old): pairs of a row of ``batch`` (id, key, value) and a
        record of the index with equal value, or keys within the radius. Each
        pair once; a record is never paired with its own id. Null keys and
        values match nothing."""
        near, _ = write_scratch(self.near_keys(batch, status=status), "near-keys")
        new = batch.select(F.col("id").alias("id_new"), F.col("key").alias("key_new"), "value")
        by_key = new.where("key_new is not null").join(near, "key_new").join(self._members(near, status), "key_old").select("id_new", "id_old")
        valued = new.where("value is not null")
        exact = self._named("exact", "value string, id long", "slot", status, "value", valued, _slot(F.col("value"))).select("value", F.col("id").alias("id_old"))
        by_value = valued.join(exact, "value").select("id_new", "id_old")
        return by_key.unionByName(by_value).where("id_new <> id_old").distinct()

    def nearest(self, batch: DataFrame, status: str = "accepted") -> DataFrame:
        """(id_new, id_old, distance): the nearest record of each row of ``batch``
        within the radius, the smallest id of equal ones; no row where there is none.

        Cells are probed in rounds of growing bounds. After a round whose cells
        hold everything within b bits, a query that has a match stops, as
        nothing unseen can be as near; only the others go on.
        """
        keys, path = write_scratch(batch.where(F.col("key").isNotNull()).select("key").distinct(), "open-keys")
        rounds = []
        for bound in [*range(BLOCKS - 1, self.radius, BLOCKS), self.radius]:
            near, _ = write_scratch(self.near_keys(keys, bound, status), "near-keys")
            best = near.groupBy("key_new").agg(F.min("distance").alias("distance"))
            found, _ = write_scratch(near.join(best, ["key_new", "distance"]), "nearest")
            rounds.append(found)
            rest, rest_at = write_scratch(keys.join(found.select(F.col("key_new").alias("key")).distinct(), "key", "left_anti"), "open-keys")
            drop_scratch(self.spark, path)
            keys, path = rest, rest_at
        near = reduce(DataFrame.unionByName, rounds)
        near = near.join(self._members(near, status), "key_old").groupBy("key_new", "distance").agg(F.min("id_old").alias("id_old"))
        new = batch.where("key is not null").select(F.col("id").alias("id_new"), F.col("key").alias("key_new"))
        return hot_join(new, near, "key_new", hot=hot_keys(new, "key_new")).select("id_new", "id_old", "distance")


def _any(conditions: list[Column]) -> Column:
    """Conditions joined by or, as a balanced tree."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


def without_frequent(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Null out values of ``columns`` that ``limit`` or more rows hold."""
    for c in columns:
        often = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n")).where(F.col("_n") >= limit).select("_v")
        often, _ = write_scratch(often, "frequent")
        side = F.broadcast(often) if often.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else often
        kept = rows.join(side.withColumn("_hit", F.lit(True)), F.col(c) == F.col("_v"), "left")
        rows = kept.withColumn(c, F.when(F.col("_hit").isNull(), F.col(c))).drop("_v", "_hit")
    return rows


def matchable(files: DataFrame, frequent: int | None = None) -> DataFrame:
    """(id, status, batch, key, value) of the rows with a valid hash, written
    once. A batch is a year of scanned_at (null is a batch of its own). A hash
    held by ``frequent`` or more rows of ``files`` counts as missing."""
    text = valid_hex(F.col("phash"), 16)
    rows = files.select(F.col("file_id").alias("id"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce(F.nullif(F.substring("scanned_at", 1, 4), F.lit("")), F.lit("none")).alias("batch"), F.when(text.isNotNull(), hex_to_long(text)).alias("key"), valid_hex(F.col("sha256"), 64).alias("value"))
    if frequent:
        rows = without_frequent(rows, ["key", "value"], frequent)
    return write_scratch(rows.where(F.col("key").isNotNull() | F.col("value").isNotNull()), "matchable")[0]


def match_new_files(files: DataFrame, radius: int = 6, frequent: int = 8, accepted: str = "done", skipped: tuple[str, ...] = ("error",), path: str | None = None) -> DataFrame:
    """(file_id_a, file_id_b), a < b: files not yet accepted against accepted ones.

    The index at ``path`` (a scratch table by default) is given the accepted
    files first. The others come in the order of their batches: each is matched
    with what is accepted and then appended as pending, so that the index knows
    every record and no batch is read again. A sha256 or phash held by
    ``frequent`` or more rows of ``files`` counts as missing. A null status is
    not accepted and is matched. Empty tables give an empty result.
    """
    spark = files.sparkSession
    rows = matchable(files, frequent)
    index = CellIndex(spark, path, radius)
    index.append(rows.where(F.col("status") == accepted).select("id", "key", "value"), "0")
    incoming = rows.where(~F.col("status").isin(accepted, *skipped))
    out = scratch_path(spark, "matches")
    batches = sorted(r.batch for r in incoming.select("batch").distinct().collect())  # one row a year
    for name in batches:
        batch = incoming.where(F.col("batch") == name).select("id", "key", "value")
        with scratch_scope(spark):
            index.match(batch).write.mode("overwrite").parquet(f"{out}/batch={name}")
            index.append(batch, name, "pending")
    if not batches:
        return spark.createDataFrame([], "file_id_a long, file_id_b long")
    pairs = spark.read.schema("id_new long, id_old long").parquet(*[f"{out}/batch={name}" for name in batches])
    return pairs.select(F.least("id_new", "id_old").alias("file_id_a"), F.greatest("id_new", "id_old").alias("file_id_b"))


def nearest_accepted(files: DataFrame, radius: int = 6, accepted: str = "done", skipped: tuple[str, ...] = ("error",)) -> DataFrame:
    """(file_id, nearest_id, distance): for each file not yet accepted the nearest
    accepted one within ``radius`` bits, of equal ones the smallest id. All
    hashes take part, however many files hold them."""
    rows = matchable(files)
    index = CellIndex(files.sparkSession, None, radius)
    index.append(rows.where(F.col("status") == accepted).select("id", "key", "value"), "0")
    found = index.nearest(rows.where(~F.col("status").isin(accepted, *skipped)).select("id", "key", "value"))
    return found.select(F.col("id_new").alias("file_id"), F.col("id_old").alias("nearest_id"), "distance")
