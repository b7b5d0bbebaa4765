"""Session helpers: configuration, shared scratch tables and lineage cuts.

Everything that must outlive an executor is written to the folder named by
``spark.checkpoint.dir``; a folder of our own is used only where that is unset
(local tests).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that an operator may broadcast or turn into literals.
BROADCAST_ROWS = 100_000
#: A key is hot if it holds more than one in HOT_KEYS of the rows (so there are fewer than that), and more than HOT_ROWS rows.
HOT_KEYS, HOT_ROWS = 10_000, 100_000


def build_session(app: str = "shelfmark", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one in local mode.

    ``spark.checkpoint.dir`` is read from the session. A temporary folder is
    made only when neither the setting nor the context's checkpoint folder
    exists and everything runs in this process; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = option.get() if option.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
        named = tempfile.mkdtemp(prefix="shelfmark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/shelfmark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def write_scratch(df: DataFrame, label: str, by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: a compact lineage cut
    that survives lost executors. Returns the frame and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    for made in getattr(_SCOPES, "open", [])[-1:]:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


_SCOPES = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are written inside are deleted at the end: for jobs
    that consume their result before they go on, such as batches of a stream."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
    try:
        yield
    finally:
        *_SCOPES.open, made = _SCOPES.open
        drop_scratch(spark, *made)


def drop_scratch(spark: SparkSession, *paths: str | None) -> None:
    """Delete scratch tables that no live frame reads any more."""
    jvm = spark._jvm
    for path in paths:
        if path:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> DataFrame | None:
    """(key): the hot keys of ``rows``, fewer than HOT_KEYS; None if there are
    none, which ``total`` rows may show without counting."""
    if total is None:
        total = rows.count()
    if total <= HOT_ROWS:
        return None
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot, path = write_scratch(counts.where(F.col("_n") > max(HOT_ROWS, total // HOT_KEYS)).select(key), "hot-keys")
    if hot.limit(1).count():
        return hot
    drop_scratch(rows.sparkSession, path)
    return None


def hot_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``side``, which has one row a key at most, so that no
    task gets a hot key of ``rows``: the rows of ``side`` for the keys of
    ``hot``, fewer than HOT_KEYS, are broadcast, and only the other keys are
    shuffled. ``how`` is inner, left, left_semi or left_anti; a null key matches nothing."""
    if hot is None:
        return rows.join(side, key, how)
    hot = hot.toDF(key)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest = marked.where("_hot is null").drop("_hot").join(side, key, how)
    few = side.join(F.broadcast(hot), key, "left_semi")
    return marked.where("_hot").drop("_hot").join(F.broadcast(few), key, how).unionByName(rest)


def number_rows(rows: DataFrame, out: str, *order: str | Column, group: str | None = None) -> DataFrame:
    """Add ``out``: 1, 2, ... in ``order``, which should be total; with ``group``
    inside each group. Rows are sorted in ranges, so neither the whole table nor
    a hot group lies in one task; what reaches the driver is a count a range."""
    spark = rows.sparkSession
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    named = rows.select("*", *[b.alias(f"_nr_{i}") for i, b in enumerate(by)])
    keys = ([F.col(group)] if group else []) + [F.col(f"_nr_{i}") for i in range(len(by))]
    ranged = named.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed, _ = write_scratch(ranged.select(*rows.columns, F.spark_partition_id().alias("_nr_part"), inside.alias("_nr_at")), "numbered")
    sizes = sorted((r["_nr_part"], r.n) for r in placed.groupBy("_nr_part").agg(F.count("*").alias("n")).collect())  # one row a range
    starts, upto = [], 0
    for p, n in sizes:
        starts.append((p, upto))
        upto += n
    start = F.broadcast(spark.createDataFrame(starts, "_nr_part int, _nr_start long"))
    numbered = placed.join(start, "_nr_part").withColumn(out, F.col("_nr_start") + F.col("_nr_at") + 1).drop("_nr_part", "_nr_at", "_nr_start")
    if group is None:
        return numbered
    first = numbered.groupBy(group).agg(F.min(out).alias("_nr_first"))
    joined = hot_join(numbered.where(F.col(group).isNotNull()), first, group, hot=hot_keys(placed, group, upto))
    return joined.withColumn(out, F.col(out) - F.col("_nr_first") + 1).select(*rows.columns, out)


def slots(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def input_partitions(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame, per_slot: int = 1) -> DataFrame:
    """Repartition only when there are fewer input partitions than task slots:
    a scan that is already wide is left alone, so nothing is shuffled at scale."""
    want = slots(df.sparkSession) * per_slot
    return df if input_partitions(df) >= slots(df.sparkSession) else df.repartition(want)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
