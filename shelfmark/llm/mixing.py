"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated up to its
cap. A document's virtual finish time is the tokens of its queue up to and
including it, divided by the target weight; the mix is the documents with the
least finish times that fit the budget. A source that runs out leaves its share
to the others in proportion to their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tokens import count_tokens
from shelfmark.runtime import write_scratch

#: Slices of each queue, and of the common time line; running totals are taken over slices first, then inside one.
SLICES = 4096


def source_name(col: Column) -> Column:
    """Trimmed, lower case, '-' as '_'."""
    return F.translate(F.lower(F.trim(col)), "-", "_")


def _targets(targets: DataFrame) -> DataFrame:
    """One row for each usable source: weights of rows with the same name add up, the larger cap holds."""
    named = targets.select(source_name(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("cap"))
    sound = named.where(F.col("source").isNotNull() & (F.col("weight") > 0) & ~F.isnan("weight"))
    return sound.groupBy("source").agg(F.sum("weight").alias("weight"), F.max(F.greatest(F.coalesce("cap", F.lit(0)), F.lit(0))).alias("cap"))


def mix_sources(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42, vocabulary: str | None = None) -> DataFrame:
    """The mix: (doc_id, source, pass_no, tokens, finish), ordered by finish.

    ``budget`` is the total size in tokens; by default the tokens of all
    documents of the target sources taken once. The mix is the longest start of
    the time line that does not exceed it. pass_no counts the uses of a
    document from 1. Documents without tokens (null and empty texts), with a
    null source or with a source that has no weight are not used; a target
    without documents is only reported by ``mix_report``. Equal finish times
    are ordered by source, pass and doc_id. Repeated rows are separate
    documents.
    """
    spark = documents.sparkSession
    sized = count_tokens(documents.select("doc_id", source_name(F.col("source")).alias("_source"), "text"), ["doc_id", "_source"], vocabulary=vocabulary)
    goal = _targets(targets)
    # a target row is one source; the join is by its name and Spark broadcasts it only under its own size check
    docs = sized.where("tokens > 0").join(goal, F.col("_source") == F.col("source")).where("cap > 0").select("doc_id", "source", "tokens", "weight", "cap")
    place = F.xxhash64("doc_id", F.lit(seed))
    docs = docs.withColumn("place", place).withColumn("slice", F.pmod(F.shiftrightunsigned("place", 40), F.lit(SLICES)).cast("int"))
    docs, _ = write_scratch(docs, "mix-docs")
    # running totals: slices of a queue (at most SLICES rows a source), then rows inside a slice
    queue = Window.partitionBy("source").orderBy("slice")
    slices = docs.groupBy("source", "slice").agg(F.sum("tokens").alias("in_slice"))
    slices = slices.withColumn("before", F.sum("in_slice").over(queue.rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_slice")).withColumn("total", F.sum("in_slice").over(Window.partitionBy("source"))).drop("in_slice")
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    once = docs.withColumn("run", F.sum("tokens").over(inside)).join(slices, ["source", "slice"])
    finish = ((F.col("pass_no") - 1) * F.col("total") + F.col("before") + F.col("run")) / F.col("weight")
    line = once.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("cap")))).select("doc_id", "source", "pass_no", "tokens", finish.alias("finish"))
    line, _ = write_scratch(line, "mix-line")
    ends = line.agg(F.max("finish").alias("top")).first()
    if budget is None:
        budget = docs.agg(F.sum("tokens")).first()[0] or 0
    # the cut: totals of time slices, then the rows of the one slice that crosses the budget, opened again until it is small
    low, high, spent = 0.0, float(ends["top"] or 0.0), 0
    cut_rows = line
    for _ in range(4):
        width = (high - low) / SLICES
        if width <= 0:
            break
        at = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(SLICES - 1)).cast("int")
        totals = cut_rows.withColumn("at", at).groupBy("at").agg(F.sum("tokens").alias("n"), F.count("*").alias("k"), F.min("finish").alias("lo"), F.max("finish").alias("hi"))
        crossing = None
        for row in sorted(totals.collect()):  # at most SLICES rows
            if spent + row.n > budget:
                crossing = row
                break
            spent += row.n
        if crossing is None:
            low = None  # everything fits
            break
        low, high = crossing.lo, crossing.hi
        cut_rows = line.where(F.col("finish").between(low, high))
        if crossing.k <= SLICES:
            break
    order = ["finish", "source", "pass_no", "doc_id"]
    if low is None:
        return line.orderBy(*order)
    # the rows of the crossing slice, however many share its finish times: sums of ranges first, then inside each range
    ranged = cut_rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id())
    ranged, _ = write_scratch(ranged, "mix-cut")
    starts, total = [], spent
    for row in sorted(ranged.groupBy("_range").agg(F.sum("tokens").alias("n")).collect()):  # one row a range
        starts.append((row["_range"], total))
        total += row.n
    start = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = ranged.join(start, "_range").withColumn("upto", F.col("_start") + F.sum("tokens").over(inside)).where(F.col("upto") <= F.lit(budget)).select(*line.columns)
    return line.where(F.col("finish") < low).unionByName(last).orderBy(*order)


def mix_report(mix: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share, tokens, documents and repeats of every source
    of ``targets`` (zeros where it has no documents)."""
    goal = _targets(targets)
    used = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.countDistinct("doc_id").alias("docs"), F.max("pass_no").alias("max_pass"))
    everything = Window.partitionBy()  # one row a source
    return goal.join(used, "source", "left").select(
        "source",
        (F.col("weight") / F.sum("weight").over(everything)).alias("target_share"),
        (F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(everything)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("max_pass", F.lit(0)).alias("max_repeats_used"),
        F.col("cap").alias("max_repeats"),
    )
