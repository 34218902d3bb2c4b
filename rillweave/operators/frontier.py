"""The URL frontier as sets: deduplication, capacity, robots filter, order of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import dedup_key
from ..options import OPTIONS

PRIORITIES = {"CRITICAL": 0, "HIGH": 1, "NORMAL": 2, "LOW": 3}


def priority_number(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in PRIORITIES.items() for x in pair)), name)


def disposition(urls: DataFrame, max_size: int | None = OPTIONS.queue_size, seen: DataFrame | None = None) -> DataFrame:
    """urls (seq, url, allowed, ...) with `disposition`: added, duplicate, filtered or rejected_full.

    The same as offering the rows one by one in order of seq: a key is taken by
    its first allowed row; once max_size are taken the rest is rejected, but
    repeats of taken keys still count as duplicates, and a denied row is never
    marked as seen. seen: keys (`key`) taken before. The cut-off is a top-k, not
    a global sort; None is no cut-off. Keys may be in seen more than once. urls are used more than once, so costly
    ones should be written first.
    """
    keyed = urls.withColumn("__key", dedup_key(F.col("url")))
    first = keyed.where("allowed").groupBy("__key").agg(F.min("seq").alias("__first"))
    if seen is not None:
        old = seen.select(F.col("key").alias("__key")).distinct()
        first = first.join(old, "__key", "left_anti")
    rows = keyed.join(first, "__key", "left")
    if max_size is None:
        rows = rows.withColumn("__cutoff", F.lit((1 << 63) - 1))
    else:
        full = first.orderBy("__first").limit(max_size).agg(F.max("__first").alias("__last"), F.count("*").alias("__n"))
        cutoff = F.when(F.col("__n") == max_size, F.col("__last")).otherwise(F.lit((1 << 63) - 1)) if max_size else F.lit(-1)
        rows = rows.join(F.broadcast(full.select(cutoff.alias("__cutoff"))))  # one row
    if seen is not None:
        rows = rows.join(old.withColumn("__old", F.lit(True)), "__key", "left")
    else:
        rows = rows.withColumn("__old", F.lit(None).cast("boolean"))
    kind = (
        F.when(F.coalesce("__old", F.lit(False)), "duplicate")
        .when((F.col("seq") == F.col("__first")) & (F.col("seq") <= F.col("__cutoff")), "added")
        .when((F.col("seq") > F.col("__first")) & (F.col("__first") <= F.col("__cutoff")), "duplicate")
        .when(F.col("seq") > F.col("__cutoff"), "rejected_full")
        .otherwise("filtered")
    )
    return rows.withColumn("disposition", kind).select(*urls.columns, "disposition")


def pop_order(added: DataFrame) -> DataFrame:
    """The order of work: priority, then arrival."""
    return added.orderBy("priority", "seq")


def peek(added: DataFrame) -> DataFrame:
    return pop_order(added).limit(1)


def seen_keys(judged: DataFrame) -> DataFrame:
    """The keys (`key`) that a batch took: what disposition() takes as seen for the next one."""
    return judged.where("disposition = 'added'").select(dedup_key(F.col("url")).alias("key")).distinct()


def clear(queued: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty queue and one row, how many were in it; what was seen stays seen."""
    return queued.where(F.lit(False)), queued.agg(F.count("*").alias("cleared"))


def reset_seen(seen: DataFrame) -> DataFrame:
    """No keys, so that all may be taken again."""
    return seen.where(F.lit(False))


def with_rank(added: DataFrame) -> DataFrame:
    """added with `rank`, the place in the order of work, without sorting in one task.

    Rows are counted by priority and by range of seq; a row's rank is what
    stands before its group plus its place within. Groups are bounded by the
    spread of seq, not by the number of rows of a priority.
    """
    ranges = added.withColumn("__part", F.floor(F.col("seq") / 65_536))
    sizes = ranges.groupBy("priority", "__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("priority", "__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("priority", "__part").orderBy("seq"))
    return ranges.join(before.drop("__n"), ["priority", "__part"]).withColumn("rank", F.col("__before") + inside).drop("__part", "__before")


def queue_counts() -> list[Column]:
    """What became of the rows offered, as aggregates over rows with their disposition."""
    n = lambda kind, name: F.count_if(F.col("disposition") == kind).alias(name)
    return [n("added", "total_added"), n("filtered", "filtered_robots"), n("duplicate", "duplicates_skipped"), n("added", "seen_count")]


def queue_stats(judged: DataFrame, max_size: int | None = OPTIONS.queue_size, popped: int = 0) -> DataFrame:
    """One row: what the queue holds and what became of the rows offered."""
    size = F.lit(max_size).cast("int").alias("max_size")
    return judged.agg(*queue_counts()).select((F.col("total_added") - popped).alias("current_size"), size, "total_added", F.lit(popped).alias("total_processed"), "filtered_robots", "duplicates_skipped", "seen_count")
